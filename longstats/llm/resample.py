"""Importance resampling of documents towards a target distribution.

A text's features are its runs of 1 to ``ngram`` consecutive words, repeats
included; each falls into one of ``buckets`` by its CRC-32.  A bucket's gain is
the logarithm of its smoothed share of the target over its share of the
documents (thousandths, rounded down); the gains are one array, and a
document's weight is their sum over its features, gathered from that array.
The score adds Gumbel noise drawn from the hash of the seed and the id, so the
highest scores are a draw without replacement with chances by weight.

The cutoff of the draw is found without sorting the table.  A mergeable
quantile sketch of the scores brackets it; exact counts of the scores outside
the bracket tell whether the cutoff lies inside, else the bracket is widened
(up to all scores); only the bracket is sorted, and the cutoff is the row that
the count asks for.  The drawn rows are then range-sorted and numbered.

What goes through the driver: the bucket counts (``buckets`` numbers), one row
per sorted range and the sketch.  Tasks hold one block of a text at a time.

Defined results: NULL and wordless texts have no feature, weight 0 and are
never drawn (unless ``min_words`` is 0); a NULL id is noised like the empty
text and loses ties; repeated rows are documents of their own, and which of
two rows equal in every column is drawn makes no difference; an empty target
gives gains of the smoothing alone; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 10_000
SEED = 2024
#: Words held at a time are those of one block of a text.
BLOCK = 1 << 20
#: Different features that a task remembers before it adds them up.
REMEMBERED = 400_000
#: First half-width of the bracket, as a share of the scores; each widening makes it four times as wide.
HALF_WIDTH = 0.02

# word bytes stay (digits, a-z, all beyond ASCII), A-Z are lower-cased, the others part the words
_WORD_BYTES = bytes(b if b in range(48, 58) or b in range(97, 123) or b > 127
                    else b + 32 if b in range(65, 91) else 32 for b in range(256))


def word_blocks(text: str | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``block`` bytes of text each."""
    raw = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES) if text else b""
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + block) if start + block < len(raw) else -1
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def feature_blocks(text: str | None, ngram: int = 1, block: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(new words, features that end in them) of a text, block by block."""
    kept: list[bytes] = []
    for words in word_blocks(text, block):
        if ngram == 1:
            yield len(words), words
            continue
        held = kept + words
        grams = list(words)
        for n in range(2, ngram + 1):
            grams += [b" ".join(held[i:i + n]) for i in range(max(0, len(kept) - n + 1), len(held) - n + 1)]
        yield len(words), grams
        kept = held[len(held) - ngram + 1:] if len(held) >= ngram else held


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngram: int = 1) -> np.ndarray:
    """Features of all texts per bucket: one array per task, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(buckets, np.int64), Counter()

        def add() -> None:
            at = np.fromiter((zlib.crc32(f) % buckets for f in held), np.int64, len(held))
            np.add.at(counts, at, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                for _, features in feature_blocks(text.as_py(), ngram):
                    held.update(features)
                    if len(held) > REMEMBERED:
                        add()
        add()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    rows = (texts.select("text").mapInArrow(run, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n + 0.0) / ((s + 1.0) * (t_all + n + 0.0))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id, seed: int = SEED) -> int:
    """Thousandths of the noise of a document."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _GainOf(dict):
    """Feature -> gain; features seen for the first time are looked up in the array."""

    def __init__(self, array: list[int]):
        super().__init__()
        self.array = array

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = self.array[zlib.crc32(feature) % len(self.array)]
        return found


def with_scores(docs: DataFrame, gain: np.ndarray, ngram: int = 1, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` per row."""
    array, kind = gain.tolist(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _GainOf(array)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out = np.zeros((4, len(ids)), np.int64)
            for i, (doc_id, text) in enumerate(zip(ids.to_pylist(), texts)):
                for words, features in feature_blocks(text.as_py(), ngram):
                    if len(of) > REMEMBERED:
                        of.clear()
                    out[0, i] += words
                    out[1, i] += len(features)
                    out[2, i] += sum(map(of.__getitem__, features))
                out[3, i] = out[2, i] + gumbel(doc_id, seed)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _by_rank() -> list[Column]:
    # uid last: rows that are equal in all else spread over the ranges
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]


def _range_sorted(rows: DataFrame, name: str) -> DataFrame:
    """The rows in ranges of the drawing order: also ``part`` (the range) and ``pos`` (from 0 inside it)."""
    number = F.monotonically_increasing_id()  # the range above bit 33, the row's place below
    return (stage(rows.repartitionByRange(*_by_rank()).sortWithinPartitions(*_by_rank()).withColumn("_n", number), name)
            .withColumns({"part": F.shiftright("_n", 33), "pos": F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_n"))


def bracket(scores: DataFrame, n: int, k: int, sketch: bytes, half_width: float = HALF_WIDTH) -> tuple[int | None, int | None, int, int]:
    """(lowest, highest, rows above, rows inside) such that the ``k``-th highest of ``n`` scores is inside.

    An end that is None is open.  ``sketch`` only proposes; the exact counts decide.
    """
    spark, at = scores.sparkSession, 1 - k / n
    while True:
        ends = [at - half_width, at + half_width]
        one = spark.range(1).select(F.lit(bytearray(sketch)).alias("s"))
        asked = one.select(*[F.kll_sketch_get_quantile_bigint("s", F.lit(min(max(e, 0.0), 1.0))).alias(f"q{i}")
                             for i, e in enumerate(ends)]).first()
        low, high = (asked["q0"] if ends[0] > 0 else None), (asked["q1"] if ends[1] < 1 else None)
        above = F.lit(False) if high is None else F.col("score") > high
        below = F.lit(False) if low is None else F.col("score") < low
        got = scores.agg(F.count_if(above).alias("above"), F.count_if(~above & ~below).alias("inside")).first()
        if got["above"] < k <= got["above"] + got["inside"]:
            return low, high, got["above"], got["inside"]
        half_width *= 4


def draw_cutoff(eligible: DataFrame, share: Fraction) -> tuple[int, int, object] | None:
    """(rows to draw, score and id of the last of them), or None if nothing is drawn."""
    told = eligible.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("score").alias("sketch")).first()
    n = told["n"]
    k = math.floor(share * n)
    if k == 0:
        return None
    low, high, above, _ = bracket(eligible, n, k, bytes(told["sketch"]))
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("score") >= low)
    if high is not None:
        inside = inside & (F.col("score") <= high)
    held = _range_sorted(eligible.filter(inside).select("doc_id", "score", "uid"), "resample-bracket")
    left = k - above  # from 1
    for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        if left <= r["n"]:
            last = held.filter((F.col("part") == r["part"]) & (F.col("pos") == left - 1)).first()
            return k, last["score"], last["doc_id"]
        left -= r["n"]
    raise AssertionError("the counts say that the bracket holds the cutoff")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = 1, seed: int = SEED,
             min_words: int = 20, share: Fraction = Fraction(10, 100)) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score`` and ``rank`` in the draw (NULL: not drawn).

    Of the documents with at least ``min_words`` words ``floor(share * number)`` are drawn, highest scores first,
    ties to the smaller id.
    """
    gain = gains(bucket_counts(docs, buckets, ngram), bucket_counts(target, buckets, ngram))
    scored = stage(with_scores(docs, gain, ngram, seed).withColumn("uid", F.monotonically_increasing_id()),
                   "resample-scores")
    shown = ["doc_id", "n_features", "weight", "score"]
    enough = F.col("n_words") >= min_words
    cut = draw_cutoff(scored.filter(enough), share)
    if cut is None:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    k, score, doc_id = cut
    tie = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= F.lit(doc_id), F.lit(False))
    drawn = enough & ((F.col("score") > score) | ((F.col("score") == score) & tie))
    held = _range_sorted(scored.filter(drawn), "resample-drawn")
    # one row per range
    before = (held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    place = F.col("before") + F.col("pos") + 1
    ranked = (held.join(before, "part")
              # rows equal to the last one's score and id may be more than are drawn
              .select(*shown, F.when(place <= k, place).alias("rank")))
    return ranked.unionByName(scored.filter(~drawn).select(*shown, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents' ids and ranks alone."""
    return resample(docs, target, **options).filter(F.col("rank").isNotNull()).select("doc_id", "rank")
