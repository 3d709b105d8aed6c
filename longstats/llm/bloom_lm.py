"""Language-model scoring with a log-frequency Bloom filter.

Training documents give exact counts of words and of word pairs (the end of a
document counts as a word, and stands before the first one).  A count is
quantised to a level, the number of thresholds 1, 2, 3, ... (growing by
``GROWTH``) that it reaches; a word or pair of level L is put into the
filter L times, once for each level.  A reader probes level after level until a
probe misses, and takes the middle of the last level's counts.

The filter holds every word and every pair.  It is cut into segments by key: the
documents are written as chunks of ``CHUNK_BYTES``, every chunk sends its distinct
words and pairs, packed with their counts in training documents, to their
segments, and one task per segment adds them up and fills the segment's bits
(``BITS_PER_ENTRY`` for every entry, up to a power of two).  There is a segment for
every ``SEGMENT_BYTES`` of text.

A filter that can't have more than ``bits`` bits, whatever the texts say, is
broadcast, and every task probes it.  A larger one is asked where it lies: the
same tasks probe their segment for the words and pairs that each chunk sent, and
send back one byte for each, in the order in which they were asked, so that a chunk
finds its answers by their place.  No n-gram is shuffled twice and none becomes a
row.  Both ways ask the same bits and give the same score.

The score of a text is the sum of log10 P(w | u) with Dirichlet smoothing:

    P(w | u) = (pair(u, w) + mu * P1(w)) / (word(u) + mu)
    P1(w)    = (word(w) + 0.5) / (N + 0.5 * (V + 1))

Every token stands before exactly one other, so u's pairs add up to word(u).

The base score needs exact counts: beside a broadcast filter the words at or above a
count that at most ``FREQUENT`` words reach are broadcast (16 bytes each) and the
others joined; else they come with the answers.
Words are identified by 64-bit XXH3 hashes.

Defined results: NULL text counts as empty (one token, the end); a NULL doc_id
has the check sum of the empty text; an empty table gives an empty result; with
no training document all counts are 0; repeated rows each get a row; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_chunks

BITS = 1 << 28  # of a filter that is broadcast, at most
SEGMENTS = 64
PROBES = 4
BITS_PER_ENTRY = 16  # at least: with 4 probes at most one absent n-gram in 400 is found
GROWTH = 1.25
FREQUENT = 1 << 20
MU = 16.0
CHUNK_BYTES = 4 << 20
SEGMENT_BYTES = 4 << 20
WORD, PAIR = 1, 2
END = np.uint64(0x9E3779B97F4A7C15)
SETTLED = pa.schema([("segment", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("word_n", pa.binary()),
                     ("pairs", pa.binary()), ("bits", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def thresholds(growth: float = GROWTH, limit: int = 1 << 40) -> np.ndarray:
    """The smallest count of every level."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


LEVELS = thresholds()
#: The count that a level stands for (0: not in the filter): the middle of the counts it covers.
LEVEL_COUNT = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]])


def level_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, count, side="right")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every token of a text, the end included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The first word's hash in the upper 32 bits, the pair's in the lower."""
    with np.errstate(over="ignore"):
        low = mix(before * np.uint64(3) + word) & np.uint64(0xFFFFFFFF)
    return (before & ~np.uint64(0xFFFFFFFF)) | low


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, number per text) of several texts."""
    parts = [word_hashes(t) for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _base(kind: int, keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + np.uint64(kind) * np.uint64(0x632BE59BD9B4E019))


def segment_of(kind: int, keys: np.ndarray, segments: int) -> np.ndarray:
    """It depends on the key alone; ``segments`` is a power of two."""
    return (_base(kind, keys) & np.uint64(segments - 1)).astype(np.int64)


def bit_hashes(kind: int, keys: np.ndarray, level: np.ndarray, segments: int) -> tuple:
    """(segment, first hash, step) of entries."""
    base = _base(kind, keys)
    with np.errstate(over="ignore"):
        h = mix(base + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (base & np.uint64(segments - 1)).astype(np.int64), h, mix(h) | np.uint64(1)


def bit_positions(kind: int, keys: np.ndarray, level: np.ndarray, bits: int, segments: int) -> tuple:
    """(segment, positions in it) of entries in a filter of equal segments.  Sizes are powers of two."""
    segment, h, step = bit_hashes(kind, keys, level, segments)
    with np.errstate(over="ignore"):
        size = np.uint64(bits // segments - 1)
        return segment, [(h + np.uint64(i) * step) & size for i in range(PROBES)]


class Filter:
    """Read access to the filter's bits.  The segments have the same size if no ``sizes`` (bits, powers of two) are given."""

    def __init__(self, data: np.ndarray, segments: int = SEGMENTS, sizes: np.ndarray | None = None):
        self.data, self.segments = data, segments
        self.sizes = np.full(segments, len(data) * 8 // segments, np.int64) if sizes is None else sizes
        self.begin = np.cumsum(self.sizes) - self.sizes

    def has(self, kind: int, keys: np.ndarray, level: np.ndarray) -> np.ndarray:
        segment, h, step = bit_hashes(kind, keys, level, self.segments)
        begin, mask = self.begin[segment], (self.sizes[segment] - 1).astype(np.uint64)
        out, live = np.zeros(len(keys), bool), np.arange(len(keys))
        for i in range(PROBES):  # most absent keys go at the first bit
            with np.errstate(over="ignore"):
                at = begin[live] + ((h[live] + np.uint64(i) * step[live]) & mask[live]).astype(np.int64)
            live = live[(self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        out[live] = True
        return out

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated probes."""
        level, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(live) and level[live[0]] < len(LEVELS):
            live = live[self.has(kind, keys[live], level[live] + 1)]
            level[live] += 1
        return level

    def count(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        return LEVEL_COUNT[self.levels(kind, keys)]


def fill_segment(entries: list[tuple[int, np.ndarray, np.ndarray]], bits: int, segments: int) -> bytes:
    """The bits of one segment from its (kind, keys, counts)."""
    data = np.zeros(bits // segments, bool)
    for kind, keys, counts in entries:
        top = level_of(counts)
        for level in range(1, int(top.max(initial=0)) + 1):
            at = keys[top >= level]
            _, places = bit_positions(kind, at, np.full(len(at), level), bits, segments)
            for p in places:
                data[p.astype(np.int64)] = True
    return np.packbits(data, bitorder="little").tobytes()


def _segmented(rows: DataFrame, bits: int, segments: int) -> DataFrame:
    """``(kind tinyint, key long, n long)`` with the segment of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            segment = np.zeros(len(keys), np.int32)
            for kind in np.unique(kinds):
                of = kinds == kind
                segment[of] = bit_positions(int(kind), keys[of], np.ones(int(of.sum())), bits, segments)[0]
            yield pa.RecordBatch.from_arrays([pa.array(segment), *batch.columns], names=["segment", "kind", "key", "n"])

    return rows.select("kind", "key", "n").mapInArrow(run, "segment int, kind tinyint, key long, n long")


def _by_kind(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    kinds, keys, n = (table.column(c).to_numpy() for c in ("kind", "key", "n"))
    return [(int(k), keys[kinds == k].view(np.uint64), n[kinds == k]) for k in np.unique(kinds)]


def build_filter(entries: DataFrame, bits: int, segments: int = SEGMENTS) -> np.ndarray:
    """The filter's bytes from ``(kind tinyint, key long, n long)``: every segment is filled by a task of its own."""

    def fill(key, table):
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                         "bits": pa.array([fill_segment(_by_kind(table), bits, segments)], pa.binary())})

    filled = _segmented(entries, bits, segments).groupBy("segment").applyInArrow(fill, "segment int, bits binary")
    data = np.zeros((segments, bits // segments // 8), np.uint8)
    for row in filled.toLocalIterator():
        data[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return data.reshape(-1)


def is_part(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def filter_segments(text_bytes: int) -> int:
    """A power of two that grows with the texts, so that a segment doesn't."""
    return max(SEGMENTS, 1 << (-(-text_bytes // SEGMENT_BYTES) - 1).bit_length() if text_bytes else 0)


def segment_bits(entries: int) -> int:
    """Bits of a segment of so many entries."""
    return max(64, 1 << (entries * BITS_PER_ENTRY - 1).bit_length() if entries else 0)


def most_bits(text_bytes: int, texts: int, segments: int) -> int:
    """What a filter can't exceed: a text has at most half as many words as bytes (and one more), and the end; every
    token adds at most one entry as a word and one as a pair."""
    tokens = text_bytes // 2 + 2 * texts
    return 2 * BITS_PER_ENTRY * 2 * tokens + 64 * segments


class Ngrams:
    """The tokens of a chunk of texts, its distinct words and pairs, and their segments' order.

    The distinct ones stand in the order of their first places, so that two readings of a chunk agree.
    """

    def __init__(self, texts: list):
        tokens, self.lengths = tokens_of(texts)
        self.starts = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate([tokens[-1:], tokens[:-1]])  # the end stands before the first word
        before[self.starts] = END
        self.code, self.words = pd.factorize(tokens)
        self.pair_code, self.pairs = pd.factorize(pair_keys(before, tokens))
        self.code_before = np.concatenate([self.code[-1:], self.code[:-1]])
        self.code_before[self.starts] = self.code[-1]  # the last token is an end

    def by_segment(self, segments: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, segments in rising order, the order that sorts the keys like this)."""
        out = []
        for kind, keys in ((WORD, self.words), (PAIR, self.pairs)):
            segment = segment_of(kind, keys, segments)
            order = np.argsort(segment, kind="stable")
            out.append((kind, keys, segment[order], order))
        return out


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values between bounds, as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)),
                                  pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and their bounds."""
    rows = column.to_pylist()
    width = np.dtype(kind).itemsize
    bounds = np.concatenate([[0], np.cumsum([len(r) // width for r in rows])]).astype(np.int64)
    return np.frombuffer(b"".join(rows), kind), bounds


def text_table(docs: DataFrame) -> DataFrame:
    """The documents as written chunks: ``chunk, body`` (ids and texts, packed), ``n`` (rows), ``size`` (bytes of text).

    A longer text is a chunk of its own.  Packed, a chunk stays small wherever it is moved or held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for a, b in text_chunks(batch.column(1), CHUNK_BYTES):
                body = pa.BufferOutputStream()
                with pa.ipc.new_stream(body, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([body.getvalue().to_pybytes()], pa.binary()),
                     pa.array([b - a], pa.int64()), pa.array([int(sizes[a:b].sum())], pa.int64())],
                    names=["chunk", "body", "n", "size"])
                at += 1

    return stage(docs.select("doc_id", "text").mapInArrow(run, "chunk long, body binary, n long, size long"), "lm-chunks")


def chunk_rows(body: pa.BinaryScalar) -> tuple[pa.Array, list]:
    """(ids, texts) of a chunk."""
    rows = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
    return rows.column(0), rows.column(1).to_pylist()


def sent_ngrams(chunks: DataFrame, segments: int, folds: int, fold: int) -> DataFrame:
    """One row per chunk and segment: its distinct words and pairs there and their counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = chunk_rows(batch.column(1)[i])
                grams = Ngrams(texts)
                train = np.repeat(np.array([not is_part(d, folds, fold) for d in ids.to_pylist()]), grams.lengths)
                kinds = grams.by_segment(segments)
                found = np.unique(np.concatenate([np.unique(segment) for _, _, segment, _ in kinds]))
                columns = [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), batch.column(0)[i].as_py()))]
                for (_, keys, segment, order), code in zip(kinds, (grams.code, grams.pair_code)):
                    n = np.bincount(code[train], minlength=len(keys)).astype(np.uint32)
                    bounds = np.append(np.searchsorted(segment, found), len(keys))
                    columns += [packed(keys[order], bounds), packed(n[order], bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "chunk", "words", "word_n", "pairs", "pair_n"])

    return chunks.select("chunk", "body").mapInArrow(
        run, "segment int, chunk long, words binary, word_n binary, pairs binary, pair_n binary")


def settled_segments(sent: DataFrame, answer: bool) -> DataFrame:
    """Every segment's sums, filled and kept, or asked for what was sent.

    A row without chunk has a segment's ``tokens`` and ``distinct`` words, and without ``answer`` its ``bits`` and its
    words with their counts.  With ``answer`` a row for each chunk has the levels that the filter's bits give for the
    words and pairs it sent, in their order, and the words' exact counts.
    """

    def settle(key, table):
        held = []
        for kind, name in ((WORD, "word"), (PAIR, "pair")):
            keys, bounds = unpacked(table.column(name + "s"), np.uint64)
            code, keys = pd.factorize(keys)
            n = unpacked(table.column(name + "_n"), np.uint32)[0]
            held.append((kind, keys, np.bincount(code, n, len(keys)).astype(np.int64), code, bounds))
        entries = [(kind, keys[n > 0], n[n > 0]) for kind, keys, n, _, _ in held]
        size = segment_bits(sum(int(level_of(n).sum()) for _, _, n in entries))
        data = fill_segment(entries, size, 1)
        _, words, counts = entries[0]
        row = {"segment": key[0].as_py(), "tokens": int(counts.sum()), "distinct": len(words)}
        if not answer:
            row |= {"bits": data, "words": words.tobytes(), "word_n": counts.tobytes()}
        out = [pa.Table.from_pylist([row], SETTLED)]
        if answer:
            one = Filter(np.frombuffer(data, np.uint8), 1)  # of this segment alone: the positions in it are the same
            said = {kind: packed(one.levels(kind, keys).astype(np.uint8)[code], bounds) for kind, keys, _, code, bounds in held}
            _, _, n, code, bounds = held[0]
            rows = {"segment": table.column("segment"), "chunk": table.column("chunk"), "words": said[WORD],
                    "word_n": packed(n[code], bounds), "pairs": said[PAIR]}
            none = lambda f: pa.nulls(table.num_rows, f.type)
            out.append(pa.table([rows.get(f.name, none(f)) for f in SETTLED], SETTLED))
        return pa.concat_tables(out)

    return stage(sent.groupBy("segment").applyInArrow(
        settle, "segment int, chunk long, words binary, word_n binary, pairs binary, bits binary, tokens long, distinct long"),
        "lm-segments")


def _sorted_places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted keys stand in the sorted ``keys``; -1 for others."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    order = np.argsort(wanted)  # neighbouring searches touch neighbouring memory
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """What a scoring task needs of the counts; its size is bounded by ``bits`` and ``frequent``.

    ``memo`` holds what the filter said of the frequent words so far (NaN: not asked yet): a worker probes each of
    them once, not once per chunk of text.  Without ``filter`` the answers come with the chunks.
    """

    def __init__(self, filter: Filter | None, tokens: int, distinct: int, keys: np.ndarray, counts: np.ndarray,
                 mu: float = MU):
        self.filter, self.tokens, self.distinct, self.mu = filter, tokens, distinct, mu
        self.keys, self.counts = keys, counts
        self.memo = np.full(len(keys), np.nan)
        self.denominator = tokens + 0.5 * (distinct + 1)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where the words stand among the frequent ones; -1 for others."""
        return _sorted_places(self.keys, words)

    def exact(self, places: np.ndarray) -> np.ndarray:
        """Counts of the frequent words, -1 for others."""
        return np.where(places >= 0, self.counts[places], -1) if len(self.counts) else places

    def probed(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The filter's counts of distinct words."""
        out = np.empty(len(words))
        new = np.flatnonzero(places < 0)
        often = places[places >= 0]
        if len(often):
            asked = np.flatnonzero(places >= 0)
            fresh = asked[np.isnan(self.memo[often])]
            self.memo[places[fresh]] = self.filter.count(WORD, words[fresh])
            out[asked] = self.memo[often]
        out[new] = self.filter.count(WORD, words[new])
        return out

    def log10_of(self, with_pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the filter's counts of the pair and its two words."""
        # levels stand for a range of counts: keep pair <= word
        return np.log10((with_pair + self.mu * (word + 0.5) / self.denominator) / (np.maximum(before, with_pair) + self.mu))

    def log10_probability(self, word: np.ndarray, code: np.ndarray, code_before: np.ndarray,
                          places: np.ndarray | None = None) -> np.ndarray:
        """Of tokens given as places in an array of distinct words."""
        known = self.probed(word, self.places(word) if places is None else places)
        # common pairs have many levels: each distinct pair is probed once
        of, pair = pd.factorize(pair_keys(word[code_before], word[code]))
        with_pair = self.filter.count(PAIR, pair)[of]
        return self.log10_of(with_pair, known[code_before], known[code])


def train(docs: DataFrame, folds: int = 5, fold: int = 1, bits: int = BITS, frequent: int = FREQUENT,
          mu: float = MU) -> tuple[Model, DataFrame]:
    """The model, and the table of all word counts (key, n), which is empty if the filter isn't broadcast."""
    model, settled, _, _ = _train(docs, folds, fold, bits, frequent, mu)
    return model, word_counts(settled)


def word_counts(settled: DataFrame) -> DataFrame:
    """(key, n) of the words that the segments keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(n, np.int64))],
                                                 names=["key", "n"])

    return settled.where(F.col("bits").isNotNull()).select("words", "word_n").mapInArrow(run, "key long, n long")


def _train(docs: DataFrame, folds: int, fold: int, bits: int = BITS, frequent: int = FREQUENT,
           mu: float = MU) -> tuple[Model, DataFrame, DataFrame, int]:
    """Also the settled segments, the documents' chunks and the number of segments."""
    chunks = text_table(docs)
    text_bytes, texts = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    segments = filter_segments(text_bytes)
    broadcast = most_bits(text_bytes, texts, segments) <= bits
    settled = settled_segments(sent_ngrams(chunks, segments, folds, fold), not broadcast)
    tokens, distinct = settled.where(F.col("chunk").isNull()).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    none = np.zeros(0, np.int64)
    if not broadcast:
        return Model(None, tokens, distinct, none.view(np.uint64), none, mu), settled, chunks, segments
    parts, sizes = [b"\0" * 8] * segments, np.full(segments, 64, np.int64)
    for row in settled.where(F.col("bits").isNotNull()).select("segment", "bits").toLocalIterator():
        parts[row["segment"]], sizes[row["segment"]] = row["bits"], 8 * len(row["bits"])
    data = np.frombuffer(b"".join(parts), np.uint8)

    # the words that the most tokens have: as many whole levels as fit
    words = word_counts(settled)
    level = F.expr("array_max(filter(array(%s), x -> x <= n))" % ", ".join(f"{x}L" for x in LEVELS))
    histogram = words.groupBy(level.alias("c")).agg(F.count(F.lit(1)).alias("m")).collect()
    cut, number = 1 << 62, 0
    for c, m in sorted(((r["c"], r["m"]) for r in histogram), reverse=True):
        if number + m > frequent:
            break
        cut, number = c, number + m
    often = words.where(F.col("n") >= cut).toArrow() if number else None
    keys = often.column("key").to_numpy().view(np.uint64) if number else none.view(np.uint64)
    order = np.argsort(keys)
    n = often.column("n").to_numpy()[order] if number else none
    return Model(Filter(data, segments, sizes), tokens, distinct, keys[order], n, mu), settled, chunks, segments


def score(docs: DataFrame, folds: int = 5, fold: int = 1, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, settled, chunks, segments = _train(docs, folds, fold, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model.filter is None:
        return _answered_scores(chunks, settled.where(F.col("chunk").isNotNull()), model, segments, kind, folds, fold)
    return _broadcast_scores(chunks, word_counts(settled), model, kind, folds, fold)


def _answered_scores(chunks: DataFrame, answers: DataFrame, model: Model, segments: int, kind: str, folds: int,
                     fold: int) -> DataFrame:
    """Every chunk meets the answers to what it sent."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = chunk_rows(chunk.column("body")[0])
        grams = Ngrams(texts)
        answers = answers.sort_by("segment")
        (_, _, _, of_words), (_, _, _, of_pairs) = grams.by_segment(segments)
        words, pairs = np.empty(len(of_words)), np.empty(len(of_pairs))
        exact = np.empty(len(of_words), np.int64)
        words[of_words] = LEVEL_COUNT[unpacked(answers.column("words"), np.uint8)[0]]
        pairs[of_pairs] = LEVEL_COUNT[unpacked(answers.column("pairs"), np.uint8)[0]]
        exact[of_words] = unpacked(answers.column("word_n"), np.int64)[0]
        logs = model.log10_of(pairs[grams.pair_code], words[grams.code_before], words[grams.code])
        base = np.log10((exact + 0.5) / model.denominator)[grams.code]
        sums = lambda x: pa.array(np.add.reduceat(x, grams.starts))
        return pa.table({"doc_id": ids, "held_out": pa.array([is_part(i, folds, fold) for i in ids.to_pylist()]),
                         "n_tokens": pa.array(grams.lengths), "n_known": sums((exact > 0)[grams.code].astype(np.int64)),
                         "train_tokens": pa.array(np.full(len(texts), model.tokens, np.int64)),
                         "base_score": sums(base), "score": sums(logs)})

    return (chunks.select("chunk", "body").groupBy("chunk")
            .cogroup(answers.select("chunk", "segment", "words", "word_n", "pairs").groupBy("chunk"))
            .applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double"))


def _broadcast_scores(chunks: DataFrame, words: DataFrame, model: Model, kind: str, folds: int, fold: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = chunk_rows(batch.column(0)[i])
                grams = Ngrams(texts)
                places = m.places(grams.words)
                exact = m.exact(places)
                logs = np.where(exact >= 0, np.log10((np.maximum(exact, 0) + 0.5) / m.denominator), 0.0)[grams.code]
                rare = (exact < 0)[grams.code]
                starts, tokens = grams.starts, grams.words[grams.code]
                scores = np.add.reduceat(m.log10_probability(grams.words, grams.code, grams.code_before, places), starts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([is_part(d, folds, fold) for d in ids.to_pylist()]),
                     pa.array(grams.lengths), pa.array(np.add.reduceat((~rare).astype(np.int64), starts)),
                     pa.array(np.add.reduceat(logs, starts)), pa.array(scores),
                     pa.array([tokens[s:e][rare[s:e]].view(np.int64) for s, e in zip(starts, starts + grams.lengths)],
                              pa.list_(pa.int64()))],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    scored = (chunks.select("body").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    scored = stage(scored, "lm-scored")
    unknown = math.log10(0.5 / model.denominator)
    gain = F.col("tf") * (F.log10((F.col("n") + 0.5) / F.lit(model.denominator)) - F.lit(unknown))
    found = (scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("tf"))
             .join(words, "key").groupBy("row")
             .agg(F.sum("tf").alias("more"), F.sum(gain).alias("gain")))
    return (scored.join(found, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                    F.lit(model.tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.size("rare") * F.lit(unknown) + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
                    "score"))


__all__ = ["Filter", "Model", "score", "train", "word_hashes"]
