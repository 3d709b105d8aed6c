"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all
non-ASCII characters.  Every run of ``window`` consecutive words of a benchmark
item is a phrase; a shorter item is one phrase.  A document word inside any
occurrence of a phrase is hit.

Each shard (about ``SHARD_BYTES`` of text inside one task) is turned into the
sequence of its words' numbers in the benchmark's vocabulary.  Words that no
phrase holds cannot be part of an occurrence; they end a run, and runs shorter
than the shortest phrase are left out.  Over the rest stands an FM-index:
suffix array, Burrows-Wheeler transform, wavelet-tree ranks and sampled suffix
positions.  All phrases are searched backward together, one rank query per word;
occurrences are located by walking to the next sampled position, and their spans
are merged per document.

The phrase set is sent to the tasks in blocks of about ``BLOCK_BYTES`` of
item text, written to the shared folder; each block is one pass, so its memory is
bounded in tasks and driver however large the benchmark is.  The documents never move: there is no shuffle.

Defined results: NULL or wordless texts have 0 words and no hit; a NULL or
wordless item has no phrase; the phrases of items without an id hit words, but add no item; an empty benchmark marks nothing; repeated
documents each get a row; repeated item ids count once; columns of the input
that the operator does not read are kept by ``remove_contamination`` and ignored
by ``contamination``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longstats.session import checkpoint_root, materialize

from .common import stage, text_chunks

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
SAMPLE = 8

# fixed value: the words of the contract, over UTF-8 bytes (all bytes of a non-ASCII character are 0x80 or more)
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WaveletTree:
    """Ranks over a sequence of small integers: one bit vector per binary digit, most significant first.

    At each level the sequence is stably parted by the digit, zeros first; a
    symbol's rank follows its digits down with one bit count per level.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        seq = symbols
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for k, ones in enumerate(self.ones):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            zeros = len(ones) - 1 - ones[-1]
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        out, pos = np.zeros_like(at), at.copy()
        for ones in self.ones:
            bit = ones[pos + 1] - ones[pos]
            zeros = len(ones) - 1 - ones[-1]
            out = out * 2 + bit
            pos = np.where(bit, zeros + ones[pos], pos - ones[pos])
        return out


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols, by prefix doubling."""
    n = len(seq)
    rank = seq.astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - k)] = rank[k:] + 1 if k < n else 0
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        if k >= depth:
            return order
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Count and locate phrases in one integer sequence (symbols 1..sigma-1; 0 ends a run)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        # a unique smallest symbol at the end makes the rotations' order that of the suffixes
        text = np.concatenate([seq + 1, [0]]).astype(np.int64)
        sa = suffix_array(text, len(text))
        self.bwt = WaveletTree(text[sa - 1], sigma + 1)
        counts = np.bincount(text, minlength=sigma + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.marked = sa % SAMPLE == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = sa[self.marked]
        self.n = len(text)

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.bwt.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of phrases given as rows, right-aligned; all are extended to the left together."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back].astype(np.int64) + 1
            lo[live], hi[live] = self._step(symbol, lo[live]), self._step(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk left until a sampled position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.marked[at[todo]]
            hit = todo[done]
            out[hit] = self.samples[self.mark_rank[at[hit]]] + steps[hit]
            todo = todo[~done]
            at[todo] = self._step(self.bwt.access(at[todo]), at[todo])
            steps[todo] += 1
        return out


class Phrases:
    """The phrases of a block of benchmark items over the block's own vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        owners: dict[tuple[int, ...], list[int]] = {}
        numbers: dict[str, int] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            item = None if item_id is None else numbers.setdefault(str(item_id), len(numbers))
            for i in range(max(1, len(ids) - window + 1)):
                owned = owners.setdefault(tuple(ids[i: i + window]), [])
                if item is not None and item not in owned:
                    owned.append(item)
        self.items = list(numbers)
        self.owners = list(owners.values())
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), int(self.lengths.max(initial=1))), np.int32)
        for i, p in enumerate(owners):
            self.rows[i, self.rows.shape[1] - len(p):] = p

    def search(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """Per document: merged [from, to) word spans and the items found, by one FM-index over the shard."""
        lengths = np.array([len(d) for d in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        found: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in docs]
        if not len(self.lengths):
            return found
        get = self.vocabulary.get
        seq = np.zeros(int(starts[-1]) + 1, np.int32)
        for d, a in zip(docs, starts):
            seq[a: a + len(d)] = [get(w, 0) for w in d]
        known = np.concatenate([[0], (seq > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        begin, end = edge[::2], edge[1::2]
        long_enough = end - begin >= self.lengths.min()
        begin, end = begin[long_enough], end[long_enough]
        if not len(begin):
            return found
        size = end - begin + 1  # and the 0 that ends the run
        packed_start = np.concatenate([[0], np.cumsum(size)])[:-1]
        source = np.repeat(begin - packed_start, size) + np.arange(int(size.sum()))
        index = FMIndex(seq[source].astype(np.int64), len(self.vocabulary) + 1)
        lo, hi = index.search(self.rows, self.lengths)
        many = hi - lo
        rows = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        phrase = np.repeat(np.arange(len(many)), many)
        at = source[index.locate(rows)]
        doc = np.searchsorted(starts, at, side="right") - 1
        order = np.lexsort((at, doc))
        for d, a, p in zip(doc[order].tolist(), (at - starts[doc])[order].tolist(), phrase[order].tolist()):
            spans, items = found[d]
            to = a + int(self.lengths[p])
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], to))
            else:
                spans.append((a, to))
            items.extend(self.items[i] for i in self.owners[p])
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> tuple[int, Callable[[int], list]]:
    """The number of blocks, and what reads one: its items, about ``limit`` bytes of text.

    The blocks are dealt by a hash and written to the shared folder, so the driver holds one at a time.
    """
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")
    checkpoint_root(benchmark.sparkSession)
    items = items.select("item_id", "text", block)
    # an empty partitioned table would have no schema
    written = materialize(items.repartition("block"), "benchmark-blocks", ("block",) if n > 1 else ())
    return n, lambda i: [(r["item_id"], r["text"]) for r in written.where(F.col("block") == i).collect()]


def _search_block(docs: DataFrame, items: list, window: int, text: str, first: bool,
                  cut: T.StructType | None = None) -> DataFrame:
    """One pass over the documents with one block: appends to the spans and items found so far.

    With ``cut`` the documents (the struct column ``row``, of that schema) come back with the spans cut out instead.
    """
    keep = [f for f in docs.schema.fields if first or f.name not in ("__n_words", "__spans", "__items")]
    schema = cut or T.StructType([T.StructField(f.name, f.dataType) for f in keep]
                                 + [T.StructField("__n_words", T.LongType()),
                                    T.StructField("__spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
                                    T.StructField("__items", T.ArrayType(T.StringType()))])

    def cleaned(part: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        row, columns = part.column(part.schema.get_field_index("row")), []
        for i, f in enumerate(cut.fields):
            c = row.field(i)
            if f.name == text and any(spans):
                c = pa.array([cut_words(t, s) if s else t for t, s in zip(c.to_pylist(), spans)], c.type)
            columns.append(c)
        return pa.RecordBatch.from_arrays(columns, names=cut.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in text_chunks(column, SHARD_BYTES):
                # a copy of the rows, not a slice: a struct's fields would come back whole
                part = batch.take(pa.array(range(a, b), pa.int64()))
                docs_words = [words_of(t) for t in column.slice(a, b - a).to_pylist()]
                found = phrases.search(docs_words)
                spans, names = [f[0] for f in found], [f[1] for f in found]
                if not first:
                    held = [part.column(part.schema.get_field_index(x)).to_pylist() for x in ("__spans", "__items")]
                    spans = [merged([*map(tuple, x), *y]) for x, y in zip(held[0], spans)]
                    names = [x + y for x, y in zip(held[1], names)]
                if cut:
                    yield cleaned(part, spans)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f.name)) for f in keep),
                     pa.array([len(d) for d in docs_words], pa.int64()),
                     pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32()))),
                     pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))],
                    names=[f.name for f in keep] + ["__n_words", "__spans", "__items"])

    return docs.mapInArrow(run, schema)


def search_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                     block_bytes: int = BLOCK_BYTES, cut: T.StructType | None = None) -> DataFrame:
    """The documents with ``__n_words``, ``__spans`` (word ranges [from, to)) and ``__items`` (sorted ids)."""
    out, (n, block) = docs, benchmark_blocks(benchmark, block_bytes)
    for i in range(n):
        out = _search_block(stage(out, "decontaminate") if i else out, block(i), window, text, i == 0, cut if i == n - 1 else None)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search_benchmark(docs.select("doc_id", "text"), benchmark, window, **options)
    hit = F.aggregate("__spans", F.lit(0), lambda n, s: n + s[1] - s[0]).cast("long")
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"),
                        F.size("__items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def cut_words(text: str, spans: list) -> str:
    """The text without its words in the spans; what stands between two hit words of a span goes with them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORDS.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at: places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """The documents, all columns, with the hit spans cut out of ``text``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return search_benchmark(rows, benchmark, window, cut=docs.schema, **options)


__all__ = ["FMIndex", "Phrases", "WaveletTree", "contamination", "cut_words", "remove_contamination",
           "search_benchmark", "words_of"]
