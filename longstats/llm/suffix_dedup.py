"""Repeated substrings by suffix arrays sorted in two stages.

Every byte covered by a ``length``-byte string that also starts earlier in the
corpus (smaller doc_id, or the same document and an earlier start) is removed.

1. Each window of ``length`` bytes names its anchor: the leftmost of its
   ``GRAM``-byte strings with the smallest hash.  Neighbouring windows mostly
   share one, so a document becomes few runs of windows.  Equal windows have
   equal anchors at equal places, so windows need comparing only within an
   anchor's hash.
2. Runs with equal bytes (by 64-bit hash of the run's bytes, beside the
   anchor's) are one class; all but the first run of a class are repeats as a
   whole.  Those that follow an equal run in their chunk of text go into the
   shuffle as merged byte ranges, the others as one row each, and an anchor's task
   decides them as they come, sorted.
3. First runs whose anchor has other classes too may share some windows.  They
   go back to their documents, which cut their bytes out.  A window holds, beside
   the anchor, at least half of the other bytes on its left or on its right, so its
   run is filed under the anchor with that half.  The bytes of runs filed under
   one key meet in a task that builds a suffix array in two stages: suffixes
   smaller than their successor are sorted directly, the others are induced by a
   scan over the buckets of first bytes.  Adjacent common prefixes of at least
   ``length`` bytes mark equal windows; all but the earliest are repeats.  A key
   with more than ``BIG`` runs (a very common phrase in many surroundings) is split
   instead: its windows go by their own 128-bit hash, so no task gets all of them.
4. The repeats' spans go to their documents and are merged there.

Each run is one narrow row in one shuffle, and the texts are shuffled twice (steps
3 and 4); every step's shuffle files go when its result is written, so disk follows
the input whatever share of it repeats.  Bytes filed under a key of their own are
kept out of the shuffle by a Bloom filter of ``FILTER_BITS`` bits over the other
keys (that is the size of what is broadcast).  A false hit costs a row and changes
nothing, as a run alone equals nothing; a full filter costs the shuffle of all bytes
that are filed.

Defined results: NULL texts have 0 bytes; texts shorter than ``length`` keep
everything; documents with a NULL id come after all others; rows with the same
id are ordered by their texts' SHA-256, equal rows arbitrarily (they are
interchangeable); an empty table gives an empty result; columns of the input
that the operator does not read are kept by ``remove_repeats`` and ignored by
``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longstats.session import materialize, remove_path, scratch_path

from .bloom_lm import SEGMENTS, Filter, build_filter
from .common import stage

LENGTH = 100
GRAM = 24
BIG = 5000
CHUNK_BYTES = 1 << 20
CACHE_BYTES = 1 << 16
BATCH_BYTES = 1 << 19
FILTER_BITS = 1 << 27
CONTEXT_ROWS = 1 << 14
KEY = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A random-looking 64-bit value per byte.
with np.errstate(over="ignore"):
    _x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ np.uint64(0x2545F4914F6CDD1D)
    _x = (_x ^ (_x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    BYTE_VALUE = _x ^ (_x >> np.uint64(32))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from every position, built by doubling."""
    with np.errstate(over="ignore"):
        power, width, h = _ODD, 1, BYTE_VALUE[data]
        out, done, factor = None, 0, np.uint64(1)
        while True:
            if n & width:
                out = h.copy() if out is None else out[: len(h) - done] + h[done:] * factor
                done, factor = done + width, factor * power
            if done == n:
                return out[: max(0, len(data) - n + 1)]
            h = h[:-width] + h[width:] * power if len(h) > width else h[:0]
            power, width = power * power, width * 2


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for many ranges: each is two overlapping powers of two of doubled hashes, plus its length."""
    size = end - begin
    out = np.zeros(len(begin), np.uint64)
    top = int(size.max(initial=1)).bit_length()
    with np.errstate(over="ignore"):
        power, h = _ODD, BYTE_VALUE[data]
        for k in range(top):
            width = 1 << k
            of = np.flatnonzero((size >= width) & (size < 2 * width))
            if len(of):
                out[of] = _mix(h[begin[of]]) * np.uint64(31) + _mix(h[end[of] - width] + size[of].astype(np.uint64))
            if len(h) <= width:
                break
            h = h[:-width] + h[width:] * power
            power = power * power
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def window_runs(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with the same anchor, over concatenated documents.

    Returns (document number, first window, last window, anchor's place, anchor's hash, hash of the run's bytes) with
    windows and places as positions in ``data``.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = gram_hashes(data, gram)
    half = np.uint64(32)
    key = (_mix(grams) >> half << half) | np.arange(len(grams), dtype=np.uint64)
    best = _sliding_min(key, length - gram + 1)  # the smallest hash (its upper half), then the leftmost
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = len(anchor)
    # windows that reach over a document's end are left out
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    doc = doc[first]
    last = np.minimum(np.concatenate([first[1:], [n]]) - 1, starts[doc + 1] - length)
    ok = last >= first
    doc, first, last = doc[ok], first[ok], last[ok]
    place = anchor[first]
    return doc, first, last, place, _mix(grams[place]), range_hashes(data, first, last + length)


def chunk_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``window_runs`` of a chunk, some documents at a time, so that its arrays stay in the processor's cache."""
    parts, i = [], 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CACHE_BYTES, side="right")) - 1)
        doc, first, last, place, anchor, content = window_runs(data[starts[i]: starts[j]], starts[i: j + 1] - starts[i], length)
        parts.append((doc + i, first + starts[i], last + starts[i], place + starts[i], anchor, content))
        i = j
    return tuple(np.concatenate(x) for x in zip(*parts))


def two_stage_suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Order of the wanted suffixes (all if not given), by their first ``depth`` bytes at least (equal ones in any order).

    Suffixes smaller than their successor are sorted directly.  A suffix larger than its successor follows from it:
    buckets of first bytes are scanned upward, and each entry puts the suffix before it, if that is of the larger kind,
    next into the front part of its own bucket.  What is wanted therefore needs, beside itself, the suffixes after it
    up to the first of the smaller kind.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller than the successor: by the next differing byte; the end counts as smaller than everything
    differs = np.flatnonzero(text[1:] != text[:-1])
    rises = text[differs] < text[differs + 1]
    up = np.zeros(n, bool)
    up[: differs[-1] + 1 if len(differs) else 0] = np.repeat(rises, np.diff(differs, prepend=-1))
    needed = np.ones(n, bool)
    if wanted is not None:
        last_wanted = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))
        smaller_before = np.concatenate([[0], np.cumsum(up)])
        # between the last wanted suffix and here there is none of the smaller kind
        needed = wanted | (last_wanted >= 0) & (smaller_before[:-1] == smaller_before[np.maximum(last_wanted, 0)])
    direct = np.flatnonzero(up & needed)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    # zero bytes pad the end; whole rows are compared as big-endian words
    words = -(-depth // 8)
    block = np.zeros((len(direct), words * 8), np.uint8)
    block[:, :depth] = rows[direct]
    room = np.minimum(n - direct, depth)  # among equal rows the one that the text's end cuts off is smaller
    order = direct[np.lexsort((room, block.view(f"S{words * 8}").ravel()))]
    del block
    down = ~up & needed
    down_parts: list[list[np.ndarray]] = [[] for _ in range(256)]
    edges = np.searchsorted(text[order], np.arange(257))
    if down[n - 1]:
        down_parts[int(text[n - 1])].append(np.array([n - 1]))

    def induce(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[down[before]]
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        cuts = np.flatnonzero(np.diff(letters[order])) + 1
        for part in np.split(before[order], cuts):
            if len(part):
                down_parts[int(text[part[0]])].append(part)

    out: list[np.ndarray] = [np.zeros(0, np.int64)]
    for c in range(256):
        at = 0
        while at < len(down_parts[c]):  # grows while runs of the same byte induce each other
            entries = down_parts[c][at]
            at += 1
            out.append(entries)
            induce(entries)
        entries = order[edges[c]: edges[c + 1]]
        if len(entries):
            out.append(entries)
            induce(entries)
    sa = np.concatenate(out)
    return sa if wanted is None else sa[wanted[sa]]


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix in the array with the one before it, counted up to ``limit``."""
    padded = np.concatenate([text, np.zeros(limit, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, limit)
    out = np.zeros(len(sa), np.int64)
    room = len(text) - sa
    for a in range(1, len(sa), 1 << 14):
        b = min(len(sa), a + (1 << 14))
        same = rows[sa[a:b]] == rows[sa[a - 1: b - 1]]
        out[a:b] = np.where(same.all(axis=1), limit, same.argmin(axis=1))
        out[a:b] = np.minimum(out[a:b], np.minimum(room[a:b], room[a - 1: b - 1]))
    return out


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For byte strings in corpus order: per string, the starts of windows that an earlier window equals."""
    sizes = np.array([len(c) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    # windows that cross into the next string don't count
    room = np.repeat(begins[1:], sizes) - np.arange(len(text))
    sa = two_stage_suffix_array(text, length, room >= length)
    group = np.cumsum(common_prefixes(text, sa, length) < length)  # equal windows stand together
    order = np.lexsort((sa, group))
    same = group[order[1:]] == group[order[:-1]]
    again = order[1:][same]
    found = np.sort(sa[again])
    cut = np.searchsorted(found, begins)
    return [found[cut[i]: cut[i + 1]] - begins[i] for i in range(len(contexts))]


def joined(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows at sorted starts."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > length)
    a, b = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(starts) - 1]])
    return [(int(starts[i]), int(starts[j]) + length) for i, j in zip(a, b)]


def spans_of(ranges: list) -> list[tuple[int, int]]:
    """Sorted, merged (touching ranges become one)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out




def _pieces(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A string column's UTF-8 bytes in chunks of about CHUNK_BYTES: (bytes, starts of pieces, row, offset of each).

    A longer text is cut into pieces that overlap, so that every window is whole in one of them.
    """
    import pyarrow.compute as pc

    held, rows, offsets, size = [], [], [], 0

    def out():
        starts = np.concatenate([[0], np.cumsum([len(x) for x in held], dtype=np.int64)])
        return np.frombuffer(b"".join(held), np.uint8), starts, np.array(rows), np.array(offsets)

    for i, raw in enumerate(pc.cast(column, pa.large_binary())):
        raw = raw.as_py() or b""
        for at in range(0, max(1, len(raw) - overlap), CHUNK_BYTES):
            piece = raw[at: at + CHUNK_BYTES + overlap]
            if held and size + len(piece) > CHUNK_BYTES + overlap:
                yield out()
                held, rows, offsets, size = [], [], [], 0
            held.append(piece)
            rows.append(i)
            offsets.append(at)
            size += len(piece)
    if held:
        yield out()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write in here removes its shuffle files at its end; else they stay until the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def class_rows(texts: DataFrame, length: int) -> DataFrame:
    """``(uid, text)`` -> (anchor, content, uid, at, b): of each class in a chunk of text the first run, ``b`` NULL.

    ``at`` is the run's first byte, then (16 bits each) how far behind it the anchor stands and the run's length beyond
    ``length``.  What a chunk's other runs cover comes as merged ranges from ``at`` to ``b``, dealt out by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for data, starts, rows, offsets in _pieces(batch.column(1), length - 1):
                piece, first, last, place, anchor, content = chunk_runs(data, starts, length)
                if not len(piece):
                    continue
                doc, a = uid[rows[piece]], first - starts[piece] + offsets[piece]
                # in the order of documents and places, so that a class's first run is the one that stays
                order = np.lexsort((a, doc, content, anchor))
                anchor, content = anchor[order], content[order]
                kept = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
                keep, rest = order[kept], order[~kept]
                rest = rest[np.lexsort((a[rest], doc[rest]))]
                end = a + (last - first) + length
                begins = np.flatnonzero(np.concatenate(
                    [[True], (doc[rest][1:] != doc[rest][:-1]) | (a[rest][1:] > end[rest][:-1])])[: len(rest)])
                range_doc, range_a = doc[rest[begins]], a[rest[begins]]
                range_b = end[rest[np.append(begins[1:], len(rest)) - 1]] if len(rest) else end[rest]
                at = a << 32 | (place - first) << 16 | (last - first)
                none = np.arange(len(keep) + len(begins)) < len(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([anchor[kept], _mix(range_doc.astype(np.uint64))]).view(np.int64)),
                     pa.array(np.concatenate([content[kept], np.zeros(len(begins), np.uint64)]).view(np.int64)),
                     pa.array(np.concatenate([doc[keep], range_doc])), pa.array(np.concatenate([at[keep], range_a])),
                     pa.array(np.concatenate([np.zeros(len(keep), np.int64), range_b]).astype(np.int32), mask=none)],
                    names=["anchor", "content", "uid", "at", "b"])

    return texts.select("uid", "text").mapInArrow(run, "anchor long, content long, uid long, at long, b int")


def settled_runs(rows: DataFrame, length: int) -> DataFrame:
    """``class_rows``, sorted, an anchor in one task -> (uid, at, b, anchor).

    Repeats are ranges from ``at`` to ``b``; the first runs of anchors with several classes keep ``at`` and have no ``b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last run's anchor and content
        held = [np.zeros(0, np.int64)] * 3  # (anchor, uid, at) of its anchor's first run, as long as there is one class
        for batch in batches:
            ready = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            anchor, content, uid, at = (batch.column(i).to_numpy()[~ready] for i in range(4))
            n = len(anchor)
            other = np.ones(n, bool)  # than the run before
            other[1:] = anchor[1:] != anchor[:-1]
            new = other.copy()
            new[1:] |= content[1:] != content[:-1]
            if n and before is not None:
                other[0] = anchor[0] != before[0]
                new[0] = other[0] or content[0] != before[1]
            if n:
                before = anchor[-1], content[-1]
            # classes of the same anchor follow each other: an anchor's first class needs a second one
            alone = np.concatenate([np.ones(len(held[0]), bool), other[new]])
            classes = [np.concatenate([x, y[new]]) for x, y in zip(held, (anchor, uid, at))]
            needed = ~alone
            needed[:-1] |= ~alone[1:]
            held = [x[-1:][alone[-1:]] for x in classes]
            anchors, first_uid, first_at = (x[needed] for x in classes)
            a = at[~new] >> 32
            b = a + (at[~new] & 0xFFFF) + length
            spans, firsts = int(ready.sum()) + len(a), len(anchors)
            is_first = np.arange(spans + firsts) >= spans
            fill = np.zeros(firsts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([batch.column(2).to_numpy()[ready], uid[~new], first_uid])),
                 pa.array(np.concatenate([batch.column(3).to_numpy()[ready], a, first_at])),
                 pa.array(np.concatenate([batch.column(4).fill_null(0).to_numpy()[ready], b, fill]).astype(np.int32),
                          mask=is_first),
                 pa.array(np.concatenate([np.zeros(spans, np.int64), anchors]), mask=~is_first)],
                names=["uid", "at", "b", "anchor"])

    return rows.mapInArrow(run, "uid long, at long, b int, anchor long")


def _contexts(found: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``(uid, text, firsts)`` -> (k1, uid, a, bytes): the first runs' bytes under their filing keys."""
    half = (length - gram) // 2
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(half, _ODD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            text = pc.cast(batch.column(1), pa.large_binary())
            data = np.frombuffer(text.buffers()[2], np.uint8)
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:]
            halves = np.lib.stride_tricks.sliding_window_view(data, half)
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            all_at, all_anchor = (x.to_numpy() for x in batch.column(2).flatten().flatten())
            all_rows = np.repeat(np.arange(batch.num_rows), sizes)
            for i in range(0, len(all_at), CONTEXT_ROWS):
                row, at = all_rows[i: i + CONTEXT_ROWS], all_at[i: i + CONTEXT_ROWS]
                anchor = all_anchor[i: i + CONTEXT_ROWS].view(np.uint64)
                first = offsets[row] + (at >> 32)
                place, last = first + (at >> 16 & 0xFFFF), first + (at & 0xFFFF)
                for side in (0, 1):
                    # windows with at least half of the other bytes to the anchor's left; then the others
                    lo = first if side == 0 else np.maximum(first, place - half + 1)
                    hi = np.minimum(last, place - half) if side == 0 else last
                    of = np.flatnonzero(lo <= hi)
                    if not len(of):
                        continue
                    lo, size, p = lo[of], (hi - lo)[of] + length, place[of]
                    with np.errstate(over="ignore"):
                        beside = (BYTE_VALUE[halves[p - half if side == 0 else p + gram]] * powers).sum(axis=1, dtype=np.uint64)
                        key = _mix(anchor[of] * np.uint64(2 * side + 3) + _mix(beside))
                    ends = np.cumsum(size)
                    cut = data[np.repeat(lo - ends + size, size) + np.arange(ends[-1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(batch.column(0).to_numpy()[row[of]]),
                         pa.array((lo - offsets[row[of]]).astype(np.int32)),
                         pa.Array.from_buffers(pa.binary(), len(of), [
                             None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(cut)])],
                        names=["k1", "uid", "a", "bytes"])

    return found.select("uid", "text", "firsts").mapInArrow(run, "k1 long, uid long, a int, bytes binary")


def _key_filter(keys: DataFrame) -> np.ndarray:
    return build_filter(keys.select(F.lit(KEY).cast("tinyint").alias("kind"), F.col("k1").alias("key"),
                                    F.lit(1).cast("long").alias("n")), FILTER_BITS)


def _sharing(contexts: DataFrame, bits) -> DataFrame:
    """The rows whose key the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Filter(bits.value, SEGMENTS)
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(found.has(KEY, keys, np.ones(len(keys), np.int64))))

    return contexts.mapInArrow(run, contexts.schema)


def _sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(uid, a, b) of repeats among the runs filed under each key, by suffix arrays over many keys at once."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[1], r[2]))  # corpus order
        out = []
        for (_, uid, a, _), starts in zip(held, repeated_windows([r[3] for r in held], length)):
            out += [(uid, a + x, a + y) for x, y in joined(starts, length)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
             pa.array([r[2] for r in out], pa.int32())], names=["uid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:  # a key's runs stay together; a run alone has nothing to equal
                        held += group
                        size += sum(len(r[3]) for r in group)
                        if size > BATCH_BYTES:
                            yield solve(held)
                            held, size = [], 0
                    group = []
                group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield solve(held)

    return (contexts.select("k1", "uid", "a", "bytes").repartition("k1").sortWithinPartitions("k1")
            .mapInArrow(run, "uid long, a int, b int"))


def _hashed_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(uid, a, b) of repeats among the windows of very common anchors, each window by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, a, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                n = len(raw) - length + 1
                digests = [hashlib.blake2b(raw[i: i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([uid] * n, pa.int64()),
                     pa.array(range(a, a + n), pa.int32())], names=["window", "uid", "a"])

    windows = contexts.select("uid", "a", "bytes").mapInArrow(run, "window binary, uid long, a int")
    firsts = (windows.groupBy("window").agg(F.min(F.struct("uid", "a")).alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("window").alias("w"), "first"))
    return (windows.join(firsts, F.col("window") == F.col("w"))
            .where(F.struct("uid", "a") != F.col("first"))
            .select("uid", "a", (F.col("a") + F.lit(length)).cast("int").alias("b")))


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``uid``: their corpus order as a long.

    Integer ids that are unique are that order themselves.  Otherwise ids and texts are ranked: rows are range-sorted
    by (id, SHA-256 of the text) and numbered by partition and place.
    """
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
        if again.isEmpty():
            return docs.withColumn("uid", F.col("doc_id").cast("long"))
    ordered = (docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
               .repartitionByRange(F.col("doc_id").asc_nulls_last(), "__sha")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "__sha").drop("__sha"))
    with shuffles_removed(docs.sparkSession):
        return stage(ordered.withColumn("uid", F.monotonically_increasing_id()), "numbered")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(uid, text, ...)`` -> also ``ranges``: the byte ranges to remove, in no order, possibly overlapping (NULL: none)."""
    spark, texts = docs.sparkSession, docs.select("uid", "text")
    with shuffles_removed(spark):
        rows = class_rows(texts, length).repartition("anchor").sortWithinPartitions("anchor", "content", "uid", "at")
        runs = stage(settled_runs(rows, length), "repeat-runs")
        firsts = runs.where("b is null").groupBy("uid").agg(F.collect_list(F.struct("at", "anchor")).alias("firsts"))
        filed = scratch_path(spark, "repeat-contexts")
        contexts = materialize(_contexts(texts.join(firsts, "uid"), length), "rows", root=filed)
        keys = stage(contexts.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-keys")
        big = stage(keys.where(F.col("n") > BIG).select("k1"), "big-keys")
        bits = spark.sparkContext.broadcast(_key_filter(keys))
        some = (_sorted_repeats(_sharing(contexts, bits).join(big, "k1", "left_anti"), length)
                .unionByName(_hashed_repeats(contexts.join(big, "k1", "left_semi"), length)))
        parts = stage(some, "repeat-parts")
    remove_path(spark, filed)
    bits.unpersist()
    whole = runs.where("b is not null").select("uid", F.col("at").cast("int").alias("a"), "b")
    found = (whole.unionByName(parts).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
             .withColumnRenamed("uid", "r_uid"))
    return docs.join(found, F.col("uid") == F.col("r_uid"), "left").drop("r_uid")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = spans(numbered(docs.select("doc_id", "text")), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                gone = spans_of(ranges.as_py() or [])
                sha, at = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(raw[at:a])
                    at = b
                sha.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], t)
                                    for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "ranges").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all columns, without the repeated bytes of ``text``.

    A cut inside a character would leave a broken one; the rest of such a character goes too.
    """
    plain = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    found = spans(numbered(plain), length).select("__row", "ranges")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            columns = []
            for i, f in enumerate(schema.fields):
                c = row.field(i)
                if f.name == "text":
                    texts = []
                    for text, ranges in zip(c.to_pylist(), batch.column(1).to_pylist()):
                        if ranges:
                            raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
                            for a, b in spans_of(ranges):
                                out.append(raw[at:a])
                                at = b
                            text = b"".join(x.decode("utf-8", "ignore").encode() for x in [*out, raw[at:]]).decode()
                        texts.append(text)
                    c = pa.array(texts, c.type)
                columns.append(c)
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return found.mapInArrow(run, schema)


__all__ = ["common_prefixes", "remove_repeats", "repeated_windows", "repeats", "two_stage_suffix_array", "window_runs"]
