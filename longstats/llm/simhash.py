"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint holds one bit per hash bit: 1 if set in more than half
of its shingles' XXH64 values.  Fingerprints at ``distance`` or fewer bits link.

The 64 bits are cut into ``blocks`` parts, so two linked fingerprints differ in
at most ``distance // blocks`` bits of some part.  On each part a covering code
gives the anchors: the binary Hamming code on the part's low bits (radius 1)
and all words on the rest.  A fingerprint's home is the anchor nearest to its
part (at most ``RADIUS`` away); it is also replicated to every anchor within
radius plus the part's threshold.  Two linked fingerprints then meet at the
home anchor of either, where the 64 bits are compared.

Only distinct fingerprints take part, so copies cost nothing; per part a
fingerprint makes a fixed number of rows, whatever the input.  An anchor with
more than ``BLOCK`` fingerprints is compared in blocks, so no task holds more.
Of the links found together only a spanning forest is kept: a group of near
copies costs links in proportion to its size, not to its pairs.  Components are
found by letting every fingerprint take the smallest label near it and then
that label's label, until nothing changes; the links are staged in the shared folder.

Defined results: NULL, empty and blank texts have fingerprint 0 and link like
any other; texts with fewer words than a shingle are one shingle; a NULL doc_id
is never a component's name unless all its members' ids are NULL; repeated rows
each get a row; other columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

RADIUS = 1
BLOCK = 4096
PAIRS_AT_ONCE = 1 << 19
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint (unsigned)."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i: i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int = 4, name: str = "fp") -> DataFrame:
    """The documents with the fingerprint as a signed long."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]
                          + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def parts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each part of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def hamming_bits(width: int) -> int:
    """Check bits of the Hamming code used on a part: the longest code of 15 or 7 bits that fits."""
    return 4 if width >= 15 else 3 if width >= 7 else 0


def syndrome(word: Column, checks: int) -> Column:
    """Number of the one low bit to flip to reach a code word (0: none).  Bit i of the code has number i + 1."""
    out = F.lit(0)
    for k in range(checks):
        mask = sum(1 << i for i in range((1 << checks) - 1) if (i + 1) >> k & 1)
        out = out + F.shiftleft((F.bit_count(word.bitwiseAND(F.lit(mask))) % 2).cast("int"), k)
    return out


def flips(width: int, checks: int, reach: int) -> list[list[int]]:
    """By syndrome: the bit patterns of at most ``reach`` bits that lead from a word to an anchor."""
    code = (1 << checks) - 1
    out: list[list[int]] = [[] for _ in range(1 << checks)]
    for n in range(reach + 1):
        for bits in combinations(range(width), n):
            s = 0
            for i in bits:
                if i < code:
                    s ^= i + 1
            out[s].append(sum(1 << i for i in bits))
    return out


def anchored(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fp`` -> (part, anchor, home, fp): every fingerprint at its home anchor and at all anchors it is replicated to."""
    rows = None
    for k, (shift, width) in enumerate(parts(blocks)):
        checks = hamming_bits(width)
        word = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        reach = RADIUS + distance // blocks
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in flips(width, checks, reach)])
        to_home = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range((1 << checks) - 1))]])
        base = fps.select("fp", word.alias("word"), syndrome(word, checks).alias("syndrome"))
        home = base.select(F.lit(k).alias("part"), F.col("word").bitwiseXOR(F.get(to_home, F.col("syndrome"))).alias("anchor"),
                           F.lit(True).alias("home"), "fp")
        replicas = (base.select("word", "fp", F.explode(F.get(table, F.col("syndrome"))).alias("flip"))
                    .select(F.lit(k).alias("part"), F.col("word").bitwiseXOR(F.col("flip")).alias("anchor"),
                            F.lit(False).alias("home"), "fp"))
        both = home.unionByName(replicas)
        rows = both if rows is None else rows.unionByName(both)
    return rows


class Forest:
    """Union-find over fingerprints; keeps the links that joined something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def add(self, pairs: tuple[list[int], list[int]]) -> None:
        for a, b in zip(*pairs):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.append((a, b))


def near_pairs(group: np.ndarray, home: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[list, list]]:
    """Pairs (home, replica) of the same group at most ``distance`` bits apart, home the smaller; rows sorted by group."""
    first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    size = np.diff(first)
    of_row = np.repeat(np.arange(len(size)), size)
    homes, others = np.flatnonzero(home), np.flatnonzero(~home)
    held = np.bincount(of_row[others], minlength=len(size))
    begin = np.concatenate([[0], np.cumsum(held)[:-1]])
    many = held[of_row[homes]]
    cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS_AT_ONCE, int(many.sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    for a, b in zip(np.concatenate([[0], cuts[:-1] + 1]), np.minimum(cuts + 1, len(homes))):
        some, n = homes[a:b], many[a:b]
        left = np.repeat(fp[some], n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        right = fp[others[np.repeat(begin[of_row[some]], n) + within]]
        near = (np.bitwise_count((left ^ right).view(np.uint64)) <= distance) & (left < right)
        yield left[near].tolist(), right[near].tolist()


def links(fps: DataFrame, distance: int = 4, blocks: int = 3) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) between fingerprints at most ``distance`` bits apart that connect all that do link."""
    rows = anchored(fps, distance, blocks)
    # anchors that hold more than a block: their homes and replicas are parted, and every two parts meet
    big = stage(rows.groupBy("part", "anchor").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("replicas"))
                .where((F.col("homes") > BLOCK) | (F.col("replicas") > BLOCK))
                .select("part", "anchor", F.ceil(F.col("homes") / BLOCK).cast("int").alias("h"),
                        F.ceil(F.col("replicas") / BLOCK).cast("int").alias("r")), "big-anchors")
    of = lambda n: F.pmod(F.xxhash64("fp"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    split = (rows.join(big, ["part", "anchor"], "left").fillna(1, ["h", "r"])
             .select("part", "anchor", "home", "fp", "h", "r",
                     F.explode(F.when(F.col("home"), every(F.col("r"))).otherwise(every(F.col("h")))).alias("other"))
             .select("part", "anchor",
                     F.when(F.col("home"), of(F.col("h"))).otherwise(F.col("other")).alias("x"),
                     F.when(F.col("home"), F.col("other")).otherwise(of(F.col("r"))).alias("y"), "home", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            forest, group = Forest(), table.column("group").to_numpy()
            for pairs in near_pairs(group, table.column("home").to_numpy(), table.column("fp").to_numpy(), distance):
                forest.add(pairs)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in forest.kept], pa.int64()),
                                               pa.array([b for _, b in forest.kept], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = table.column("group")[-1].as_py()
            whole = int(np.searchsorted(table.column("group").to_numpy(), last))  # the last group may go on
            if whole >= 1 << 15:
                yield solve(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    group = F.xxhash64("part", "anchor", "x", "y").alias("group")
    return (split.select(group, "home", "fp").repartition("group").sortWithinPartitions("group")
            .mapInArrow(run, "a long, b long").distinct())


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) over the undirected links (a, b): label is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours', then the
    label of that label, so a chain's length is more than halved by a round.
    """
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    linked = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    labels = stage(linked, "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        step = (labels.join(near, labels["node"] == near["a"])
                .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        # what the old label's node now points to is also reachable
        root = step.select(F.col("node").alias("r_node"), F.col("label").alias("r_label"))
        jump = (step.join(root, step["label"] == root["r_node"])
                .select("node", "old", F.least("label", "r_label").alias("label")))
        done = stage(jump, "labels")
        labels = done.select("node", "label")
        if done.where(F.col("old") != F.col("label")).isEmpty():
            break
    alone = nodes.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.unionByName(alone)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    prints = _prints(docs, shingle)
    named = _named(prints, distance, blocks).select(F.col("node").alias("c_fp"), "component_id")
    return (prints.join(named, prints["fp"] == named["c_fp"])
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    return stage(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")


def _named(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``node`` (a fingerprint), the component's id, and the fingerprint that the document of that id has."""
    # one row per fingerprint: its smallest id; copies are counted out before the shuffle
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    fps = classes.select("fp")
    labels = components(links(fps, distance, blocks), fps.select(F.col("fp").alias("node")))
    of_fp = labels.join(classes, labels["node"] == classes["fp"]).select("node", "label", "least_id")
    least = of_fp.groupBy("label").agg(
        F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("least"))
    return of_fp.join(least, "label").select("node", F.col("least.least_id").alias("component_id"),
                                             F.col("least.node").alias("keeper_fp"))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 3) -> DataFrame:
    """One document of each component, all columns: the one with the smallest id.

    Of several rows with that id the one with the smallest fingerprint, then text, stays; a component without any id
    keeps its row with the smallest fingerprint, then text.
    """
    prints = _prints(docs, shingle)
    keepers = (_named(prints, distance, blocks).where(F.col("node") == F.col("keeper_fp"))
               .select(F.col("component_id").alias("k_id"), F.col("keeper_fp").alias("k_fp")))
    if prints.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.join(keepers, docs["doc_id"] == keepers["k_id"], "left_semi")
    rows = with_fingerprint(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), shingle)
    return (rows.join(keepers, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("fp") == F.col("k_fp")), "left_semi")
            .groupBy("doc_id", "fp").agg(F.min_by("row", F.struct(F.col("text").isNotNull(), "text")).alias("row"))
            .select("row.*"))


__all__ = ["components", "fingerprint", "keep_one", "links", "near_duplicates", "with_fingerprint"]
