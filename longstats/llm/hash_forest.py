"""Approximate nearest neighbours by a forest of hash prefixes.

Every vector gets one long string of random-hyperplane bits per tree; a tree is
the sorted array of its strings.  Largest inner products become smallest angles
by one more coordinate that brings all vectors to the same length (the query's is 0).

A query descends each tree to the nodes along its own string: the prefix of
length L names the run of the sorted array that shares L bits with it.  It then
ascends in all trees at once, from the longest prefix to shorter ones, until the
nodes of that length together hold enough vectors.  Node sizes come from
one count per tree and longest prefix, summed upward.  Enough is what the data
need: ``SAMPLE`` queries are compared with all vectors, and the number is the
smallest with which their own ascents would hold ``RECALL`` of their k nearest
(``candidates``, which also sets how deep the trees go, is only its lower end).  The query is compared
with all vectors of its nodes: nothing is cut off, and a node with many vectors is
worked in blocks (``BLOCK`` vectors by ``BLOCK`` queries), so no task holds more.

Equal vectors are one class in the index; at the end a class stands for its
members with the smallest ids, of which k + 1 are enough.

Defined results: vectors that are NULL, empty or zero, or that hold NULL or
non-finite components, and rows with a NULL id take no part; rows with the same id are
rows of their own, each with its list, and candidates for each other; vectors are compared only with
vectors of as many components; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

TREES = 12
CANDIDATES = 2_000
BITS = 24
BLOCK = 4096
SEED = 20
SAMPLE = 128
RECALL = 0.97


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, x array<double>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    ok = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
          & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
          & F.exists(x, lambda v: v != 0.0))
    # -0.0 and 0.0 are the same component
    return (vectors.where(ok).select("vec_id", F.transform(x, lambda v: v + F.lit(0.0)).alias("x"))
            .withColumn("row", F.monotonically_increasing_id()))


def planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((trees * BITS, dim + 1))


def _strings(y: np.ndarray, trees: int) -> np.ndarray:
    """One integer of BITS bits per row and tree, first bit highest."""
    bits = (y @ planes(y.shape[1] - 1, trees).T >= 0).reshape(len(y), trees, BITS)
    return (bits * (1 << np.arange(BITS - 1, -1, -1))).sum(axis=2).astype(np.int32)


def with_strings(classes: DataFrame, longest: float, trees: int) -> DataFrame:
    """``(cid, x)`` -> also ``strings`` (as indexed) and ``asked`` (as a query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            dims = np.diff(rows.offsets.to_numpy())
            flat, at = rows.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                x = flat[at[of][:, None] + np.arange(dim)] / longest
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                extra = np.sqrt(np.maximum(0.0, 1.0 - norm * norm))
                part = batch.take(pa.array(of))
                list_of = lambda v: pa.array(v.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(of), dim, np.int32)),
                     list_of(_strings(np.hstack([x, extra]), trees)),
                     list_of(_strings(np.hstack([x / norm, np.zeros_like(norm)]), trees))],
                    names=["cid", "x", "dim", "strings", "asked"])

    return classes.mapInArrow(run, "cid long, x array<double>, dim int, strings array<int>, asked array<int>")


def _prefix(string: Column, level: Column) -> Column:
    """The first ``level`` bits, with a leading 1 so that prefixes of all lengths differ."""
    return F.expr(f"shiftright({(1 << BITS)} + {string}, {BITS} - {level})")


def enough(shared: dict[int, list[int]], sizes: dict[int, dict[int, int]], recall: float) -> int:
    """The smallest number of candidates with which ascents hold ``recall`` of the sampled queries' neighbours.

    Per query the longest prefix it shares in any tree with each of its neighbours, and by length what its nodes hold.
    """
    total = sum(map(len, shared.values()))
    options = sorted({n for of in sizes.values() for n in of.values()})
    for number in options:
        hits = 0
        for q, lengths in shared.items():
            stop = max((level for level, n in sizes.get(q, {}).items() if n >= number), default=0)
            hits += sum(length >= stop for length in lengths)
        if hits >= recall * total:
            return number
    return options[-1] + 1 if options else 0  # no prefix holds as many: the roots


def _shared_prefixes(index: DataFrame, sample: list, k: int) -> dict[int, list[int]]:
    """Of every sampled query (cid, dim, x, asked) the longest common prefixes with its k nearest other classes."""
    of_dim = {}
    for dim in {r["dim"] for r in sample}:
        rows = [r for r in sample if r["dim"] == dim]
        of_dim[dim] = (np.array([r["cid"] for r in rows]), np.array([r["x"] for r in rows]),
                       np.array([r["asked"] for r in rows], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for dim, (q_cid, q_x, q_asked) in of_dim.items():
                of = np.flatnonzero(dims == dim)
                if not len(of):
                    continue
                part = batch.take(pa.array(of))
                x = part.column(1).flatten().to_numpy().reshape(len(of), dim)
                strings = part.column(3).flatten().to_numpy().reshape(len(of), -1).astype(np.int64)
                score = q_x @ x.T
                score[q_cid[:, None] == cid[of][None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                q, v = np.repeat(np.arange(len(q_cid)), best.shape[1]), best.ravel()
                keep = np.isfinite(score[q, v])
                q, v = q[keep], v[keep]
                # leading bits that agree: what the highest differing bit leaves
                shared = BITS - np.frexp((q_asked[q] ^ strings[v]).astype(np.float64))[1].min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_cid[q]), pa.array(cid[of][v]), pa.array(score[q, v]), pa.array(shared.astype(np.int32))],
                    names=["q_cid", "cid", "score", "shared"])

    found = index.select("cid", "x", "dim", "strings").mapInArrow(run, "q_cid long, cid long, score double, shared int")
    best = Window.partitionBy("q_cid").orderBy(F.desc("score"), "cid")
    out: dict[int, list[int]] = {}
    for r in found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect():
        out.setdefault(r["q_cid"], []).append(r["shared"])
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES,
            candidates: int = CANDIDATES) -> DataFrame:
    """The k nearest of every query row: query_id, rank, vec_id, score (inner product of the original vectors)."""
    rows = stage(valid_vectors(vectors), "vectors")
    classes = rows.groupBy("x").agg(F.min("row").alias("cid"))
    bound = rows.agg(F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))), F.count(F.lit(1))).first()
    longest, n = float(bound[0] or 1.0), int(bound[1])
    index = stage(with_strings(classes.select("cid", "x"), longest, trees), "forest")
    named = rows.join(index.select("cid", F.col("x").alias("c_x")), F.col("x") == F.col("c_x")).select("row", "vec_id", "cid")
    named = stage(named, "members")

    # node sizes: counted at the longest prefix in use, then summed upward
    depth = min(BITS, max(0, math.ceil(math.log2(max(1.0, trees * n / candidates)))) + 6)
    leaves = (index.select("dim", F.posexplode("strings").alias("tree", "s"))
              .groupBy("dim", "tree", F.expr(f"shiftright({1 << BITS} + s, {BITS - depth})").alias("leaf"))
              .agg(F.count(F.lit(1)).alias("m")))
    nodes = (leaves.select("dim", "tree", "m", "leaf", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
             .groupBy("dim", "tree", F.expr(f"shiftright(leaf, {depth} - level)").alias("node"))
             .agg(F.sum("m").alias("size")))
    nodes = stage(nodes, "forest-nodes")

    # the ascent: the longest prefix whose nodes hold enough over all trees (no such prefix: the roots)
    query_classes = named.where(is_query).select(F.col("cid").alias("q_cid")).distinct()
    queries = index.join(query_classes, F.col("cid") == F.col("q_cid")).select("cid", "dim", "x", "asked")
    paths = (queries.select("cid", "dim", F.posexplode("asked").alias("tree", "s"))
             .select("cid", "dim", "tree", "s", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
             .withColumn("node", _prefix("s", "level")))
    sample = queries.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    sizes: dict[int, dict[int, int]] = {}
    for r in (paths.where(F.col("cid").isin([r["cid"] for r in sample])).join(nodes, ["dim", "tree", "node"])
              .groupBy("cid", "level").agg(F.sum("size").alias("size")).collect()):
        sizes.setdefault(r["cid"], {})[r["level"]] = r["size"]
    candidates = max(candidates, enough(_shared_prefixes(index, sample, k), sizes, RECALL))
    totals = (paths.join(nodes, ["dim", "tree", "node"]).groupBy("cid", "level").agg(F.sum("size").alias("size")))
    stops = totals.groupBy("cid").agg(
        F.coalesce(F.max(F.when(F.col("size") >= candidates, F.col("level"))), F.lit(0)).alias("stop"))
    asked = (queries.join(stops, "cid")
             .select("cid", "x", "dim", F.col("stop").alias("level"), F.posexplode("asked").alias("tree", "s"))
             .withColumn("node", _prefix("s", "level")).drop("s"))
    asked = stage(asked, "forest-queries")

    # work: for every node that some query stops at, its vectors against its queries, in blocks
    wanted = (asked.groupBy("dim", "tree", "level", "node").agg(F.count(F.lit(1)).alias("questions"))
              .join(nodes, ["dim", "tree", "node"])
              .select("dim", "tree", "level", "node",
                      F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"),
                      F.ceil(F.col("questions") / BLOCK).cast("int").alias("askers")))
    wanted = stage(wanted, "forest-work")
    levels = wanted.select("dim", "tree", "level").distinct()
    held = (index.select("cid", "x", "dim", F.posexplode("strings").alias("tree", "s"))
            .join(levels, ["dim", "tree"]).withColumn("node", _prefix("s", "level"))
            .join(wanted, ["dim", "tree", "level", "node"])
            .select("cid", "x", "dim", "tree", "node", F.lit(False).alias("asks"),
                    F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"),
                    F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker")))
    asks = (asked.join(wanted, ["dim", "tree", "level", "node"])
            .select("cid", "x", "dim", "tree", "node", F.lit(True).alias("asks"),
                    F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                    F.pmod(F.xxhash64("cid"), "askers").cast("int").alias("asker")))
    most = k + 1

    def compare(table):
        asks = table.column("asks").to_numpy()
        cid = table.column("cid").to_numpy()
        flat = table.column("x").combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(cid), -1)
        q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(q), 512):
            some = q[a: a + 512]
            if not len(v):
                break
            score = x[some] @ x[v].T
            if len(v) > most:  # all at or above the last kept score, so that ties stay
                last = np.partition(score, len(v) - most, axis=1)[:, len(v) - most]
                near, who = np.nonzero(score >= (last - 1e-9 * np.maximum(1.0, np.abs(last)))[:, None])
            else:
                near, who = np.nonzero(np.ones_like(score, bool))
            out_q.append(cid[some[near]])
            out_v.append(cid[v[who]])
            out_s.append(np.einsum("ij,ij->i", x[some[near]], x[v[who]]))
        return pa.table({"q_cid": np.concatenate(out_q), "cid": np.concatenate(out_v), "score": np.concatenate(out_s)})

    found = (held.unionByName(asks).groupBy("dim", "tree", "node", "part", "asker")
             .applyInArrow(compare, "q_cid long, cid long, score double"))
    first = named.groupBy("cid").agg(F.min("vec_id").alias("first_id"))
    best = Window.partitionBy("q_cid").orderBy(F.desc("score"), "first_id", "cid")
    found = (found.groupBy("q_cid", "cid").agg(F.max("score").alias("score")).join(first, "cid")
             .withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("q_cid", "cid", "score"))
    # back to rows: of every class the members with the smallest ids, of every query class its k + 1 nearest rows
    member = Window.partitionBy("cid").orderBy("vec_id", "row")
    members = named.withColumn("r", F.row_number().over(member)).where(F.col("r") <= most).select("cid", "vec_id", "row")
    nearest_row = Window.partitionBy("q_cid").orderBy(F.desc("score"), "vec_id", "row")
    near = (found.join(members, "cid").withColumn("r", F.row_number().over(nearest_row))
            .where(F.col("r") <= most).select("q_cid", "vec_id", "row", "score", "r"))
    return _for_rows(near, named.where(is_query), k)


def _for_rows(near: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every query row's list: its class's list without the row itself.

    A class's k + 1 nearest rows hold at most one row of the query itself, so the place among the others follows
    from the place in the list.
    """
    rows = queries.select(F.col("vec_id").alias("query_id"), F.col("row").alias("q_row"), F.col("cid").alias("of"))
    own = (near.join(rows, (F.col("q_cid") == F.col("of")) & (F.col("row") == F.col("q_row")))
           .select(F.col("q_row").alias("own_row"), F.col("r").alias("own_r")))
    return (near.join(rows, F.col("q_cid") == F.col("of"))
            .join(own, F.col("q_row") == F.col("own_row"), "left")
            .where(F.col("row") != F.col("q_row"))
            .withColumn("rank", (F.col("r") - (F.coalesce("own_r", F.lit(1 << 30)) < F.col("r")).cast("int")).cast("int"))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


__all__ = ["nearest", "valid_vectors"]
