"""Mixing sources to target weights by a time-varying curriculum (native).

Every source has a weight schedule over training time ``t`` in [0, 1]: a
piecewise-linear curve given by knots.  Its integral is the source's weight.
All words of the input are shared out by those weights; a target stops at
``max_repeat`` times its source's size and the excess goes to the others by
weight until none is above (water filling).

The documents of a source are read in a fixed shuffled order (by the MD5 of
the id), over and over, until the target is met; the last one is cut at the
target, so a source's taken words equal its rounded target.  A copy that
begins after a share ``u`` of the source's target is trained at the time when
the source's cumulative demand reaches ``u``: the integral of the schedule,
inverted.  Documents are then range-sorted by position.

No source is ever gathered in one task: the running total inside a source is
taken over ``buckets`` slices of the hash order, and only the per-slice sums
(sources x buckets rows) are accumulated over a source.

Defined results: NULL text has size 0 and is taken 0 times; a NULL source is a
source of its own, last in order; a source without words has target 0; an
empty table gives an empty result; repeated rows count as separate documents;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

Knots = Sequence[tuple[float, float]]

#: Weights 1, 2, 3 repeating over the sources in order; the curve falls, stays or rises, its integral is the weight.
DEFAULT_SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 1.5), (0.5, 3.0), (1.0, 4.5)),
)


def integral(knots: Knots) -> float:
    """Area under a piecewise-linear curve."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _check(knots: Knots) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0.0 or times[-1] != 1.0 or times != sorted(set(times)):
        raise ValueError("a schedule needs increasing knots from t=0 to t=1")
    if min(w for _, w in knots) < 0 or integral(knots) <= 0:
        raise ValueError("a schedule needs weights of at least 0 and a positive integral")


def inverse_demand(share: Column, knots: Knots) -> Column:
    """The time at which the schedule has used ``share`` of its integral (closed form per segment)."""
    area, out = share * F.lit(integral(knots)), None
    for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:]))):
        begin = integral([k for k in knots if k[0] <= t0]) if t0 > 0 else 0.0
        rest = F.greatest(area - F.lit(begin), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        # 2c / (b + sqrt(b^2 + 2ac)) holds for rising, flat and falling segments
        step = F.when(root + F.lit(w0) > 0, F.lit(2.0) * rest / (root + F.lit(w0))).otherwise(F.lit(0.0))
        out = (F if out is None else out).when(area >= F.lit(begin), F.least(F.lit(t0) + step, F.lit(t1)))
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Knots] = DEFAULT_SCHEDULES, max_repeat: int = 3) -> DataFrame:
    """``(source, source_size)`` -> also ``rank``, ``weight`` and ``target``, by water filling.

    One row per source goes in.  A source is full when its cap over its weight
    is at most the level that the sources above it would share.
    """
    n = len(schedules)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.lit(float(integral(schedules[-1])))
    for i, knots in reversed(list(enumerate(schedules[:-1]))):
        weight = F.when(F.col("rank") % n == i, F.lit(float(integral(knots)))).otherwise(weight)
    ranked = (sizes.withColumn("rank", F.row_number().over(by_name) - 1)
              .withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * F.lit(max_repeat)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(rest))
    # shares only rise while sources fill up, so the first source that is not full fixes the level of all after it
    open_ = F.col("cap") > F.col("share") * F.col("weight")
    return (ranked.withColumn("share", share)
            .withColumn("level", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "rank", "share")))
                        .over(everything)["share"])
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double"))
                        .otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))))
            .select("source", "source_size", "rank", "weight", "target"))


def plan_mix(docs: DataFrame, schedules: Sequence[Knots] = DEFAULT_SCHEDULES, max_repeat: int = 3,
             bucket_digits: int = 3) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken`` and ``copies``, an array of
    (position, words) with one entry per copy that the mix takes.

    ``bucket_digits`` hex digits of the hash make the slices (3: 4,096 a source).
    """
    for knots in schedules:
        _check(knots)
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order_key"))
    base = base.withColumn("slice", F.substring("order_key", 1, bucket_digits))
    # the small table: one row per source and slice
    slices = base.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")),
                             schedules, max_repeat)
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
               .join(targets.withColumnRenamed("source", "t_source"),
                     F.col("source").eqNullSafe(F.col("t_source")))
               .select(F.col("source").alias("o_source"), F.col("slice").alias("o_slice"), "slice_start",
                       "source_size", "rank", "target"))
    inside = (Window.partitionBy("source", "slice").orderBy("order_key", F.col("doc_id").asc_nulls_last(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (base.withColumn("in_slice", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
              .withColumn("start", F.col("slice_start") + F.col("in_slice"))
              .withColumn("goal", F.round("target").cast("long")))

    def words(e: int) -> Column:
        left = F.col("goal") - F.lit(e) * F.col("source_size") - F.col("start")
        return F.greatest(F.least(left, F.col("size")), F.lit(0))

    def position(e: int) -> Column:
        share = (F.lit(e) * F.col("source_size") + F.col("start")).cast("double") / F.col("target")
        n, at = len(schedules), inverse_demand(share, schedules[-1])
        for i, knots in reversed(list(enumerate(schedules[:-1]))):
            at = F.when(F.col("rank") % n == i, inverse_demand(share, knots)).otherwise(at)
        return F.round(at, 9)

    copies = F.array(*[F.when(words(e) > 0, F.struct(position(e).alias("position"), words(e).alias("words")))
                       for e in range(max_repeat)])
    taken = words(0)
    for e in range(1, max_repeat):
        taken = taken + words(e)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
                         F.array_compact(copies).alias("copies"))


def curriculum(plan: DataFrame) -> DataFrame:
    """The training order: one row per copy, range-sorted by position (ties by id)."""
    return (plan.select("doc_id", "source", F.explode("copies").alias("c"))
            .select("doc_id", "source", F.col("c.position").alias("position"), F.col("c.words").alias("words"))
            .orderBy("position", "doc_id"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document with the position of its first copy (NULL: not taken), range-sorted by it."""
    return (plan_mix(docs, **options)
            .withColumn("position", F.get("copies", 0)["position"])
            .select("doc_id", "size", "source_size", "target", "taken", "position")
            .orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()))
