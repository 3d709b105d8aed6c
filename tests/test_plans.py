"""Physical-plan properties: pushdown and pruning reach the scan, class lists are
broadcast after AQE measures them, totals avoid single-partition windows."""

import pytest

from longstats.plans import catalog
from longstats.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df, executed=False):
    if executed:
        df.collect()
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_core_scan_prunes_partitions_and_columns(spark):
    df = QUERIES["rollup_level"](spark, SF)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan and ">= 1996" in plan
    assert "PushedFilters: [" in plan and "EqualTo(agg_level_desc,STATE)" in plan
    assert "freq_desc" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_class_lists_are_broadcast_by_their_size(spark):
    from longstats.operators import clean_levels, core_scope
    core = core_scope(catalog.long_table(spark, SF), min_year=1996)
    job = clean_levels(core)
    # the materialised roll-up already holds the anti join; consumers only scan it
    assert "Join" not in _plan(job.known_county, executed=True)
    state = _plan(job.clean_state)
    assert "BroadcastHashJoin LeftSemi" in state
    assert "PartitionFilters: [isnotnull(agg_level_desc" in state


@pytest.mark.parametrize("name", ["drop_redundant_totals", "keep_known_classes", "classes_of_varied", "rollup_state"])
def test_no_raw_rows_are_shuffled_by_class(spark, name):
    """With the threshold below every unwritten aggregate's estimate (the situation at scale), the raw rows still
    cross no exchange on commodity or class before the join: the lists' real sizes are known."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    catalog.clean_job(spark, SF, 1996)
    spark.conf.set(key, "20000")
    try:
        df = QUERIES[name](spark, SF)
        tree = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    lines = tree.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" not in line:
            continue
        # what is exchanged is the output of a partial aggregate
        below = next(x for x in lines[i + 1:] if "AQEShuffleRead" not in x and "InputAdapter" not in x and "WholeStage" not in x)
        assert "partial_" in below or "HashAggregate" in below, (name, line, below)


def test_trend_filter_reaches_the_scan(spark):
    plan = _plan(QUERIES["yield_trend"](spark, SF))
    assert "EqualTo(commodity_name,Soybeans)" in plan


def test_totals_use_aggregate_join_not_window(spark):
    for name in ("grand_total", "partition_total", "partition_total_state"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "Window" not in plan, name


def test_trend_shuffles_on_year_only(spark):
    plan = _plan(QUERIES["yield_trend"](spark, SF))
    assert "partial_sum" in plan
    tree = QUERIES["yield_trend"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    top = [x for x in tree.splitlines() if "Exchange" in x and "Broadcast" not in x][:2]
    assert "rangepartitioning(year" in top[0] and "hashpartitioning(year" in top[1]


def test_sparse_listing_is_split_by_all_columns(spark):
    tree = QUERIES["distinct_combos"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "value" in next(x for x in tree.splitlines() if "rangepartitioning" in x)


def test_job_queries_never_funnel_into_one_partition(spark):
    job_queries = ["classify_units", "effective_class", "drop_redundant_totals", "rollup_county", "rollup_state",
                   "rollup_national", "rollup_level", "residual_full", "residual_left", "tidy_table", "tidy_union",
                   "yield_trend", "yield_trend_converted", "reconcile_levels"]
    for name in job_queries:
        plan = _plan(QUERIES[name](spark, SF), executed=True)
        assert "SinglePartition" not in plan, name
        assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_fixture_shuffles_lineitem_once_on_the_order_key(spark):
    from longstats.plans.fixture import long_view
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with orders too large to broadcast
    try:
        tree = long_view(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    # lineitem meets orders in a join that spills; no hash table is forced
    assert "ShuffledHashJoin" not in tree and tree.count("Exchange hashpartitioning(l_orderkey") == 1


def test_landing_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """Before: the number followed the shuffled bytes or the setting, so a task's sort grew with the table."""
    from longstats.plans import fixture
    spark.range(2000).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "CAST(id AS double) AS l_extendedprice",
                                 "CURRENT_TIMESTAMP() AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(2000).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(2000).selectExpr("id AS c_custkey", "1 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(2).selectExpr("CAST(id AS int) AS n_nationkey", "'X' AS n_name").write.parquet(str(tmp_path / "nation.parquet"))
    monkeypatch.setattr(fixture, "ROWS_PER_TASK", 10)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as at size, where lineitem is shuffled
    try:
        view = fixture.long_view(spark, str(tmp_path))
        assert view.count() == 2000
        # the driver's plan asks for more tasks than the setting's, one per ten rows
        assert "REPARTITION_BY_NUM" in view._jdf.queryExecution().executedPlan().toString()
        assert view.rdd.getNumPartitions() == max(200, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set(threshold, before)
