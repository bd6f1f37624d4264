"""Shapes of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from catalog import bindings as b
from catalog.queries import QUERIES
from surveyloom.functions import levels as lv
from surveyloom.operators import grids as gr
from surveyloom.operators import joins as jo
from surveyloom.operators import likert as lk
from surveyloom.operators import shares as sh
from surveyloom.operators.counts import count_rows
from surveyloom.operators.losses import Losses
from surveyloom.plans import survey as sv

SF_DIR = "/root/testdata/sf0.001"
#: These run a write before their plan can be seen.
SINKS = {"sink_csv", "sink_csv_indexed", "sink_partitioned", "sink_replace_partitions", "src_sound_and_rejected",
         "range_censor_losses", "qd_species_losses", "qe_gear_rotation_losses", "bbox_clustered"}


def plan(df, run=False):
    """The physical plan, after it ran with its final adaptive shape if asked for."""
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def shuffles(text):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (hash|range|Single|Round)", re.sub(r"ReusedExchange.*", "", text)))


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SINKS))
def test_no_python_and_no_product(spark, key):
    text = plan(QUERIES[key](spark, SF_DIR))
    for node in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text, f"{node} in the plan of {key}"


def test_level_counts_shuffle_once(spark):
    answers = b.answers(spark, SF_DIR)
    counts = lk.level_counts(answers, b.ITEMS, b.LEVELS, ["id"], mapping=b.ANSWERS)
    for df in (lk.level_shares(counts, b.LEVELS), lk.mean_sd(counts, 5), lk.centered_offsets(counts, b.LEVELS)):
        assert shuffles(plan(df)) == 1


def test_shares_read_the_raw_rows_once(spark):
    orders = b.table(spark, SF_DIR, "orders")
    share = sh.share_in_group(count_rows(orders, "o_orderstatus", "o_orderpriority"), "n", ["o_orderstatus"])
    text = plan(share, run=True)
    assert "ReusedExchange" in text and text.count("FileScan") == 1
    donut = sh.pie_donut(orders, [], "o_orderstatus", "o_orderpriority", within_answer=True)
    assert "ReusedExchange" in plan(donut, run=True)


def test_completion_reads_the_raw_rows_once(spark):
    orders = b.table(spark, SF_DIR, "orders")
    cells = count_rows(orders, "o_orderstatus", "o_orderpriority")
    text = plan(gr.complete_cells(cells, ["o_orderstatus"], "o_orderpriority", b.PRIORITY_LEVELS))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_pivot_shuffles_once(spark):
    from surveyloom.operators.reshape import pivot_wide

    orders = b.table(spark, SF_DIR, "orders").withColumn("one", F.lit(1))
    assert shuffles(plan(pivot_wide(orders, ["o_custkey"], "o_orderpriority", "one", b.PRIORITIES))) == 1


def test_densify_does_not_shuffle_the_facts(spark):
    dense = gr.densify(b.trips(spark, SF_DIR), ["id"], "mes", [str(m) for m in range(1, 12)])
    text = plan(dense)
    assert shuffles(text) == 1
    assert "Join" not in text


def test_zone_filter_reaches_the_scan(spark):
    nation = b.table(spark, SF_DIR, "nation")
    for zone in ("North", "otro"):
        text = nation.filter(lv.belongs_to(F.col("n_name"), b.ZONES, zone, b.OTHER))._jdf.queryExecution().executedPlan().toString()
        pushed = re.search(r"PushedFilters: \[(.*?), ReadSchema", text).group(1)
        assert "n_name" in pushed


def test_zone_query_filters_at_the_scan(spark):
    pushed = re.findall(r"PushedFilters: \[(.*?), ReadSchema", plan(queries()["zone_filter_pushdown"](spark, SF_DIR)))
    assert sum("In(n_name" in p for p in pushed) == 2


@pytest.mark.parametrize("key", ["qe_gear_rotation", "qe_gear_rotation_parity"])
def test_rotation_sums_before_it_joins(spark, key):
    """One read of the trips, and the join meets a row for each key: a hot key is summed before."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()[key](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"FileScan parquet \[o_", text)) == 1
    below = text[text.index("Join [id"):]
    assert below.index("Aggregate") < below.index("FileScan parquet [o_")


@pytest.mark.parametrize("key", ["qb_likert_by_zone", "qc_heatmap_cells"])
def test_answers_are_counted_before_they_are_joined(spark, key):
    """One read of the answers, and a row of counters per respondent and task is what a shuffle to the join moves."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()[key](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"FileScan parquet \[l_", text)) == 1
    join = text.index("SortMergeJoin [id")
    scan = text.index("FileScan parquet [l_")
    between = text[join:scan]
    assert between.count("HashAggregate") >= 2  # counted per task, shuffled, counted per respondent
    assert between.index("Exchange") < between.rindex("HashAggregate")


def test_long_completion_reads_once(spark):
    cells = count_rows(b.table(spark, SF_DIR, "lineitem"), "l_suppkey", "l_partkey")
    levels = [str(i) for i in range(3000)]
    done = gr.complete_cells(cells.withColumn("part", F.col("l_partkey").cast("string")), ["l_suppkey"], "part", levels)
    text = plan(done)
    assert text.count("FileScan") == 1 and "Join" not in text
    assert "INSET" in text.upper() or "INSET" in done._jdf.queryExecution().optimizedPlan().toString().upper()


def test_observed_completion_reads_once(spark):
    lines = b.table(spark, SF_DIR, "lineitem")
    done = gr.complete_observed(count_rows(lines, "l_suppkey", "l_returnflag"), ["l_suppkey"], "l_returnflag")
    text = plan(done, run=True)
    assert text.count("FileScan") == 1 and "ReusedExchange" in text


def test_losses_need_no_second_read(spark):
    losses = Losses()
    result = sv.gear_rotation(b.trips(spark, SF_DIR), sv.Places(b.customer_profile(spark, SF_DIR), "id", "port", b.ZONES, b.OTHER, "zona"),
                              "mes", b.GEARS, b.MONTHS, losses=losses)
    text = plan(result, run=True)
    assert len(re.findall(r"FileScan parquet \[o_", text)) == 1 and "CollectMetrics" in text
    assert losses.rows() == [("rotation", "month not listed", b.table(spark, SF_DIR, "orders").count(), 0)]


def test_only_needed_columns_are_read(spark):
    text = plan(queries()["qb_likert_by_zone"](spark, SF_DIR))
    read = [r for r in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_suppkey" in r][0]
    assert set(re.findall(r"(\w+):", read)) == {"l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"}


def test_lookups_are_broadcast(spark):
    text = plan(jo.rollup_lookup(b.customer_profile(spark, SF_DIR), "port", b.ZONES, "zona", b.OTHER))
    assert text.count("BroadcastHashJoin") >= 1


def test_hot_join_key_is_split(spark, rows):
    """A third of the answers belongs to one respondent; adaptive execution splits that partition."""
    facts = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("ID"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"))
    profile = spark.range(300_000).select(F.col("id").alias("ID"), (F.col("id") % 20).cast("string").alias("port"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        zoned = sv.Places(profile, "ID", "port", {"even": [str(i) for i in range(0, 20, 2)]}, "otro", "zona").attach(facts)
        df = zoned.groupBy("zona").agg(F.count("note").alias("n"))
        got = rows(df)
        assert "skew=true" in plan(df)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    evens = sum(1 for i in range(300_000) if i % 3 and i % 2 == 0)
    assert got == [("even", evens), ("otro", 300_000 - evens)]
