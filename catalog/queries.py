"""One query per operator and per analysis: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import bindings as b
from surveyloom.functions import levels as lv
from surveyloom.functions import text as tx
from surveyloom.operators import columns as co
from surveyloom.operators import counts as ct
from surveyloom.operators import grids as gr
from surveyloom.operators import joins as jo
from surveyloom.operators import likert as lk
from surveyloom.operators import ordering as od
from surveyloom.operators import points as pt
from surveyloom.operators import reshape as rs
from surveyloom.operators import rows as rw
from surveyloom.operators import shares as sh
from surveyloom.operators.losses import Losses
from surveyloom.plans import survey as sv
from surveyloom.session import shared_folder
from surveyloom.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _zoned_customers(spark, d) -> DataFrame:
    return b.customer_profile(spark, d).withColumn("zona", lv.rollup(F.col("port"), b.ZONES, b.OTHER))


def _customers(spark, d) -> sv.Places:
    return sv.Places(b.customer_profile(spark, d), "id", "port", b.ZONES, b.OTHER, "zona")


def _suppliers(spark, d) -> sv.Places:
    return sv.Places(b.supplier_profile(spark, d), "id", "port", b.ZONES, b.OTHER, "zona")


def _zoned_opinions(spark, d) -> DataFrame:
    return _customers(spark, d).attach(b.opinions(spark, d))


def _level_answers(spark, d) -> DataFrame:
    return co.apply_columns(b.answers(spark, d), b.ITEMS, lv.answer_level(b.ANSWERS, b.LEVELS))


def _zone_item_counts(spark, d) -> DataFrame:
    return sv.likert_by_zone(b.answers(spark, d), _suppliers(spark, d), b.ITEMS, b.ANSWERS, b.LEVELS)


# ---- sources and sinks -------------------------------------------------------------------

@query
def src_load_all(spark, d):
    return tables.table_sizes({name: spark.table(name) for name in tables.load_all(spark, d)})


@query
def src_load_table(spark, d):
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return tables.load_table(spark, d, "customer", schema)


@query
def src_inline_table(spark, d):
    inline = jo.literal_table(spark, "o_orderpriority string, ordinal int",
                              [(p, i) for i, p in enumerate(b.PRIORITY_LEVELS, start=1)])
    counts = ct.count_rows(b.table(spark, d, "orders"), "o_orderpriority")
    joined = jo.left_join(inline.withColumn("Decrease", F.lit(0)), counts, "o_orderpriority")
    return joined.select("o_orderpriority", "ordinal", "Decrease", F.coalesce("n", F.lit(0)).alias("n"))


def _customer_texts(spark, d) -> DataFrame:
    segment = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None))
               .when(F.col("c_mktsegment") == "FURNITURE", F.lit("NA"))
               .when(F.col("c_mktsegment") == "MACHINERY", F.lit("")).otherwise(F.col("c_mktsegment")))
    remark = F.concat(F.lit('He said "'), F.col("c_name"), F.lit('", twice'))
    return b.table(spark, d, "customer").select("c_custkey", segment.alias("segment"), remark.alias("remark"),
                                                "c_acctbal")


def _order_lines(spark, d) -> DataFrame:
    """Orders as lines of CSV, some of them spoiled: a text for a number, a field too many, and one too few."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    kind = F.col("o_orderkey") % 41
    priority = F.when(kind == 5, "").when(kind == 6, F.lit('"a, b"')).otherwise(F.col("o_orderpriority"))
    line = (F.when(kind == 1, F.concat_ws(",", key, F.lit("unknown"), priority))
            .when(kind == 2, F.concat_ws(",", key, price, priority, F.lit("more")))
            .when(kind == 3, F.concat_ws(",", key, price))
            .when(kind == 4, F.concat_ws(",", F.concat(F.lit("k"), key), price, priority))
            .otherwise(F.concat_ws(",", key, price, priority)))
    return b.table(spark, d, "orders").select(line.alias("line"))


@query
def src_sound_and_rejected(spark, d):
    path = _scratch(spark, "lines")
    _order_lines(spark, d).write.text(path)
    sound, rejected = tables.load_sound(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string", header=False)
    none = F.lit(None).cast("string")
    return sound.select("*", none.alias("reason"), none.alias("line")).unionByName(
        rejected.select("reason", "line"), allowMissingColumns=True)


@query
def sink_csv(spark, d):
    path = _scratch(spark, "csv")
    sinks.write_csv(_customer_texts(spark, d), path)
    return sinks.read_csv(spark, path, "c_custkey bigint, segment string, remark string, c_acctbal double")


@query
def sink_csv_indexed(spark, d):
    path = _scratch(spark, "csv-indexed")
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    sinks.write_csv_indexed(orders, path, ["o_totalprice", "o_orderkey"])
    return sinks.read_csv(spark, path, "row bigint, o_orderkey bigint, o_totalprice double, o_orderpriority string")


@query
def sink_partitioned(spark, d):
    path = _scratch(spark, "by-zone")
    sinks.write_partitioned(_zoned_customers(spark, d), path, "zona")
    return sinks.read_partitioned(spark, path, "id bigint, port string, zona string")


@query
def sink_replace_partitions(spark, d):
    """Two zones are written again without their places; the others stay as they were."""
    path = _scratch(spark, "replaced")
    zoned = _zoned_customers(spark, d)
    sinks.replace_partitions(zoned, path, "zona")
    again = zoned.filter(F.col("zona").isin("North", "otro") & (F.col("id") % 2 == 0)).withColumn("port", F.lit("again"))
    sinks.replace_partitions(again, path, "zona")
    return sinks.read_partitioned(spark, path, "id bigint, port string, zona string")


@query
def preview_head(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return od.preview(orders, "o_totalprice", "o_orderkey")


@query
def level_domain_report(spark, d):
    return ct.outside_levels(b.answers(spark, d), b.ITEMS, b.RAW_ANSWERS)


def _features(spark, d) -> DataFrame:
    return b.table(spark, d, "events").select(
        "event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), "props")


@query
def bbox_tag_filter(spark, d):
    return pt.in_box_with_tag(_features(spark, d), "x", "y", (5.0, 10.0, 250.0, 120.0), "props", "k", "69").drop("props")


@query
def bbox_clustered(spark, d):
    """The same features from a layout in which a box meets few row groups."""
    path = _scratch(spark, "clustered")
    sinks.write_clustered(_features(spark, d), path, "x", "y")
    stored = spark.read.schema("event_id bigint, x double, y double, props string").parquet(path)
    return pt.in_box_with_tag(stored, "x", "y", (5.0, 10.0, 250.0, 120.0), "props", "k", "69").drop("props")


# ---- projections and filters -------------------------------------------------------------

@query
def project_names(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", "c_mktsegment")


@query
def project_range(spark, d):
    return co.select_range(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity", "l_tax")


@query
def project_drop(spark, d):
    return b.table(spark, d, "customer").drop("c_name", "c_acctbal")


@query
def project_positions(spark, d):
    return co.select_positions(b.table(spark, d, "orders"), 1, range(3, 5), 6)


@query
def drop_by_position(spark, d):
    return co.drop_positions(b.table(spark, d, "part"), 2, range(4, 6))


@query
def rename_one(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "sector")


@query
def rename_all(spark, d):
    return co.set_names(b.table(spark, d, "supplier"), ["id", "Full Name", "Home Port", "Balance"])


@query
def duplicate_headers(spark, d):
    suppliers = b.table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("s_acctbal"))
    return co.unique_names(suppliers)


@query
def relocate_front(spark, d):
    return co.relocate_front(b.table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query
def ratio_percent(spark, d):
    per_supplier = b.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count(F.lit(1)).alias("n_all"))
    return per_supplier.withColumn("percent", lv.ratio(F.col("n_returned"), F.col("n_all")))


@query
def band_numeric(spark, d):
    per_user = b.table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("n"),
        F.count_if(F.col("value") < 50).alias("n_small"), F.count_if(F.col("value") > 150).alias("n_large"))
    return per_user.select(
        "user_id", lv.band(lv.ratio(F.col("n"), F.col("n_small")), 20, 30).alias("band"),
        lv.band(lv.ratio(F.col("n"), F.col("n_large")), 100, 200, ("under", "same", "over")).alias("large_band"))


@query
def rollup_zone(spark, d):
    return _zoned_customers(spark, d)


@query
def rollup_zone_lookup(spark, d):
    return jo.rollup_lookup(b.customer_profile(spark, d), "port", b.ZONES, "zona", b.OTHER)


@query
def zone_filter_pushdown(spark, d):
    """The zone's filter is put on the places as they are stored, before they are looked up."""
    nation = b.table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = b.table(spark, d, "customer")

    def chosen(zone):
        places = nation.filter(lv.belongs_to(F.col("n_name"), b.ZONES, zone, b.OTHER))
        return customer.join(places, "c_nationkey").select(
            F.col("c_custkey").alias("id"), F.nullif(F.col("n_name"), F.lit("NATION_24")).alias("port"), F.lit(zone).alias("zona"))

    return chosen("North").unionByName(chosen(b.OTHER))


PART_OF_PRIORITIES = {"1-URGENT": "Very Negative", "2-HIGH": "Negative", "5-LOW": "Very Positive"}


def _priorities(spark, d) -> DataFrame:
    return b.table(spark, d, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("answer"))


@query
def recode_passthrough(spark, d):
    return _priorities(spark, d).withColumn("answer", lv.recode(F.col("answer"), PART_OF_PRIORITIES))


@query
def recode_lookup(spark, d):
    return jo.recode_lookup(_priorities(spark, d), "answer", PART_OF_PRIORITIES)


@query
def ordered_levels(spark, d):
    answer, listed = F.col("answer"), ["5-LOW", "4-NOT SPECIFIED", "2-HIGH"]
    return _priorities(spark, d).select("o_orderkey", lv.in_levels(answer, listed).alias("level"),
                                        *_ordinal(lv.ordinal(answer, listed)))


def _ordinal(position):
    """The ordinal as it is, INT, with 0 where it is NULL, which a column of its own tells."""
    return F.coalesce(position, F.lit(0)).alias("ordinal"), position.isNull().alias("unlisted")


@query
def ordered_relabel(spark, d):
    flag = F.col("l_returnflag")
    mapping = {"A": "Decrease", "R": "Increase"}
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", lv.relabel(flag, mapping).alias("level"),
        *_ordinal(lv.ordinal(lv.relabel(flag, mapping), list(mapping.values()))))


@query
def apply_columns(spark, d):
    return co.apply_columns(b.answers(spark, d), b.ITEMS, lv.answer_level(b.ANSWERS, b.LEVELS))


@query
def filter_eq(spark, d):
    return b.table(spark, d, "events").filter(F.col("event_type") == "error").select("event_id", "user_id")


@query
def filter_not_na_text(spark, d):
    return rw.drop_na_text(b.opinions(spark, d), "answer", "sub_answer")


@query
def filter_in(spark, d):
    return rw.keep_in(b.table(spark, d, "part"), "p_brand", b.SHORTLIST).select("p_partkey", "p_brand")


@query
def semi_join_list(spark, d):
    debtors = b.table(spark, d, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return rw.keep_listed(b.table(spark, d, "orders"), debtors, "o_custkey").select("o_orderkey", "o_custkey")


@query
def dropna_any(spark, d):
    return rw.drop_incomplete(b.answers(spark, d))


@query
def fill_null(spark, d):
    gears = b.trips(spark, d).groupBy("id", "mes").agg(*[F.sum(g).alias(g) for g in b.GEARS])
    return co.apply_columns(gears, b.GEARS, lambda c: F.coalesce(c, F.lit(0.0)))


@query
def row_sum_flag(spark, d):
    gears = b.trips(spark, d).groupBy("id", "mes").agg(*[F.sum(g).alias(g) for g in b.GEARS])
    return co.flag_empty_rows(gears, b.GEARS, "no_fishing")


def _mirrored(spark, d) -> DataFrame:
    events = b.table(spark, d, "events").select("event_id", "event_type", "value")
    return events.withColumn("value", lv.mirror(F.col("value"), F.col("event_type"), "error"))


@query
def mirror_sign(spark, d):
    return _mirrored(spark, d)


@query
def range_censor(spark, d):
    return rw.censor(_mirrored(spark, d), "value", -60, 60)


@query
def range_censor_report(spark, d):
    return rw.censor_report(_mirrored(spark, d), "value", -60, 60, "event_type")


def _after_run(spark, result: DataFrame, losses: Losses, name: str) -> DataFrame:
    """Write the result, then report what was lost on the way."""
    result.write.parquet(_scratch(spark, name))
    return losses.report(spark)


@query
def range_censor_losses(spark, d):
    losses = Losses()
    return _after_run(spark, rw.censor(_mirrored(spark, d), "value", -60, 60, losses), losses, "censored")


def _coordinates(spark, d) -> DataFrame:
    return b.table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("lon"),
        F.col("embedding")[1].cast("double").alias("lat"))


@query
def make_point(spark, d):
    points = pt.make_point(_coordinates(spark, d), "lon", "lat")
    return points.select("vec_id", F.col("point.x").alias("x"), F.col("point.y").alias("y"),
                         F.col("point.srid").alias("srid"))


@query
def layer_union(spark, d):
    return pt.stack_layers({
        "customers": b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        "suppliers": b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))})


@query
def rescale_area(spark, d):
    per_customer = ct.count_rows(b.table(spark, d, "orders"), "o_custkey", name="n_orders")
    return pt.rescale_area(per_customer, "n_orders", "size")


# ---- joins and grids ---------------------------------------------------------------------

@query
def left_join_one(spark, d):
    profile = b.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return jo.left_join(b.table(spark, d, "orders").select("o_orderkey", "o_custkey"), profile, "o_custkey")


@query
def left_join_nullsafe(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(5)).cast("string").alias("id"))
    profile = b.table(spark, d, "customer").select(F.nullif(F.col("c_custkey"), F.lit(5)).cast("string").alias("id"), "c_mktsegment")
    return jo.left_join(orders, profile, "id", null_safe=True)


@query
def left_join_composite(spark, d):
    events = b.table(spark, d, "events")
    # Shifted by one user, so that some keys have no partner.
    large = events.groupBy((F.col("user_id") + 1).alias("user_id"), "event_type").agg(F.max("value").alias("largest"))
    return jo.left_join(events.select("event_id", "user_id", "event_type"), large, ["user_id", "event_type"])


@query
def merge_left_suffix(spark, d):
    left = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    right = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("amount"))
    return jo.merge_left(left, right, "id")


def _monthly(spark, d) -> DataFrame:
    orders = b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), lv.relabel(F.month("o_orderdate").cast("string"), b.MONTHS).alias("mes"))
    return ct.count_rows(orders, "id", "mes").withColumn("n", F.col("n").cast("double"))


@query
def key_grid(spark, d):
    return gr.key_grid(b.table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), ["id"], "mes",
                       list(b.MONTHS.values()))


@query
def densify(spark, d):
    return gr.densify(_monthly(spark, d), ["id"], "mes", list(b.MONTHS.values()))


@query
def densify_attributes(spark, d):
    return gr.densify(_monthly(spark, d), ["id"], "mes", list(b.MONTHS.values()),
                      attributes=b.customer_profile(spark, d), on="id")


@query
def densify_lost_rows(spark, d):
    return gr.lost_rows(_monthly(spark, d), "mes", list(b.MONTHS.values())[:-1])


def _level_cells(spark, d) -> DataFrame:
    return ct.count_rows(_zoned_opinions(spark, d), "zona", "sub_answer", name="count")


@query
def complete_cells(spark, d):
    return gr.complete_cells(_level_cells(spark, d), ["zona"], "sub_answer", b.PRIORITY_LEVELS, "count")


@query
def complete_cells_long_domain(spark, d):
    cells = ct.count_rows(b.reports(spark, d), "id", "sp_cien")
    domain = [f"Brand#{i}" for i in range(1, 131)]
    return gr.complete_cells(cells, ["id"], "sp_cien", domain)


@query
def complete_observed(spark, d):
    """Suppliers with every brand and abundance text that occurs anywhere."""
    reports = b.reports(spark, d).select("id", F.concat_ws(" ", "sp_cien", "abundancia").alias("report"))
    return gr.complete_observed(ct.count_rows(reports, "id", "report"), ["id"], "report")


# ---- counts, reshapes and shares ---------------------------------------------------------

@query
def count_by_group(spark, d):
    return ct.count_rows(_zoned_customers(spark, d), "zona", name="recuento")


@query
def count_two_keys(spark, d):
    return _level_cells(spark, d)


@query
def count_named(spark, d):
    return ct.count_rows(b.opinions(spark, d), "answer", "sub_answer", name="Freq")


@query
def reaggregate(spark, d):
    cells = ct.count_rows(b.opinions(spark, d), "answer", "sub_answer", name="Freq")
    return ct.reaggregate(cells, "answer", value="Freq", name="n")


@query
def sum_ignore_null(spark, d):
    lines = b.table(spark, d, "lineitem").select(
        "l_returnflag", F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")).alias("lines"))
    return ct.sum_or_zero(lines, ["l_returnflag"], ["lines"])


@query
def share_in_group(spark, d):
    return sh.share_in_group(_level_cells(spark, d), "count", ["zona"])


@query
def respondents_per_zone(spark, d):
    zoned = _customers(spark, d).attach(b.opinions(spark, d))
    return ct.count_distinct(zoned, "zona", of="id", name="respondents")


@query
def share_external_denominator(spark, d):
    counted = ct.count_rows(b.reports(spark, d), "id", "abundancia")
    zoned = _suppliers(spark, d).attach_counted(counted, "times").withColumn("n", F.col("n") * F.col("times"))
    flags = rs.pivot_wide(zoned, ["zona"], "abundancia", "n", ["A", "R"])
    return sh.share_of(flags, ["A", "R"], b.denominators(spark, d), "zona", "respondents")


@query
def pivot_wide(spark, d):
    return rs.pivot_wide(_level_cells(spark, d), ["zona"], "sub_answer", "count", b.PRIORITY_LEVELS)


@query
def unpivot_long(spark, d):
    return rs.unpivot_long(b.opinions(spark, d), ["o_orderkey"], ["answer", "sub_answer"], "item", "value")


@query
def likert_items(spark, d):
    return lk.level_shares(lk.level_counts(_level_answers(spark, d), b.ITEMS, b.LEVELS), b.LEVELS)


@query
def likert_grouped(spark, d):
    return lk.level_shares(_zone_item_counts(spark, d), b.LEVELS)


@query
def likert_theme_subset(spark, d):
    frame = _suppliers(spark, d).attach(_level_answers(spark, d)).select("zona", *b.ITEMS)
    theme = co.names_at(frame, [2, range(4, 6)])
    return lk.level_shares(lk.level_counts(frame, theme, b.LEVELS, ["zona"]), b.LEVELS)


@query
def likert_low_neutral_high(spark, d):
    return lk.low_neutral_high(_zone_item_counts(spark, d), len(b.LEVELS))


@query
def likert_centered_offsets(spark, d):
    return lk.centered_offsets(_zone_item_counts(spark, d), b.LEVELS)


@query
def likert_mean_sd(spark, d):
    summary = lk.mean_sd(_zone_item_counts(spark, d), len(b.LEVELS))
    return summary.withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 9)})


DENSITY_GRID = [i / 4 for i in range(0, 25)]


@query
def ordinal_density(spark, d):
    density = lk.ordinal_density(_zone_item_counts(spark, d), len(b.LEVELS), DENSITY_GRID, bandwidth=0.5)
    return density.withColumn("density", F.round("density", 9))


@query
def ordinal_density_auto(spark, d):
    """The bandwidth of each item and zone comes from its answers."""
    density = lk.ordinal_density(_zone_item_counts(spark, d), len(b.LEVELS), DENSITY_GRID)
    return density.withColumns({"density": F.round("density", 9), "bandwidth": F.round("bandwidth", 9)})


@query
def pie_donut_by_group(spark, d):
    return sh.pie_donut(_zoned_opinions(spark, d), ["zona"], "answer", "sub_answer")


@query
def pie_donut_of_total(spark, d):
    return sh.pie_donut(_zoned_opinions(spark, d), ["zona"], "answer", "sub_answer", within_answer=False)


@query
def pie_donut_ungrouped(spark, d):
    return sh.pie_donut(b.opinions(spark, d), [], "answer", "sub_answer", within_answer=False)


@query
def stack_fill_share(spark, d):
    cells = ct.count_rows(_zoned_opinions(spark, d), "zona", "answer", "sub_answer", name="n")
    return sh.share_in_group(cells, "n", ["zona", "answer"], name="share", scale=1.0, total="total")


@query
def distinct_values(spark, d):
    return ct.distinct_values(_zoned_customers(spark, d), "zona")


@query
def quoted_values(spark, d):
    return ct.quoted_values(rw.drop_na_text(b.reports(spark, d), "sp_cien"), "sp_cien", "species_list")


@query
def bbox_agg(spark, d):
    return pt.bounding_box(_coordinates(spark, d), "lon", "lat")


@query
def bbox_agg_grouped(spark, d):
    return pt.bounding_box(_coordinates(spark, d), "lon", "lat", "label")


@query
def contradictory_by_zone(spark, d):
    return sv.contradictory_species(b.reports(spark, d), _suppliers(spark, d), "sp_cien", "abundancia", "A", "R")


@query
def species_outside_list(spark, d):
    return sv.species_outside(b.reports(spark, d), "sp_cien", b.SPECIES)


@query
def likert_by_nation(spark, d):
    """Grouped by a column that is called like a counter."""
    counts = lk.level_counts(_level_answers(spark, d).join(b.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n_nation")), "id"), b.ITEMS, b.LEVELS, ["n_nation"])
    return lk.level_shares(counts, b.LEVELS)


@query
def contradictory_items(spark, d):
    return ct.contradictions(b.reports(spark, d), ["id", "sp_cien"], "abundancia", "A", "R")


# ---- orders ------------------------------------------------------------------------------

@query
def sorted_distinct(spark, d):
    return od.sorted_values(b.table(spark, d, "part"), "p_brand")


@query
def sorted_distinct_language(spark, d):
    """The first words of the documents, in the order of a Spanish dictionary."""
    first = b.table(spark, d, "documents").select(F.split("text", " ")[0].alias("word"))
    return sinks.with_row_index(od.sorted_values(first, "word", "es"), od.in_language("word", "es"), "position")


@query
def reversed_levels(spark, d):
    distinct = ct.distinct_values(b.table(spark, d, "orders"), "o_orderpriority")
    ordered = od.order_by_levels(distinct, "o_orderpriority", b.PRIORITIES, descending=True)
    return ordered.withColumn("position", 6 - lv.ordinal(F.col("o_orderpriority"), b.PRIORITIES))


GROUP_ORDER = ["tax", "price", "quantity", "discount"]


@query
def order_by_list(spark, d):
    summary = lk.low_neutral_high(_zone_item_counts(spark, d), len(b.LEVELS))
    ordered = od.order_by_levels(summary, "item", GROUP_ORDER)
    return ordered.withColumn("position", lv.ordinal(F.col("item"), GROUP_ORDER))


@query
def order_by_level(spark, d):
    return od.order_by_levels(likert_items(spark, d), "level", b.LEVELS)


# ---- labels ------------------------------------------------------------------------------

@query
def percent_label(spark, d):
    return ratio_percent(spark, d).select("l_suppkey", tx.percent_label(F.col("percent")).alias("label"))


@query
def percent_axis_label(spark, d):
    shares = stack_fill_share(spark, d)
    return shares.select("zona", "answer", "sub_answer", tx.percent_label(F.col("share"), 0, scale=100.0).alias("label"))


@query
def concat_title(spark, d):
    zones = ct.distinct_values(_zoned_customers(spark, d), "zona")
    return zones.select("zona", tx.title("Likert Chart for", F.col("zona")).alias("title"))


# ---- the six analyses --------------------------------------------------------------------

@query
def qa_coverage_bands(spark, d):
    return sv.coverage_bands(b.sites(spark, d), "x", "y", "n_boats", "n_fleet")


@query
def qb_likert_by_zone(spark, d):
    return lk.shares_and_balance(_zone_item_counts(spark, d), b.LEVELS)


@query
def qc_heatmap_cells(spark, d):
    return sv.heatmap_cells(b.answers(spark, d), _suppliers(spark, d), b.ITEMS, b.ANSWERS, b.LEVELS)


@query
def qd_species_change(spark, d):
    return sv.species_change(b.reports(spark, d), _suppliers(spark, d), b.denominators(spark, d), "sp_cien",
                             "abundancia", b.ABUNDANCE, b.SPECIES, "respondents")


@query
def qd_species_shortlist(spark, d):
    return sv.species_change(b.reports(spark, d), _suppliers(spark, d), b.denominators(spark, d), "sp_cien",
                             "abundancia", b.ABUNDANCE, b.SPECIES, "respondents", shortlist=b.SHORTLIST)


@query
def qd_species_limits(spark, d):
    return rw.censor_report(qd_species_change(spark, d), "percent", *b.SPECIES_LIMITS, "zona")


@query
def qd_species_losses(spark, d):
    losses = Losses()
    bars = sv.species_change(b.reports(spark, d), _suppliers(spark, d), b.denominators(spark, d), "sp_cien",
                             "abundancia", b.ABUNDANCE, b.SPECIES, "respondents", losses=losses)
    return _after_run(spark, rw.censor(bars, "percent", *b.SPECIES_LIMITS, losses, "bars"), losses, "species")


@query
def qe_gear_rotation_losses(spark, d):
    losses = Losses()
    months = {raw: name for raw, name in b.MONTHS.items() if name != "Diciembre"}
    result = sv.gear_rotation(b.trips(spark, d), _customers(spark, d), "mes", b.GEARS, months, losses=losses)
    return _after_run(spark, result, losses, "rotation")


def _rotation(spark, d, keep: bool) -> DataFrame:
    return sv.gear_rotation(b.trips(spark, d), _customers(spark, d), "mes", b.GEARS, b.MONTHS,
                            gear_labels=b.GEAR_LABELS, added_rows_keep_zone=keep)


@query
def qe_gear_rotation(spark, d):
    return _rotation(spark, d, keep=True)


@query
def qe_gear_rotation_parity(spark, d):
    return _rotation(spark, d, keep=False)


@query
def qf_pie_donut(spark, d):
    return sv.pie_donut_by_zone(b.opinions(spark, d), _customers(spark, d), "answer", "sub_answer",
                                of_whole=["South-West", "East Islands"])
