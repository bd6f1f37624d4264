"""Roles of the survey tables, played by the driver's tables.

The given tables hold no NULL, no text ``NA`` and no unlisted answer, so these
bindings make some from values that are there; the SQL side makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.levels import rollup
from surveyloom.operators.counts import count_distinct
from surveyloom.sources.tables import load_table

ZONES = {
    "North": ["NATION_1", "NATION_2", "NATION_3"],
    "South-West": ["NATION_4", "NATION_5", "NATION_6", "NATION_7"],
    "South-East": ["NATION_8", "NATION_9", "NATION_10"],
    "West Islands": ["NATION_11", "NATION_12", "NATION_13"],
    "East Islands": ["NATION_14", "NATION_15", "NATION_16"],
}
OTHER = "otro"
ITEMS = ["quantity", "discount", "tax", "price"]
RAW_ANSWERS = ["much less", "less", "same", "more", "much more"]
ANSWERS = {"much less": "Very Negative", "less": "Negative", "same": "Neutral",
           "more": "Positive", "much more": "Very Positive"}
LEVELS = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_LEVELS = [*PRIORITIES, "6-NEVER"]
ABUNDANCE = {"A": "Decrease", "N": "No Change", "R": "Increase"}
# Three names nobody reports; Brand#24 and Brand#25 are reported but not listed.
SPECIES = [f"Brand#{i}" for i in range(1, 24)] + ["Absent#1", "Absent#2", "Absent#3"]
SPECIES_LIMITS = (-60, 60)
SHORTLIST = ["Brand#3", "Brand#17", "Absent#2"]
MONTHS = {str(i): name for i, name in enumerate(
    ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre",
     "Octubre", "Noviembre", "Diciembre"], start=1)}
GEARS = ["urgent", "high", "medium", "unspecified", "low"]
GEAR_LABELS = {"urgent": "Urgent", "unspecified": "Not Specified"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, sf_dir, name)


def _place() -> Column:
    return F.nullif(F.col("n_name"), F.lit("NATION_24")).alias("port")


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, port, one row per customer; one nation counts as a NULL port."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, "c_nationkey", "left").select(F.col("c_custkey").alias("id"), _place())


def supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, port, one row per supplier."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), _place())


def _bucket(value: str, bounds: list[float], na_from: float, null_from: float, name: str) -> Column:
    """Five raw answers by upper bound, then the text NA, then NULL."""
    cases = [f"when {value} >= {null_from} then null", f"when {value} >= {na_from} then 'NA'",
             *[f"when {value} <= {bound} then '{answer}'" for bound, answer in zip(bounds, RAW_ANSWERS, strict=False)]]
    return F.expr(f"case {' '.join(cases)} else '{RAW_ANSWERS[-1]}' end as {name}")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items side by side: one interview per order line, the supplier answers."""
    discount, tax = (f"cast(floor(l_{name} * 100 + 0.5D) as int)" for name in ("discount", "tax"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), "l_orderkey", "l_linenumber",
        _bucket("l_quantity", [10, 20, 30, 40], 49, 50, "quantity"),
        _bucket(discount, [1, 3, 5, 7], 10, 11, "discount"), _bucket(tax, [0, 2, 4, 6], 9, 8, "tax"),
        _bucket("l_extendedprice", [20000, 40000, 60000, 80000], 103000, 104000, "price"))


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer and sub-answer per order; one status is the text NA, one priority is NULL for it."""
    status = F.when(F.col("o_orderstatus") == "P", F.lit("NA")).otherwise(F.col("o_orderstatus"))
    sub = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "3-MEDIUM"), F.lit(None)) \
        .otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"), status.alias("answer"), sub.alias("sub_answer"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species reports: brand, and a raw abundance; some of both are the text NA."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    brand = F.when(F.col("p_brand") == "Brand#7", F.lit("NA")).otherwise(F.col("p_brand"))
    flag = F.when(F.col("l_linenumber") == 7, F.lit("NA")).otherwise(F.col("l_returnflag"))
    return lines.join(part, "l_partkey", "left").select(
        F.col("l_suppkey").alias("id"), brand.alias("sp_cien"), flag.alias("abundancia"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: customer, raw month, and a column per gear; open orders have no gear."""
    def used(priority: str) -> Column:
        return (F.when(F.col("o_orderstatus") == "O", F.lit(None))
                .when(F.col("o_orderpriority") == priority, 1.0).otherwise(0.0))

    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.month("o_orderdate").cast("string").alias("mes"),
        *[used(p).alias(g) for p, g in zip(PRIORITIES, GEARS, strict=True)])


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y and the interviewed and total counts of each site; sites nobody visited have none."""
    visits = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg(
        F.count_if(F.col("event_type") == "purchase").cast("double").alias("n_boats"),
        F.count(F.lit(1)).cast("double").alias("n_fleet"))
    places = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return places.join(visits, "vec_id", "left")


def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondents per zone, for the named zones only."""
    zoned = supplier_profile(spark, sf_dir).withColumn("zona", rollup(F.col("port"), ZONES, OTHER))
    return count_distinct(zoned.filter(F.col("zona") != "otro"), "zona", of="id", name="respondents")
