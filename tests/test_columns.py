import pytest
from pyspark.sql import functions as F

from surveyloom.functions import levels as lv
from surveyloom.functions import text as tx
from surveyloom.operators import columns as co
from surveyloom.operators import rows as rw

LEVELS = ["Low", "Mid", "High"]
RAW = {"bajo": "Low", "medio": "Mid", "NS/NC": "Mid", "raro": "Other"}


@pytest.fixture
def answers(spark):
    return spark.createDataFrame([(1, "bajo"), (2, "NS/NC"), (3, "High"), (4, "NA"), (5, None), (6, "raro"), (7, "bajo ")],
                                 "id int, a string")


def test_recode_passes_unlisted_values_through(answers, rows):
    got = rows(answers.select("id", lv.recode(F.col("a"), RAW).alias("a")))
    assert got == [(1, "Low"), (2, "Mid"), (3, "High"), (4, "NA"), (5, None), (6, "Other"), (7, "bajo ")]


def test_answer_level_drops_what_is_not_a_level(answers, rows):
    got = rows(answers.select("id", lv.answer_level(RAW, LEVELS)(F.col("a")).alias("a")))
    assert got == [(1, "Low"), (2, "Mid"), (3, "High"), (4, None), (5, None), (6, None), (7, None)]


def test_answer_level_equals_recode_then_levels(answers, rows):
    two_steps = lv.in_levels(lv.recode(F.col("a"), RAW), LEVELS)
    assert rows(answers.select("id", two_steps)) == rows(answers.select("id", lv.answer_level(RAW, LEVELS)(F.col("a"))))


def test_a_level_that_is_also_a_raw_answer_follows_the_mapping(spark, rows):
    df = spark.createDataFrame([("Low",), ("High",)], "a string")
    swap = {"Low": "High"}
    assert rows(df.select(lv.answer_level(swap, LEVELS)(F.col("a")))) == [("High",), ("High",)]


def test_relabel_and_ordinal(answers, rows):
    got = rows(answers.select("id", lv.relabel(F.col("a"), RAW).alias("l"),
                              lv.ordinal(lv.relabel(F.col("a"), RAW), LEVELS).alias("o")))
    assert got == [(1, "Low", 1), (2, "Mid", 2), (3, None, None), (4, None, None), (5, None, None),
                   (6, "Other", None), (7, None, None)]


def test_empty_mapping(answers):
    assert answers.filter(lv.relabel(F.col("a"), {}).isNotNull()).count() == 0
    assert answers.filter(lv.recode(F.col("a"), {}) == F.col("a")).count() == 6


GROUPS = {"north": ["a", "b"], "south": ["b", "c"]}


def test_rollup_first_group_wins_and_null_is_default(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "p string")
    assert rows(df.select("p", lv.rollup(F.col("p"), GROUPS, "otro").alias("g"))) == [
        (None, "otro"), ("a", "north"), ("b", "north"), ("c", "south"), ("z", "otro")]


@pytest.mark.parametrize("wanted", ["north", "south", "otro"])
def test_belongs_to_selects_the_rollup_rows(spark, rows, wanted):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "p string")
    by_rollup = df.filter(lv.rollup(F.col("p"), GROUPS, "otro") == wanted)
    assert rows(df.filter(lv.belongs_to(F.col("p"), GROUPS, wanted, "otro"))) == rows(by_rollup)


def test_belongs_to_a_default_that_is_also_a_group(spark, rows):
    groups = {"north": ["a"], "otro": ["c"]}
    df = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "p string")
    by_rollup = df.filter(lv.rollup(F.col("p"), groups, "otro") == "otro")
    assert rows(df.filter(lv.belongs_to(F.col("p"), groups, "otro", "otro"))) == rows(by_rollup)


def test_band_bounds_are_closed_in_the_middle(spark, rows):
    df = spark.createDataFrame([(19.99,), (20.0,), (30.0,), (30.01,), (None,)], "x double")
    assert rows(df.select("x", lv.band(F.col("x"), 20, 30).alias("b"))) == [
        (None, None), (19.99, "red"), (20.0, "yellow"), (30.0, "yellow"), (30.01, "green")]


def test_ratio_of_zero_is_null_and_has_no_band(spark, rows):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 4), (None, 4)], "n int, total int")
    percent = lv.ratio(F.col("n"), F.col("total"))
    assert rows(df.select("n", percent, lv.band(percent, 20, 30))) == [
        (None, None, None), (0, None, None), (1, None, None), (1, 25.0, "yellow")]


def test_mirror_keeps_the_magnitude(spark, rows):
    df = spark.createDataFrame([("d", 2.0), ("d", -2.0), ("u", -3.0), (None, -1.0)], "w string, v double")
    assert rows(df.select("w", lv.mirror(F.col("v"), F.col("w"), "d").alias("v"))) == [
        (None, 1.0), ("d", -2.0), ("d", -2.0), ("u", 3.0)]


def test_labels_round_as_printf_does(spark):
    values = [n / total * 100 for total in range(1, 81) for n in range(total + 1)] + [12.25, 12.35, 6.25, 0.05, 0.15]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", tx.percent_label(F.col("x")).alias("one"), tx.percent_label(F.col("x"), 0).alias("none")).collect()
    for row in got:
        assert row.one == "%.1f%%" % row.x
        assert row.none == "%.0f%%" % row.x


def test_title_and_quotes(spark, rows):
    df = spark.createDataFrame([("Menorca",)], "z string")
    assert rows(df.select(tx.title("Chart for", F.col("z")), tx.quoted(F.col("z")))) == [("Chart for Menorca", "'Menorca'")]


@pytest.fixture
def wide(spark):
    return spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, `c d` int, `e.f` int, g int")


def test_name_range(wide):
    assert co.name_range(wide, "b", "e.f") == ["b", "c d", "e.f"]
    assert co.select_range(wide, ["g"], "b", "e.f").columns == ["g", "b", "c d", "e.f"]
    with pytest.raises(ValueError):
        co.name_range(wide, "g", "a")


def test_positions(wide):
    assert co.select_positions(wide, 1, range(3, 5)).columns == ["a", "c d", "e.f"]
    assert co.drop_positions(wide, range(2, 5)).columns == ["a", "g"]
    with pytest.raises(IndexError):
        co.select_positions(wide, 0)


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("line", "x", "Line")
    assert co.unique_names(df).columns == ["line_1", "x", "Line_3"]


def test_set_names_checks_the_count(wide):
    assert co.set_names(wide, list("vwxyz")).columns == list("vwxyz")
    with pytest.raises(ValueError):
        co.set_names(wide, ["a"])


def test_relocate_front(wide):
    assert co.relocate_front(wide, "g", "e.f").columns == ["g", "e.f", "a", "b", "c d"]


def test_apply_columns_is_one_projection(wide):
    out = co.apply_columns(wide, ["c d", "e.f"], lambda c: c * 10)
    assert out.collect()[0] == (1, 2, 30, 40, 5)


def test_flag_empty_rows(spark, rows):
    df = spark.createDataFrame([(1, 0.0, None), (2, None, None), (3, 1.0, None), (4, 0.0, 0.0)], "id int, x double, y double")
    assert rows(co.flag_empty_rows(df, ["x", "y"], "none")) == [
        (1, 0.0, 0.0, 1), (2, 0.0, 0.0, 1), (3, 1.0, 0.0, 0), (4, 0.0, 0.0, 1)]


def test_na_text_filter_drops_null_and_marker(spark, rows):
    df = spark.createDataFrame([("x", "y"), ("NA", "y"), (None, "y"), ("x", "NA"), ("x", None)], "a string, b string")
    assert rows(rw.drop_na_text(df, "a", "b")) == [("x", "y")]
    assert rw.drop_na_text(df, "a").count() == 3


def test_keep_listed_does_not_repeat_rows(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    listing = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(rw.keep_listed(df, listing, "k")) == [("a", 1)]
    assert rows(rw.keep_in(df, "k", ["a", "zzz"])) == [(1, "a")]


def test_drop_incomplete(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, None, "b")], "id int, p string, q string")
    assert rows(rw.drop_incomplete(df)) == [(2, "a", "b")]
    assert rows(rw.drop_incomplete(df, ["p"]), "id") == [(1,), (2,)]


def test_censor_counts_every_row_once(spark, rows):
    df = spark.createDataFrame([("a", -61.0), ("a", -60.0), ("a", None), ("b", 60.0), ("b", 60.5)], "g string, v double")
    assert rows(rw.censor(df, "v", -60, 60)) == [("a", -60.0), ("b", 60.0)]
    assert rows(rw.censor_report(df, "v", -60, 60, "g")) == [("a", 1, 2), ("b", 1, 1)]
