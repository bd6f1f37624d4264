import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from surveyloom.session import shared_folder
from surveyloom.sources import sinks, tables

TEXTS = [(1, None), (2, "NA"), (3, ""), (4, 'said "yes", twice'), (5, "two\nlines"), (6, "Dactylopterus volitans "),
         (7, " Pollença"), (8, "back\\slash"), (9, "a;b,c"), (10, 'ends with quote"'), (11, "null")]


def test_csv_round_trip_keeps_null_na_empty_and_blanks(spark, tmp_path, rows):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert rows(sinks.read_csv(spark, str(tmp_path / "out"), "id int, text string", multi_line=True)) == rows(df)


def test_csv_needs_matching_headers(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "a")], "id int, text string").coalesce(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)header|schema"):
        sinks.read_csv(spark, str(tmp_path / "out"), "id int, other string", multi_line=False).collect()


def test_row_index_has_no_gaps_and_follows_the_key(spark):
    df = spark.range(5000).select((F.hash("id") % 700).alias("k"), F.col("id").alias("v")).repartition(16)
    indexed = sinks.with_row_index(df, ["k", "v"])
    assert indexed.columns == ["row", "k", "v"]
    got = [(r.row, r.k, r.v) for r in indexed.collect()]
    expected = sorted((r.k, r.v) for r in df.collect())
    assert sorted(got) == [(i, k, v) for i, (k, v) in enumerate(expected, start=1)]


def test_row_index_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, v string")
    assert sinks.with_row_index(empty, ["k"]).count() == 0


def test_indexed_csv(spark, tmp_path, rows):
    df = spark.createDataFrame([("b", 2), ("a", 1), (None, 3)], "k string, v int")
    sinks.write_csv_indexed(df, str(tmp_path / "out"), ["k"])
    assert rows(sinks.read_csv(spark, str(tmp_path / "out"), "row long, k string, v int")) == [
        (1, None, 3), (2, "a", 1), (3, "b", 2)]


def test_partitioned_sink(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "01"), (2, "Mallorca South-East"), (3, None), (4, "01")], "id int, zona string")
    sinks.write_partitioned(df, str(tmp_path / "out"), "zona")
    assert {p.name for p in (tmp_path / "out").glob("zona=*")} == {
        "zona=01", "zona=Mallorca South-East", "zona=__HIVE_DEFAULT_PARTITION__"}
    assert rows(sinks.read_partitioned(spark, str(tmp_path / "out"), "id int, zona string")) == rows(df)


def test_indexed_csv_leaves_no_copy(spark, tmp_path):
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    sinks.write_csv_indexed(spark.range(100), str(tmp_path / "out"), ["id"])
    with pytest.raises(Exception):
        sinks.write_csv_indexed(spark.range(100), str(tmp_path / "out"), ["id"])  # the folder is there already
    assert set(folder.iterdir()) == before


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_replacing_some_zones(spark, tmp_path, rows, file_format):
    path = str(tmp_path / "out")
    first = [(1, "a", "x"), (2, "b", None), (3, "c", "NA"), (4, None, ""), (5, "b", "old")]
    sinks.replace_partitions(spark.createDataFrame(first, "id int, zona string, note string"), path, "zona", file_format)
    untouched = {p: p.stat().st_mtime_ns for z in ("zona=a", "zona=c") for p in (tmp_path / "out" / z).iterdir()}
    again = spark.createDataFrame([(9, "b", "new"), (8, None, None), (7, "d", "first")], "id int, zona string, note string")
    for _ in range(2):  # repeating it changes nothing
        sinks.replace_partitions(again, path, "zona", file_format)
    sinks.replace_partitions(again.limit(0), path, "zona", file_format)
    schema = "id int, note string, zona string"
    back = sinks.read_partitioned(spark, path, schema) if file_format == "parquet" else sinks.read_csv(spark, path, schema)
    assert rows(back, "id", "zona", "note") == rows(spark.createDataFrame(
        [(1, "a", "x"), (3, "c", "NA"), (9, "b", "new"), (8, None, None), (7, "d", "first")], "id int, zona string, note string"),
        "id", "zona", "note")
    assert {p: p.stat().st_mtime_ns for z in ("zona=a", "zona=c") for p in (tmp_path / "out" / z).iterdir()} == untouched


def test_a_failed_replacement_leaves_the_old_zones(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, zona string")
    sinks.replace_partitions(old, path, "zona")
    with pytest.raises(Exception):
        sinks.replace_partitions(old.withColumn("id", F.expr("assert_true(id < 2, 'no')").cast("int")), path, "zona")
    assert rows(sinks.read_partitioned(spark, path, "id int, zona string")) == rows(old)


def test_a_box_meets_few_row_groups_of_a_clustered_layout(spark, tmp_path, rows):
    """A third of all rows is one point, and some coordinates are missing or no numbers."""
    spots = spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, 0.25).when(F.col("id") % 1001 == 1, None).when(F.col("id") % 1009 == 1, float("nan"))
        .otherwise(F.rand(3)).alias("x"), F.when(F.col("id") % 3 == 0, 0.75).otherwise(F.rand(4) * 100).alias("y"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"))
    spots.write.parquet(str(tmp_path / "spots"))
    spots = spark.read.parquet(str(tmp_path / "spots"))
    sinks.write_clustered(spots, str(tmp_path / "clustered"), "x", "y", row_group_bytes=64 << 10)
    spots.repartition(8).write.option("parquet.block.size", 64 << 10).parquet(str(tmp_path / "plain"))
    box = {"x": (0.4, 0.5), "y": (20.0, 30.0)}

    def met(folder):
        groups = [m.row_group(i) for f in (tmp_path / folder).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]

        def inside(group):
            ranges = {c.path_in_schema: c.statistics for c in (group.column(j) for j in range(group.num_columns))}
            return all(not ranges[n].has_min_max or (ranges[n].min <= hi and ranges[n].max >= lo) for n, (lo, hi) in box.items())

        return sum(map(inside, groups)), len(groups)

    few, all_groups = met("clustered")
    many, plain_groups = met("plain")
    assert all_groups > 20 and few < all_groups / 8 and many > plain_groups / 2

    def boxed(df):
        return df.filter(F.col("x").between(*box["x"]) & F.col("y").between(*box["y"]))

    stored = spark.read.parquet(str(tmp_path / "clustered"))
    assert rows(boxed(stored)) == rows(boxed(spots)) and stored.count() == 60_000
    pushed = boxed(stored)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,0.4), LessThanOrEqual(x,0.5)" in pushed


def test_clustering_without_spread(spark, tmp_path, rows):
    for name, df in (("one", spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, y double")),
                     ("none", spark.createDataFrame([], "x double, y double"))):
        sinks.write_clustered(df, str(tmp_path / name), "x", "y")
        assert rows(spark.read.schema("x double, y double").parquet(str(tmp_path / name))) == rows(df)


LINES = ["id,amount,day,note", '1,2.5,2024-02-29,"said ""yes"", twice"', "2,,,", "3,x,2024-01-01,bad number", "4,1.0,2023-02-29,no such day",
         "5,1.0", "6,1.0,2024-01-01,a,b", "x,1.0,2024-01-01,key", '7,9,2024-01-01,"a,b"', "", "8,1e3,2024-01-01,NA", "99999999999,1,2024-01-01,too large",
         '9,1,2024-01-01,"open', '10,1,2024-01-01,""', "11,,,x,", "id,amount,day"]


def test_sound_and_rejected_rows(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text("\n".join(LINES) + "\n")
    sound, rejected = tables.load_sound(spark, str(tmp_path / "t.csv"), "id int, amount double, day date, note string")
    assert rows(sound) == rows(spark.createDataFrame(
        [(1, 2.5, datetime.date(2024, 2, 29), 'said "yes", twice'), (2, None, None, None), (7, 9.0, datetime.date(2024, 1, 1), "a,b"),
         (8, 1000.0, datetime.date(2024, 1, 1), "NA"), (10, 1.0, datetime.date(2024, 1, 1), None)], sound.schema))
    assert rows(sound, "note") == [(None,), (None,), ("NA",), ("a,b",), ('said "yes", twice',)]
    assert {(r.line, r.reason) for r in rejected.collect()} == {
        (LINES[3], "amount: no double"), (LINES[4], "day: no date"), (LINES[5], "too few fields"), (LINES[6], "too many fields"),
        (LINES[7], "id: no int"), (LINES[11], "id: no int"), (LINES[12], "open quote"), (LINES[14], "too many fields"),
        (LINES[15], "too few fields")}
    assert all(r.file.endswith("/t.csv") for r in rejected.collect())


def test_rejecting_is_split_over_tasks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n\n" + "".join(f"{i},{'x' if i % 100 == 7 else i}\n" for i in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        sound, rejected = tables.load_sound(spark, str(tmp_path / "t.csv"), "id int, n int")
        assert sound.rdd.getNumPartitions() > 4
        assert (sound.count(), rejected.count()) == (49_500, 500)
        assert rejected.select("reason").distinct().collect() == [("n: no int",)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_table_names_of_files_and_folders(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "two.x.parquet"))
    (tmp_path / "three.csv").write_text("id\n1\n")
    assert tables.table_names(spark, str(tmp_path)) == ["one", "three", "two.x"]
    assert tables.table_names(spark, f"file:{tmp_path}/") == ["one", "three", "two.x"]


def test_load_all_registers_views(spark, tmp_path, rows):
    spark.range(3).write.parquet(str(tmp_path / "loaded_a.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "loaded_b.parquet"))
    loaded = tables.load_all(spark, str(tmp_path))
    assert set(loaded) == {"loaded_a", "loaded_b"}
    assert spark.table("loaded_b").count() == 5
    assert rows(tables.table_sizes(loaded)) == [("loaded_a", 1, 3), ("loaded_b", 1, 5)]


def test_load_csv_table(spark, tmp_path, rows):
    (tmp_path / "t.csv").write_text('id,answer\n1,"NA"\n2,\n3,"muy\nnegativo"\n')
    table = tables.load_table(spark, str(tmp_path), "t", "id int, answer string", file_format="csv", multi_line=True)
    assert rows(table) == [(1, "NA"), (2, None), (3, "muy\nnegativo")]
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path), "t", file_format="csv")


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
