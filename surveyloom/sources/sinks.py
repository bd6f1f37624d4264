"""Result tables as CSV or partitioned Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from surveyloom.operators.columns import named, relocate_front
from surveyloom.session import shared_folder
from surveyloom.sources.tables import csv_reader

# Keeps NULL apart from an empty text and from the literal text NA in a round trip.
NULL_MARKER = r"\N"


def write_csv(df: DataFrame, path: str, null_marker: str = NULL_MARKER) -> None:
    """CSV part files, each with a header; quotes inside a text are doubled, blanks around it stay."""
    _csv_options(df.write, null_marker).csv(path)


def _csv_options(writer: DataFrameWriter, null_marker: str) -> DataFrameWriter:
    return (writer.option("header", True).option("nullValue", null_marker).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             null_marker: str = NULL_MARKER, multi_line: bool = False) -> DataFrame:
    return csv_reader(spark, schema, null_marker, multi_line).csv(path)


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row", stage: str | None = None) -> DataFrame:
    """Gapless row numbers from 1 in the order of the key columns, or of other sort keys.

    A window without partitions would sort all rows in one task. Here the sort is
    spread over range partitions and written to the shared folder, so partition and
    position of a row are fixed even if executors are lost later. The offsets of the
    partitions follow from their sizes: one row per sort partition, hence safe to
    broadcast and to add up in one task.

    The result is lazy and reads the sorted rows, so their folder must stay as long as it
    is used. ``stage`` names that folder for a caller who removes it; otherwise it is a new
    one in the shared folder.
    """
    spark = df.sparkSession
    stage = stage or f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()  # partition in the upper bits, position in the lower 33
    names = [k for k in order_by if isinstance(k, str)]
    keys = [named(k) if isinstance(k, str) else k for k in order_by]
    df.orderBy(*keys, *[named(n) for n in df.columns if n not in names]).withColumn("__place", place).write.parquet(stage)

    staged = spark.read.parquet(stage).withColumn("__part", F.shiftright("__place", 33))
    sizes = staged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    position = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    indexed = staged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + position + 1)
    return relocate_front(indexed.drop("__part", "__place", "__offset"), name)


def write_csv_indexed(df: DataFrame, path: str, order_by: Sequence[str | Column], name: str = "row",
                      null_marker: str = NULL_MARKER) -> None:
    """CSV with a leading 1-based row number. The sorted rows it is made from are removed after the write, or its failure."""
    stage = f"{shared_folder(df.sparkSession)}/sorted-{uuid.uuid4().hex}"
    try:
        write_csv(with_row_index(df, order_by, name, stage), path, null_marker)
    finally:
        remove_folder(df.sparkSession, stage)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever the session can write; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of ``by``, all in one job.

    The rebalance hint lets adaptive execution merge small groups into few files and
    split a hot group over several tasks.
    """
    df.hint("rebalance", named(by)).write.partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str, file_format: str = "parquet") -> None:
    """Write one folder per value of ``by``, in place of the folders of those values only.

    What an earlier run wrote for other values stays. New files appear when the job
    commits, so a run that fails leaves the old ones, and may be repeated. ``file_format`` is parquet, or csv
    with a header and the NULL marker of ``write_csv``. A frame without rows changes nothing.
    """
    rows = df.hint("rebalance", named(by))
    if file_format == "csv":
        writer = _csv_options(rows.write.format("csv"), NULL_MARKER)
    elif file_format == "parquet":
        writer = rows.write.format("parquet")
    else:
        raise ValueError("file_format is parquet or csv")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).save(path)


def write_clustered(df: DataFrame, path: str, x: str, y: str, row_group_bytes: int = 16 << 20) -> None:
    """Parquet in the order of a curve through the plane, so that a box of coordinates meets few row groups.

    Both coordinates become 16-bit steps between their least and largest value, and their
    bits are interleaved; rows near each other in the plane are near each other in the
    files. Each row group knows the ranges of its coordinates, and a filter on them skips
    the groups outside. Rows of one point are dealt by a hash of the row. A missing
    coordinate comes first.
    """
    def step(name: str) -> Column:
        value = F.when(~F.isnan(named(name).cast("double")), named(name).cast("double"))
        least, most = df.select(F.min(value)).scalar(), df.select(F.max(value)).scalar()
        return F.least(F.floor(F.coalesce(F.try_divide(value - least, most - least), value * 0) * 65_536), F.lit(65_535)).cast("long")

    def spread(bits: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return bits

    hashed = [named(f.name) for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    placed = df.withColumns({"__x": step(x), "__y": step(y), "__row": F.xxhash64(*hashed)})
    keyed = placed.withColumn("__key", spread(F.col("__x")).bitwiseOR(F.shiftleft(spread(F.col("__y")), 1))).drop("__x", "__y")
    (keyed.repartitionByRange("__key", "__row").sortWithinPartitions("__key", "__row").drop("__key", "__row")
     .write.option("parquet.block.size", row_group_bytes).parquet(path))


def read_partitioned(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With the schema given, folder names are not guessed to be numbers."""
    return spark.read.schema(schema).parquet(path)
