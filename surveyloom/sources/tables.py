"""A dataset is a folder with one Parquet or CSV table per name."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder, sorted: one level is listed, not the part files below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = {entry.getPath().getName() for entry in entries}
    return sorted({re.sub(r"\.(parquet|csv)$", "", n) for n in names if n[0] not in "_."})


def load_table(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None,
               file_format: str = "parquet", null_marker: str = "", multi_line: bool = False) -> DataFrame:
    """One table by name. CSV needs a schema; Parquet takes it from the file."""
    path = f"{folder.rstrip('/')}/{name}.{file_format}"
    if file_format == "csv":
        if schema is None:
            raise ValueError("a CSV table needs an explicit schema")
        return csv_reader(spark, schema, null_marker, multi_line).csv(path)
    reader = spark.read.format(file_format)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def csv_reader(spark: SparkSession, schema: StructType | str, null_marker: str, multi_line: bool = False):
    """Headers are checked against the schema, and a malformed row is an error.

    Large files are split over tasks. ``multi_line`` is for texts that hold line
    breaks; a file is then read by one task.
    """
    return (spark.read.schema(schema).option("header", True).option("nullValue", null_marker)
            .option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False)
            .option("multiLine", multi_line))


#: Closes every line for ``load_sound``, so that the place where it is found tells the number of fields.
_CLOSING = "\x01"


def load_sound(spark: SparkSession, path: str, schema: StructType | str, null_marker: str = "",
               header: bool = True) -> tuple[DataFrame, DataFrame]:
    """A CSV table in two parts: the rows that fit the schema, and (file, reason, line) of those that do not.

    One malformed row does not stop the load. A row is rejected if it has fewer or more
    fields than the schema, an open quote, or a text that Spark cannot cast to its column's
    type; the reason names the first such column. Whether a row is sound depends on all its
    columns, also where few of them are read later. Both parts are lazy and read the files
    in splits, so a large file is dealt over tasks; texts that hold line breaks are not
    possible then. Blank lines are no rows, and with ``header`` neither are lines that hold the
    column names; other headers are rejected like any row that does not fit.
    """
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    n = len(own)
    texts = ", ".join(f"`{i}` string" for i in range(n + 1))
    read = F.from_csv(F.concat("value", F.lit("," + _CLOSING)), texts, {"escape": '"', "maxCharsPerColumn": "-1"})
    lines = spark.read.text(path).filter(F.trim("value") != "").select("*", F.col("_metadata.file_path").alias("file"))
    fields = lines.withColumn("__read", read)
    text = [F.col("__read").getField(str(i)) for i in range(n + 1)]
    if header:
        titles = reduce(and_, [text[i].eqNullSafe(F.lit(f.name)) for i, f in enumerate(own)])
        fields = fields.filter(~(titles & text[n].eqNullSafe(F.lit(_CLOSING))))
    given = [F.when(t != null_marker, t) for t in text[:n]]
    values = [g.try_cast(f.dataType) for g, f in zip(given, own)]
    closed = F.coalesce(text[n] == _CLOSING, F.lit(False))
    few = reduce(or_, [F.coalesce(t == _CLOSING, F.lit(False)) for t in text[:n]])
    why = F.when(~closed & few, "too few fields").when(
        ~closed & reduce(or_, [F.coalesce(t.endswith("," + _CLOSING), F.lit(False)) for t in text]), "open quote").when(
        ~closed, "too many fields")
    for f, g, value in zip(own, given, values):
        why = why.when(g.isNotNull() & value.isNull(), f"{f.name}: no {f.dataType.simpleString()}")
    judged = fields.withColumn("__reason", why)
    sound = judged.filter(F.col("__reason").isNull()).select(*[v.alias(f.name) for f, v in zip(own, values)])
    rejected = judged.filter(F.col("__reason").isNotNull())
    return sound, rejected.select("file", F.col("__reason").alias("reason"), F.col("value").alias("line"))


def load_all(spark: SparkSession, folder: str, names: Sequence[str] | None = None,
             schemas: Mapping[str, StructType | str] | None = None,
             file_format: str = "parquet", null_marker: str = "",
             multi_line: bool = False) -> dict[str, DataFrame]:
    """Load every table of a folder and register each as a view under its name."""
    if names is None:
        names = table_names(spark, folder)
    schemas = schemas or {}
    tables = {n: load_table(spark, folder, n, schemas.get(n), file_format, null_marker, multi_line) for n in names}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of columns and rows of each table."""
    sizes = [t.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("name"), F.lit(len(t.columns)).alias("n_columns"), "n_rows")
             for n, t in tables.items()]
    stacked = sizes[0]
    for size in sizes[1:]:
        stacked = stacked.unionByName(size)
    return stacked
