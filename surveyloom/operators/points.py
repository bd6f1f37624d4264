"""Points, boxes and layers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.levels import ratio
from surveyloom.operators.columns import named


def make_point(df: DataFrame, x: str, y: str, name: str = "point", srid: int = 4326) -> DataFrame:
    """Put two coordinate columns into one point column."""
    point = F.struct(named(x).alias("x"), named(y).alias("y"), F.lit(srid).alias("srid"))
    return df.withColumn(name, point).drop(x, y)


def bounding_box(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return df.groupBy(*[named(b) for b in by]).agg(
        F.min(named(x)).alias("xmin"), F.min(named(y)).alias("ymin"),
        F.max(named(x)).alias("xmax"), F.max(named(y)).alias("ymax"))


def in_box_with_tag(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float],
                    tags: str, key: str, value: str) -> DataFrame:
    """Features in a box (xmin, ymin, xmax, ymax) whose JSON tags hold key = value.

    The tags are read as one flat map, so a dot or quote in a key is a letter like others.
    """
    xmin, ymin, xmax, ymax = box
    return df.filter(named(x).between(xmin, xmax) & named(y).between(ymin, ymax)
                     & (F.try_element_at(F.from_json(named(tags), "map<string, string>"), F.lit(key)) == value))


def stack_layers(layers: Mapping[str, DataFrame], name: str = "layer") -> DataFrame:
    """One table of several layers, each under its constant label."""
    stacked = None
    for label, layer in layers.items():
        labelled = layer.withColumn(name, F.lit(label))
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    return stacked


def rescale_area(df: DataFrame, column: str, name: str, low: float = 3.0, high: float = 10.0) -> DataFrame:
    """Map a number to a size whose area grows with it.

    The smallest value gets ``low`` and the largest ``high``; a constant column lies
    halfway. The range is a single row, read as a scalar subquery.
    """
    value = named(column).cast("double")
    least, most = df.select(F.min(value)).scalar(), df.select(F.max(value)).scalar()
    unit = F.when(F.col("__most") == F.col("__least"), F.lit(0.5)).otherwise(
        ratio(value - F.col("__least"), F.col("__most") - F.col("__least"), 1.0))
    ranged = df.withColumns({"__least": least, "__most": most})
    size = F.lit(low) + F.lit(high - low) * F.sqrt(unit)
    return ranged.withColumn(name, size).drop("__least", "__most")
