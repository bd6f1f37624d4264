"""Counts of rows that an analysis leaves out, taken while its result is made.

``Losses`` puts observed metrics on a frame on its way through a plan. They are filled in
by the first action that runs the result, from the rows it reads anyway; nothing is read
a second time. The report is a table of one row for each kind of loss.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "analysis string, loss string, total long, lost long"


class Losses:
    """Losses watched for in one or several results."""

    def __init__(self):
        self._watched: list[tuple[str, list[str], Observation]] = []

    def watch(self, df: DataFrame, analysis: str, lost: Mapping[str, Column]) -> DataFrame:
        """``df`` itself; once it has run, its rows and those for which each test of ``lost`` holds are known.

        A test that is NULL does not hold. The frame must stand at one place of the plan:
        put it before anything reads it twice.
        """
        seen = Observation()
        counters = [F.count_if(F.coalesce(test, F.lit(False))).alias(f"lost_{i}") for i, test in enumerate(lost.values())]
        self._watched.append((analysis, list(lost), seen))
        return df.observe(seen, F.count(F.lit(1)).alias("total"), *counters)

    def rows(self) -> list[tuple[str, str, int, int]]:
        """(analysis, loss, total, lost); waits for the results that have not run yet."""
        out = []
        for analysis, names, seen in self._watched:
            found = seen.get
            out += [(analysis, name, found["total"], found[f"lost_{i}"]) for i, name in enumerate(names)]
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """``rows`` as a table."""
        return spark.createDataFrame(self.rows(), SCHEMA)


def watched(losses: Losses | None, df: DataFrame, analysis: str, lost: Mapping[str, Column]) -> DataFrame:
    """``losses.watch`` where losses are asked for."""
    return df if losses is None else losses.watch(df, analysis, lost)
