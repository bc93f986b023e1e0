"""Resumable runs: what is done, what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(targets: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Targets that are not done; all of them with force."""
    return targets if force else targets.join(done.select(*keys), list(keys), "left_anti")


def missing_targets(present: DataFrame, first_year: int, last_year: int, by: str, values: Sequence) -> DataFrame:
    """(year, by) of every expected pair that is not present; expected pairs are years times a few constants."""
    years = present.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    expected = years.select("year", F.explode(F.array(*[F.lit(v) for v in values])).alias(by))
    return expected.join(present.select("year", by).distinct(), ["year", by], "left_anti")


def write_pending(rows: DataFrame, path: str, partition: str) -> None:
    """Write partitions of a run and leave the others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
