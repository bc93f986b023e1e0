"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townmeter.sources.shared import fresh_dir

#: Rows up to which a written side is broadcast; each is some 100 bytes, or BROADCAST_LISTS where it holds a list.
BROADCAST_ROWS, BROADCAST_LISTS = 50_000, 5_000


class Tables:
    """Parquet tables under a fresh path; they survive the loss of an executor and go with the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_dir(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def checked(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has so few rows; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
