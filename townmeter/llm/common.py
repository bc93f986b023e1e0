"""What the operators of this subpackage share: words, scratch tables, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townmeter.sources.shared import fresh_dir

#: White space between words; everything else belongs to a word.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, fresh_dir(spark, "scratch"), 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of put() that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join is broadcast up to so many rows; each such row is some 100 bytes.
BROADCAST_ROWS = 50_000


def checked(side: DataFrame) -> DataFrame:
    """The written table with a broadcast hint if it is small enough; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts to so many rows, so that a Python worker's memory stays bounded. Results are lazy, so the session keeps the setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone; MD5, so that any SQL engine can repeat it."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
