"""Files in and out: JSON referentials and series, delimited registers, station files, Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townmeter.schemas import RAW_PLACE, SERIES


def read_raw_places(spark: SparkSession, path: str) -> DataFrame:
    """Geo records of a JSON array."""
    return spark.read.schema(RAW_PLACE).json(path, multiLine=True)


def read_series(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(insee, day, tmax, tmin, precip, pos) of cached series files, one row per day; without precipitation it is null. A file holds a series, or with lines=True one in each line."""
    files = spark.read.schema(SERIES).json(path, multiLine=not lines)
    d = F.col("daily")
    rows = files.select(F.col("meta.insee").alias("insee"), F.posexplode(F.arrays_zip(
        d["time"].alias("time"), d["temperature_2m_max"].alias("tmax"), d["temperature_2m_min"].alias("tmin"),
        F.coalesce(d["precipitation_sum"], F.transform(d["time"], lambda x: F.lit(None).cast("double"))).alias("precip"),
    )).alias("pos", "x"))
    return rows.select("insee", F.to_date("x.time").alias("day"), "x.tmax", "x.tmin", "x.precip", "pos")


def write_series(series: DataFrame, path: str, day: str = "day", key: str = "insee") -> None:
    """Daily series to two decimals as Parquet by year, clustered by place, so that a place's days lie together in few files; a year is written by several tasks."""
    rounded = series.withColumns({c: F.round(c, 2) for c in ("tmax", "tmin") if c in series.columns}).withColumn("year", F.year(day))
    rounded.repartition("year", F.pmod(F.hash(key), F.lit(16))).sortWithinPartitions("year", key, day).write.mode("overwrite").partitionBy("year").parquet(path)


def latest_file(spark: SparkSession, folder: str, prefix: str) -> str:
    """The last file by name with a prefix; the folder is listed by Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    found = sorted(n for n in names if n.startswith(prefix))
    if not found:
        raise FileNotFoundError(f"no {prefix}* in {folder}")
    return f"{folder}/{found[-1]}"


def read_register(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ";") -> DataFrame:
    """The named columns of a delimited register as strings: doubled quotes, trimmed header, blank lines dropped; a missing column is an error, as are files with another header."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.csv(paths, sep=sep, quote='"', escape='"', header=True, enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing in {path}: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read_stations(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Station days of several period files; empty cells are missing. Compressed files give a task each and are dealt by station."""
    columns = ["NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJ", "TX", "TN"]
    raw = read_register(spark, paths, columns)
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(
        F.trim("NUM_POSTE").alias("station"), F.trim("NOM_USUEL").alias("name"), number("LAT").alias("lat"), number("LON").alias("lon"), number("ALTI").alias("alti"),
        F.try_to_date("AAAAMMJJ", "yyyyMMdd").alias("day"), number("TX").alias("tx"), number("TN").alias("tn"),
    ).repartition("station")
