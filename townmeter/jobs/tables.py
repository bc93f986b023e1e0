"""The given tables seen as daily series, places, stations, registers and grids; each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townmeter.operators.grid import Axes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DAILY = """daily as (select l_suppkey % 5 as series, cast(l_shipdate as date) as day,
  case when max(l_linenumber) = 1 then null else max(l_quantity)::double end as tmax, min(l_quantity)::double as tmin, max(l_extendedprice)::double as precip
  from lineitem group by 1, 2)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five daily series: quantities as temperatures, prices as rain; some maxima are missing, some days too."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("series"), F.col("l_shipdate").cast("date").alias("day"))
    return rows.agg(
        F.when(F.max("l_linenumber") > 1, F.max("l_quantity").cast("double")).alias("tmax"), F.min("l_quantity").cast("double").alias("tmin"), F.max("l_extendedprice").cast("double").alias("precip")
    )


PLACES = """places as (select lpad(cast(c_custkey as varchar), 6, '0') as insee, c_name as name, c_nationkey as dept,
  42 + (c_custkey * 37 % 900)::double / 100.0::double as lat, -1 + (c_custkey * 53 % 800)::double / 100.0::double as lon,
  (c_custkey * 17 % 1800)::double as elevation_m, cast(floor(abs(c_acctbal)) as bigint) as population,
  20 + (c_custkey * 31 % 150)::double / 10.0::double as summer_tmax, c_custkey % 7 = 0 as hosp, c_custkey % 5 = 0 as station from customer)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places, spread over a box of 9 by 8 degrees."""
    k = F.col("c_custkey")
    hundredths = lambda a, n: (k * a % n).cast("double") / 100.0
    return table(spark, sf_dir, "customer").select(
        F.lpad(k.cast("string"), 6, "0").alias("insee"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("dept"),
        (42 + hundredths(37, 900)).alias("lat"), (-1 + hundredths(53, 800)).alias("lon"), (k * 17 % 1800).cast("double").alias("elevation_m"),
        F.floor(F.abs("c_acctbal")).cast("long").alias("population"), (20 + (k * 31 % 150).cast("double") / 10.0).alias("summer_tmax"),
        (k % 7 == 0).alias("hosp"), (k % 5 == 0).alias("station"),
    )


STATIONS = """stations as (select s_suppkey as station_id, 42 + (s_suppkey * 41 % 900)::double / 100.0::double as lat, -1 + (s_suppkey * 59 % 800)::double / 100.0::double as lon,
  (s_suppkey * 23 % 1800)::double as alti from supplier)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations in the same box."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("station_id"), (42 + (k * 41 % 900).cast("double") / 100.0).alias("lat"), (-1 + (k * 59 % 800).cast("double") / 100.0).alias("lon"), (k * 23 % 1800).cast("double").alias("alti")
    )


DECREES = """decrees as (select o_orderkey as id, o_custkey as place, o_orderpriority as label, strftime(o_orderdate, '%Y-%m-%d') as date from orders join lineitem on l_orderkey = o_orderkey)"""


def decrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders repeated by their lines, as a register with repeated rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("place"), F.col("o_orderpriority").alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    )


#: Grid of 0.1 degrees over the places; latitudes descend.
AXES = Axes(51.0, -0.1, 91, -1.0, 0.1, 81)
NODES = """nodes as (select node, value, node % 7 <> 0 as is_land, (node * 13 % 1500)::double as elev from
  (select unnest(range(7371)) as node) join (select p_partkey, p_retailprice::double as value from part) on p_partkey = node % (select count(*) from part) + 1)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid nodes with a value of part each; every seventh is sea."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("value"))
    ids = spark.range(AXES.n_lat * AXES.n_lon).withColumnRenamed("id", "node").crossJoin(F.broadcast(part.agg(F.count("*").alias("n"))))  # one row
    rows = ids.join(part, F.col("p_partkey") == F.col("node") % F.col("n") + 1)
    return rows.select("node", "value", (F.col("node") % 7 != 0).alias("is_land"), (F.col("node") * 13 % 1500).cast("double").alias("elev"))
