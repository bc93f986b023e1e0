"""The stream gives the batch's days, but for those that the watermark still holds open."""

from pyspark.sql import functions as F

from townmeter.operators.grid import hourly_to_daily
from townmeter.streaming.daily import stream_daily


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 4).alias("node"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("t2m"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_daily(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(str, spark.sql("select node, day, tmax, tmin from days").collect()))
    batch = hourly_to_daily(events).select("node", "day", "tmax", "tmin")
    last = batch.agg(F.max("day")).first()[0]
    want = sorted(map(str, batch.filter(F.col("day") < F.date_sub(F.lit(last), 2)).collect()))
    assert want and set(want) <= set(got) <= set(map(str, batch.collect()))
