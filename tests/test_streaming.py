"""Windowed statistics of a stream against the same of the whole table."""

from pyspark.sql import functions as F

from brickfield import streaming

SF = "/root/testdata/sf0.001"


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    # Two files in order of time, so that nothing is late; a last row far ahead closes all windows before it.
    middle = events.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0]
    early, later = F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle
    end = spark.createDataFrame([("2100-01-01 00:00:00", 0, 1.0)], "ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    source = str(tmp_path / "in")
    for part in (events.where(early), events.where(later), end):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    streaming.write_statistics(stream, str(tmp_path / "out"), str(tmp_path / "ck"), by="user_id").awaitTermination()
    got = {(r.start, r.user_id): (r.n, round(r.mean, 9), r.low, r.high) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.user_id): (r.n, round(r.mean, 9), r.low, r.high) for r in streaming.windowed_statistics(events, by="user_id").collect()}
    assert got == want and len(got) > 100
