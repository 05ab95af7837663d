from pyspark.sql import functions as F

from lexigrade.streaming.latency import latency_windows


def test_stream_and_table_agree(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_s"))
    batch = latency_windows(rows, width="1 day").orderBy("start").collect()
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = latency_windows(stream, width="1 day").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows").orderBy("start").collect()
    assert [r[:5] for r in map(tuple, got)] == [r[:5] for r in map(tuple, batch)] and len(batch) > 1
