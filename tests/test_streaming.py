from pyspark.sql import functions as F

from turfline.streaming.runs import EVENTS, event_stream, windowed_counts

from .support import DATA, from_spark


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.select(*[c.split()[0] for c in EVENTS.split(", ")]).repartition(3).write.parquet(folder)
    stream = windowed_counts(event_stream(spark, folder)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    batch = windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    assert from_spark(spark.table("counts")) == from_spark(batch)
