from pyspark.sql import functions as F

from covey.streaming.copart import windowed_weights


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2020-01-01 10:00:00", [1, 2, 3]), ("2020-01-01 11:00:00", [2, 3]), ("2020-01-02 01:00:00", [1, 3]), ("2020-01-03 00:00:00", [5])]
    table = spark.createDataFrame(rows, "ts string, members array<long>").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = windowed_weights(stream).writeStream.outputMode("complete").format("memory").queryName("weights").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((str(r.window.start), r.src, r.dst, r.weight) for r in spark.table("weights").collect())
    want = sorted((str(r.window.start), r.src, r.dst, r.weight) for r in windowed_weights(table).collect())
    assert got == want and len(got) == 4
