from pyspark.sql import functions as F

from spanwise.streaming import stream_band_join


def test_pairs_of_streams(spark, tmp_path):
    rows = [(k, f"2024-01-{1 + k:02d} 00:00:00") for k in range(6)]
    spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    read = lambda p: spark.readStream.schema("k long, t timestamp").parquet(str(tmp_path / "in")).select((F.col("k") % 2).alias(f"{p}_key"), F.col("t").alias(f"{p}_t"))
    joined = stream_band_join(read("a"), read("b"), "a_t", "b_t", "2 days", [("a_key", "b_key")], "1 day")
    query = joined.writeStream.format("memory").queryName("pairs").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("pairs").count() == 6 + 2 * 4
