"""The snapshot source in batch and as a stream, and stateful streaming operators."""

from pyspark.sql import functions as F

from siltweb.functions import urls
from siltweb.sources import snapshot
from siltweb.streaming import crawl_stream


def test_snapshot_in_batch_and_as_stream(spark, small, tmp_path):
    snapshot.register(spark)
    path = f"file://{small}/pages.parquet"
    want = spark.read.parquet(path).count()
    assert spark.read.format("webpages").load(path).where("status = 200").count() == want
    stream = spark.readStream.format("webpages").load(path)
    q = crawl_stream.seen_once(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == spark.read.parquet(path).select(urls.canonicalize(F.col("url"))).distinct().count()


def test_polite_starts(spark, tmp_path):
    rows = [("a", f"u{k}", 10 * k) for k in range(5)] + [("b", "v", 3)]
    folder = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "origin string, url string, arrived_ms long").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("origin string, url string, arrived_ms long").option("maxFilesPerTrigger", 1).parquet(folder)
    q = crawl_stream.polite_starts(stream, 25).writeStream.format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["origin"], r["url"]): r["start_ms"] for r in spark.table("starts").collect()}
    assert [got["a", f"u{k}"] for k in range(5)] == [0, 25, 50, 75, 100] and got["b", "v"] == 3


def test_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = crawl_stream.counts_by_window(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    assert got and all(want[k] == n for k, n in got.items())
