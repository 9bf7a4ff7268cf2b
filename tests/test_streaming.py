import random

from pyspark.sql import functions as F

from quern.operators import dedup
from quern.sources import tables
from quern.streaming import streams


def test_clean_stream_resumes_and_replays(spark, tmp_path):
    good = '"""D."""\n# c\n' + "x = 1\n" * 30
    src = str(tmp_path / "in")
    spark.createDataFrame([(good, "stack"), ("bad", "stack")], "text string, tag string").write.parquet(src)
    run = lambda: streams.clean_to_jsonl(spark.readStream.schema("text string, tag string").parquet(src), "text", "tag", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert tables.jsonl(spark, str(tmp_path / "out")).count() == 1
    spark.createDataFrame([(good + "y = 2\n", "curated"), ("(", "curated")], "text string, tag string").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["tag"] for r in tables.jsonl(spark, str(tmp_path / "out")).collect()) == ["curated", "stack"]


def test_stream_dedup_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    bases = ["".join(rnd.choice("abcdefgh \n") for _ in range(400)) for _ in range(12)]
    rows = [(i, rnd.choice(bases) + rnd.choice(["", "x", " tail"])) for i in range(60)]
    src = str(tmp_path / "in")
    for lo in range(0, 60, 20):
        spark.createDataFrame(rows[lo : lo + 20], "seq long, content string").coalesce(1).write.mode("append").parquet(src)
        stream = streams.read_parquet_stream(spark, src, "seq long, content string")
        streams.dedup_stream(stream, "seq", "content", str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: r["kept"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["id"]: r["kept"] for r in dedup.near_dedup(spark.createDataFrame(rows, "seq long, content string")).collect()}
    assert got == want


def test_event_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(k, f"2024-01-01 0{k // 6}:{(k % 6) * 10:02d}:00", "a" if k % 2 else "b", 1.5) for k in range(24)]
    spark.createDataFrame(rows, "id long, t string, user_id string, value double").select("id", F.col("t").cast("timestamp").alias("ts"), "user_id", "value").coalesce(1).write.parquet(src)
    stream = streams.read_parquet_stream(spark, src, "id long, ts timestamp, user_id string, value double")
    q = streams.tumbling(stream, "ts", "1 hour", "2 hours", "user_id").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["n"]) for r in spark.sql("select * from tumbling").collect()) == [("a", 3)] * 4 + [("b", 3)] * 4
    q = streams.sessions(stream, gap="15 minutes").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from sessions").first()[0] == 24


def test_folders_are_listed_by_the_cluster_s_file_system(spark, tmp_path):
    from quern.plans.durable import children

    (tmp_path / "batch=1").mkdir()
    (tmp_path / "batch=0").mkdir()
    assert children(spark, f"file://{tmp_path}") == children(spark, str(tmp_path)) == ["batch=0", "batch=1"]
    assert children(spark, str(tmp_path / "none")) == []
