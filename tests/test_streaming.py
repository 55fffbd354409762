"""The streaming monitors, run to the end over files."""

import time

from pyspark.sql import functions as F

from graphloom.streaming import monitors as M


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def events(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, "a" if i % 2 else "b", "boom" if i % 5 == 0 else "fine", f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k string, line string, t string").withColumn("ts", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(path)
    return M.event_stream(spark, path, df.schema)


def test_dedupe(spark, tmp_path):
    assert run(M.dedupe(events(spark, tmp_path), ["k"], span="2 hours"), "deduped", "append").count() == 2


def test_windows(spark, tmp_path):
    got = run(M.attention_windows(events(spark, tmp_path), "k", span="10 minutes", slide="10 minutes"), "windows", "update")
    assert sorted((r.k, r.opens) for r in got.collect()) == [("a", 5), ("a", 5), ("b", 5), ("b", 5)]


def test_changed_paths(spark, tmp_path):
    got = run(M.changed_paths(events(spark, tmp_path), "k", span="30 minutes"), "paths", "update")
    assert sorted((r.k, r.n) for r in got.collect()) == [("a", 10), ("b", 10)]


def test_recent_lines(spark, tmp_path):
    got = {r.k: (r.seen, r.hits) for r in run(M.recent_lines(events(spark, tmp_path), "k", "line", "boom", keep=50), "recent", "update").collect()}
    assert got == {"a": (10, 2), "b": (10, 2)}


def test_lines_that_follow_one_another(spark, tmp_path):
    got = {r.k: r.hits for r in run(M.recent_lines(events(spark, tmp_path), "k", "line", r"^boom$\n^fine$", keep=50), "follow", "update").collect()}
    lines = {k: ["boom" if i % 5 == 0 else "fine" for i in range(20) if (i % 2 == 1) == (k == "a")] for k in "ab"}
    assert got == {k: sum(x == "boom" and y == "fine" for x, y in zip(v, v[1:])) for k, v in lines.items()}


def test_snapshot_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    q = events(spark, tmp_path).writeStream.foreachBatch(M.snapshot_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == 20


def test_debounce_and_gate(spark, tmp_path):
    path, schema = str(tmp_path / "changes"), "root string, path string, kind string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put([("a", f"a{i}.go", "change") for i in range(11)] + [("a", "a0.go", "change")] * 2 + [("b", None, "index_start"), ("b", "b.go", "change"), ("a", None, "change"), ("a", "x", "other")])
    q = M.debounced(M.event_stream(spark, path, schema), quiet=200, tick=500, parts=4).writeStream.outputMode("append").format("memory").queryName("debounced").start()

    def until(n):
        end = time.time() + 60
        while spark.table("debounced").count() < n and time.time() < end:
            time.sleep(0.5)
        return sorted((r.root, r.path, r.changes) for r in spark.table("debounced").collect())

    try:
        first = until(11)
        assert first == sorted(("a", f"a{i}.go", 3 if i == 0 else 1) for i in range(11))  # a batch of one root; the other is shut
        put([("b", "b.go", "change"), ("a", "a1.go", "change")])
        assert until(12) == sorted([*first, ("a", "a1.go", 1)])
        time.sleep(1.5)
        assert spark.table("debounced").count() == 12
        put([("b", None, "index_end")])
        assert until(13) == sorted([*first, ("a", "a1.go", 1), ("b", "b.go", 2)])
        assert spark.table("debounced").filter("waited_ms < 200").count() == 0
    finally:
        q.stop()
