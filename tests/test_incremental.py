from datetime import datetime, timedelta

from lodestone.streaming import incremental as I
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def event(kind, path, ms, to=None):
    return (kind, path, to, T0 + timedelta(milliseconds=ms))


def test_debounce_filter_and_operations(spark):
    df = spark.createDataFrame([event("created", "a", 0), event("modified", "a", 100), event("modified", "a", 200), event("deleted", "a", 5000), event("modified", "b", 0)], I.EVENTS)
    got = {(r.path, r.kind, r.merged) for r in I.debounce(df).collect()}
    assert got == {("a", "modified", 3), ("a", "deleted", 1), ("b", "modified", 1)}
    paths = spark.createDataFrame([(p,) for p in ("x/.hidden", "node_modules/test.js", "test.tmp", "src/main.rs")], "p string")
    assert [r.p for r in paths.where(I.event_filter(F.col("p"), ["node_modules", "*.tmp"])).collect()] == ["src/main.rs"]
    ops = I.operations(spark.createDataFrame([event("renamed", "a", 0, "b"), event("other", "c", 0)], I.EVENTS))
    assert {(r.path, r.op) for r in ops.collect()} == {("a", "delete"), ("b", "put")}
    assert [r[0] for r in spark.createDataFrame([("Create",), ("Modify",), ("Remove",), ("Access",)], "k string").select(I.event_kind(F.col("k"))).collect()] == ["created", "modified", "deleted", None]


def test_batches_are_idempotent(spark, tmp_path):
    world = {"a": "one", "b": "two"}
    read = lambda paths: paths.join(spark.createDataFrame(list(world.items()), "path string, content string"), "path")
    index = I.IncrementalIndex(spark, str(tmp_path / "i"), read)
    now = lambda: {r.path: r.content for r in index.docs().collect()}
    assert index.docs() is None
    first = spark.createDataFrame([event("created", "a", 0), event("created", "b", 1), event("created", "gone", 2)], I.EVENTS)
    assert index.apply(first, 0) and now() == world
    world["a"] = "uno"
    second = spark.createDataFrame([event("modified", "a", 10), event("deleted", "b", 11)], I.EVENTS)
    assert index.apply(second, 1) and now() == {"a": "uno"}
    assert not index.apply(second, 1) and now() == {"a": "uno"}
    world["c"] = world.pop("a")
    assert index.apply(spark.createDataFrame([event("renamed", "a", 20, "c")], I.EVENTS), 2) and now() == {"c": "uno"}
    assert index.recent(2).count() == 2 and index.stats["created"] == 3


def test_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [event("created", "a", 0), event("modified", "a", 100), event("created", ".hid", 0), event("created", "late", 60_000)]
    spark.createDataFrame(rows, I.EVENTS).coalesce(1).write.json(src)
    read = lambda paths: paths.select("path", F.concat(F.lit("text of "), "path").alias("content"))
    index = I.IncrementalIndex(spark, str(tmp_path / "i"), read)
    q = index.run(spark.readStream.schema(I.EVENTS).json(src), str(tmp_path / "ck"), delay="1 second", availableNow=True)
    registry = I.StreamRegistry()
    registry.add("docs", q)
    assert registry.status()[0]["name"] == "docs"
    q.awaitTermination(90)
    assert {r.path for r in index.docs().collect()} == {"a"}  # the last burst waits for the watermark to pass
    assert registry.stop("docs") and not registry.stop("docs")
