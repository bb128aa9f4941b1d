"""What an index writes and shuffles: texts and postings of a batch once, tables of the last delta joined with nothing."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import text_index as X
from lodestone.streaming import incremental as I

T0 = datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(kind, path, to, T0 + timedelta(seconds=s)) for s, (kind, path, to) in enumerate(rows)], I.EVENTS)


def followed(spark, folder, compact):
    """Batches that create, modify, delete and rename; the index and what it should hold after each."""
    world = {}
    index = I.IncrementalIndex(spark, folder, lambda p: p.join(spark.createDataFrame([*world.items(), ("other", "x")], "path string, content string"), "path"), compact=compact)
    world.update({f"p{k}": f"common w{k} w{k % 3}" for k in range(8)})
    index.apply(events(spark, *[("created", p, None) for p in world]), 0)
    yield index, world
    world.update(p1="again common", moved=world.pop("p2"))
    world.pop("p3")
    index.apply(events(spark, ("modified", "p1", None), ("renamed", "p2", "moved"), ("deleted", "p3", None), ("modified", "gone", None)), 1)
    yield index, world
    world.update(p3="third time common")
    index.apply(events(spark, ("created", "p3", None), ("modified", "p1", None)), 2)
    yield index, world
    world.update(p1="w5 w6")
    index.apply(events(spark, ("modified", "p1", None), ("deleted", "gone", None)), 3)
    yield index, world


def test_a_batch_that_merges_writes_its_texts_once(spark, tmp_path):
    for compact in (2, 3):
        for n, (index, world) in enumerate(followed(spark, str(tmp_path / f"i{compact}"), compact)):
            i = index.index()
            assert {r.path: r.content for r in index.docs().collect()} == world and i.doc_count() == len(world), (compact, n)
            assert {r.term: r.df for r in i.terms.collect()} == {r.term: r.n for r in X.TextIndex.build(i.docs.select("path", "content")).postings.groupBy("term").agg(F.count("*").alias("n")).collect()}
            assert {r.doc_id for r in i.scores("common").collect()} == {p for p, text in world.items() if "common" in text.split()}
        assert [index.stats[k] for k in ("created", "modified", "deleted", "renamed", "errors", "pending")] == [9, 4, 2, 1, 1, 0]
        assert index.log().count() == 8 + 5 + 2 + 2 and index.batch_done() == 3
    at = str(tmp_path / "i2")
    last = [n for n in os.listdir(at) if n.startswith("delta-b3")]
    assert len(last) == 1 and not {"docs", "postings", "terms"} & set(os.listdir(f"{at}/{last[0]}"))  # they are in the generation alone


def test_the_last_delta_is_joined_with_nothing(spark, tmp_path):
    runs = followed(spark, str(tmp_path / "i"), 9)
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join")
    for n in range(2):
        index, _ = next(runs)
        i = index.index()
        assert joins(i.postings) == n and (n or not joins(i.docs))


def exchanged(node):
    """The columns of each shuffle of a plan."""
    below = node.children()
    return ([node.output().mkString(",")] if node.nodeName() == "Exchange" else []) + [x for k in range(below.size()) for x in exchanged(below.apply(k))]


def test_texts_are_not_shuffled_to_leave_some_out(spark, tmp_path):
    """Over files of several blocks of 32,768 rows, and paths that are in none of them."""
    at = str(tmp_path / "i")
    docs = spark.range(0, 100_000, 1, 2).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("text "), "id").alias("content"))
    docs.write.parquet(f"{at}/gen-1/docs")
    docs.where("id % 7 = 0 or id between 30000 and 70000").select("path").union(spark.createDataFrame([("none",)], "path string")).write.parquet(f"{at}/d1/ops")
    docs.where("id % 11 = 0").select("path").write.parquet(f"{at}/d2/ops")
    docs.where("id % 7 = 0").withColumn("content", F.lit("first")).write.parquet(f"{at}/d1/docs")
    docs.where("id % 22 = 0").withColumn("content", F.lit("second")).write.parquet(f"{at}/d2/docs")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = X.live(spark, at, ["gen-1", "d1", "d2"], "docs")
        shuffles = exchanged(left._jdf.queryExecution().executedPlan().initialPlan())
        assert any("path" in x for x in shuffles) and not any("content" in x for x in shuffles)
        got = {r.path: r.content for r in left.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {str(k): "second" if k % 22 == 0 else "first" if k % 7 == 0 else f"text {k}" for k in range(100_000) if (k % 22 == 0 or k % 11) and (k % 7 == 0 or not 30000 <= k <= 70000 or k % 22 == 0)}


def test_postings_are_packed_for_the_shuffle(monkeypatch):
    """Packed and unpacked they are the same rows, each where its term and document belong, in few bytes."""
    rows = [(f"w{d * k % 97}", f"d{d}" if d else "", 1 + k % 3, list(range(k % 3 + 1)), 40, None if d % 5 == 0 else "en") for d in range(200) for k in range(40)]
    names = ["term", "doc_id", "tf", "positions", "length", "file_type"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 900], strict=True), kinds, strict=True)], names) for at in range(0, len(rows), 900)]
    for most in (1 << 20, 2000):
        monkeypatch.setattr(X, "PACKED", most)
        packed = list(X._packer(32, 3, False)(iter(batches)))
        places = {}
        back = []
        for b in packed:
            for p in b.to_pylist():
                for part in X._unpacked(iter([pa.RecordBatch.from_pylist([p], b.schema)])):
                    assert part.schema.names == [*names, "bucket"] and [part.schema.field(c).type for c in names] == kinds
                    for r in part.to_pylist():
                        assert r["bucket"] == p["bucket"] == X.bucket_of(r["term"], 32) and places.setdefault(r["doc_id"], p["deal"]) == p["deal"]
                        back.append(tuple(tuple(v) if isinstance(v, list) else v for v in r.values())[:-1])
        assert sorted(back, key=str) == sorted(((*r[:3], tuple(r[3]), *r[4:]) for r in rows), key=str) and set(places.values()) == {0, 1, 2}
    assert list(X._packer(32, 3, False)(iter([]))) == []


def test_saved_postings_are_where_their_terms_belong(spark, tmp_path):
    """Of texts and of given postings: the same rows, numbers as ids as well."""
    docs = spark.range(60).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 9), F.concat(F.lit("v"), F.col("id"))).alias("content"))
    made = X.TextIndex.build(docs, "id")
    made.save(str(tmp_path / "a"))
    X.TextIndex(made.docs, made.postings).save(str(tmp_path / "b"))
    want = sorted((r.term, r.doc_id, r.tf, r.positions, r.length, r.file_type, X.bucket_of(r.term)) for r in made.postings.collect())
    for folder in "ab":
        got = X.TextIndex.open(spark, str(tmp_path / folder)).postings
        assert sorted((r.term, r.doc_id, r.tf, r.positions, r.length, r.file_type, r.bucket) for r in got.collect()) == want
