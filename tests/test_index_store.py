"""Saved indexes: pointers that survive dying writers, counts of terms in deltas, forms of terms, folders that a query reads."""

import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from lodestone.errors import IndexConflict
from lodestone.operators import text_index as X
from lodestone.streaming import incremental as I

T0 = datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(kind, path, None, T0 + timedelta(seconds=s)) for s, (kind, path) in enumerate(rows)], I.EVENTS)


def reader(spark, world):
    return lambda paths: paths.join(spark.createDataFrame(list(world.items()), "path string, content string"), "path")


class Killed(Exception):
    pass


def test_a_writer_may_die_at_any_step(spark, tmp_path, monkeypatch):
    world = {"a": "one two", "b": "two three"}
    folder = str(tmp_path / "i")
    I.IncrementalIndex(spark, folder, reader(spark, world)).apply(events(spark, ("created", "a"), ("created", "b")), 0)
    world["a"] = "four"
    change = events(spark, ("modified", "a"), ("deleted", "b"))
    write, left = DataFrameWriter.parquet, [0]

    def dies(self, path, *a, **k):
        if left[0] == 0:
            raise Killed
        left[0] -= 1
        return write(self, path, *a, **k)

    for step in (0, 3, 5):
        left[0] = step
        with monkeypatch.context() as m, pytest.raises(Killed):
            m.setattr(DataFrameWriter, "parquet", dies)
            I.IncrementalIndex(spark, folder, reader(spark, world)).apply(change, 1)
        left_over = I.IncrementalIndex(spark, folder, reader(spark, world))
        assert left_over.batch_done() == 0 and {r.path for r in left_over.docs().collect()} == {"a", "b"}
    with monkeypatch.context() as m, pytest.raises(Killed):
        m.setattr(I, "point", lambda *a: (_ for _ in ()).throw(Killed()))
        I.IncrementalIndex(spark, folder, reader(spark, world)).apply(change, 1)
    again = I.IncrementalIndex(spark, folder, reader(spark, world))
    assert {r.path for r in again.docs().collect()} == {"a", "b"}
    assert again.apply(change, 1) and {(r.path, r.content) for r in again.docs().collect()} == {("a", "four")}


def test_of_two_writers_one_is_told(spark, tmp_path):
    folder = str(tmp_path / "i")
    assert X.pointed(spark, folder) == (0, [])
    X.point(spark, folder, "gen-1", 0)
    with pytest.raises(IndexConflict):
        X.point(spark, folder, "gen-2", 0)
    assert X.pointed(spark, folder) == (1, ["gen-1"])
    for k in range(1, X.POINTERS + 5):
        X.point(spark, folder, f"gen-{k} delta", k)
    assert X.pointed(spark, folder) == (X.POINTERS + 5, [f"gen-{X.POINTERS + 4}", "delta"])
    kept = [p.name for p in (tmp_path / "i" / "pointers").iterdir() if not p.name.startswith(".")]
    assert len(kept) == X.POINTERS and not any(n.startswith("new-") for n in kept)


def test_counts_of_terms_after_deltas(spark, tmp_path):
    world = {f"p{k}": f"common w{k} w{k % 3} again again" for k in range(9)}
    index = I.IncrementalIndex(spark, str(tmp_path / "i"), reader(spark, world), compact=2)
    index.apply(events(spark, *[("created", p) for p in world]), 0)
    world["p1"], world["new"] = "common rare", "fresh wurds common"
    index.apply(events(spark, ("modified", "p1"), ("created", "new"), ("deleted", "p2")), 1)  # merged into one generation
    world.pop("p3")
    world["p4"] = "common worda"
    index.apply(events(spark, ("deleted", "p3"), ("modified", "p4")), 2)
    i = index.index()
    want = {r.term: r.n for r in i.postings.groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert {r.term: r.df for r in i.terms.collect()} == want
    whole = X.TextIndex.build(i.docs.select("path", "content"))
    for q in ("common", "w1 again", "wor*", "~wards", "~comon w0", "w* NOT again"):
        assert [(r.path, round(r.score, 9)) for r in i.search(q).collect()] == [(r.path, round(r.score, 9)) for r in whole.search(q).collect()], q


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcd", max_size=14), st.lists(st.tuples(st.sampled_from("irdt"), st.integers(0, 14), st.sampled_from("abcdx")), max_size=2))
def test_terms_within_the_edits_share_a_form(a, edits):
    b = a
    for kind, at, c in edits:
        at = min(at, len(b))
        b = {"i": b[:at] + c + b[at:], "r": b[:at] + c + b[at + 1 :], "d": b[:at] + b[at + 1 :], "t": b[:at] + b[at + 1 : at + 2] + b[at : at + 1] + b[at + 2 :]}[kind]
    assert X.damerau(a, b, 9) <= 2 and set(X.forms(a)) & set(X.forms(b))


def test_forms_of_columns(spark):
    words = ["", "a", "ab", "abc", "straße", "日本語テキスト", "aaaaaaaaaaaaaa", "abcdefghijklmnop"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.shortened(F.col("w")).alias("s")).collect()
    assert {r.w: sorted(r.s) for r in got} == {w: X.forms(w) for w in words}


def folders(df):
    plan = df._jdf.queryExecution().toString()
    return [sorted(map(int, x.split(","))) for x in re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([\d,]+)\)", plan)] + [[int(x)] for x in re.findall(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = (\d+)\)", plan)]


def test_fuzzy_and_prefix_read_the_folders_of_their_terms(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(300)] + ["needle", "neddle", "needles", "needlework"]
    docs = spark.createDataFrame([(f"d{k}", " ".join(r.choice(words) for _ in range(30))) for k in range(120)] + [("n", "needle neddle needlework needles")], "path string, content string")
    made = X.TextIndex.build(docs)
    made.save(str(tmp_path / "i"))
    i = X.TextIndex.open(spark, str(tmp_path / "i"))
    for q in ("~needle", "need*", "+need* ~abcde", f"~{words[0]} {words[1]}", f"{words[2][:3]}* NOT {words[3]}"):
        assert [(x.path, round(x.score, 9)) for x in i.search(q).collect()] == [(x.path, round(x.score, 9)) for x in made.search(q).collect()], q
    for q in ("~needle", "need*"):
        read = folders(i.scores(q))
        assert read and all(len(x) < X.BUCKETS / 2 for x in read), q
    near = i.expand(X.parse("~needle"))
    own = {X.bucket_of(x) for x in X.forms("needle")}
    assert set(folders(near)[0]) == own and len(own) < X.BUCKETS
    plan = i.expand(X.parse("need*"))._jdf.queryExecution().toString()
    assert "StringStartsWith(term,need)" in plan
    many = X.LISTED
    try:
        X.LISTED = 2  # beyond, terms are joined: the same rows
        assert [x.path for x in i.search("need* ~abcde").collect()] == [x.path for x in made.search("need* ~abcde").collect()]
    finally:
        X.LISTED = many


def test_positions_are_read_for_phrases_only(spark, tmp_path):
    X.TextIndex.build(spark.createDataFrame([("a", "one two three")], "path string, content string")).save(str(tmp_path / "i"))
    i = X.TextIndex.open(spark, str(tmp_path / "i"))
    reads = lambda q: re.findall(r"ReadSchema: struct<([^>]*)", i.scores(q)._jdf.queryExecution().toString())
    assert not any("positions" in x for x in reads("one +two")) and any("positions" in x for x in reads('"one two"'))


def test_folders_by_size():
    assert X.buckets_for(0) == X.BUCKETS and X.buckets_for(2e9) == 100 and X.buckets_for(1e15) == X.MOST_BUCKETS
