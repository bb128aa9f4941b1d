"""What an index costs: texts are taken apart as few times as it takes, pages share one scoring."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import text_index as X

WORDS = "aa Bb cc_1 dd 数据处理 ee"


def some(spark, n=95):
    return spark.range(n).select(F.format_string("p%03d", "id").alias("path"), F.concat(F.repeat(F.lit("word "), F.col("id").cast("int") % 7 + 1), F.lit(WORDS)).alias("content"))


def test_pages_share_one_scoring(spark, monkeypatch):
    i, calls = X.TextIndex.build(some(spark)), []
    scores = X.TextIndex.scores
    monkeypatch.setattr(X.TextIndex, "scores", lambda *a, **k: calls.append(1) or scores(*a, **k))
    pages = list(i.pages("word", 10))
    assert len(calls) == 1 and [len(p) for p in pages] == [10] * 9 + [5]
    assert [r for p in pages for r in p] == i.search("word", 1000).collect()
    assert [len(p) for p in i.pages("word", 95)] == [95] and list(i.pages("nowhere", 10)) == list(i.pages("", 10)) == []
    placed = i.placed("word", 10).agg(F.count_distinct("page"), F.max("place")).first()
    assert tuple(placed) == (10, 94)


def test_building_counts_nothing_before_it_is_asked(spark, tmp_path, monkeypatch):
    counted = []
    monkeypatch.setattr(X, "_counted", lambda docs, f=X._counted: counted.append(docs.inputFiles()) or f(docs))
    i = X.TextIndex.build(some(spark))
    assert not counted
    i.save(str(tmp_path / "i"))
    assert len(counted) == 1 and all("/docs/" in f for f in counted[0])  # lengths of the saved table, no texts
    assert X.TextIndex.open(spark, str(tmp_path / "i")).stats == i.stats == (95, sum(k % 7 + 9 for k in range(95)) / 95)


def test_postings_of_a_batch(monkeypatch):
    monkeypatch.setattr(X, "POSTED", 3)
    lists = [["b", "a", "b"], [], None, ["a"], ["c", "c", "c", "a"]]
    b = pa.RecordBatch.from_arrays([pa.array(list("vwxyz")), pa.array(range(5)), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "length", "tokens"])
    for part in (b, b.slice(3)):
        got = {(r["term"], r["doc_id"], r["tf"], tuple(r["positions"]), r["length"]) for x in X._posted(iter([part])) for r in x.to_pylist()}
        want = {(t, d, w.count(t), tuple(np.flatnonzero(np.array(w) == t)), n) for d, n, w in zip("vwxyz", range(5), lists, strict=True) if w and d in part.column(0).to_pylist() for t in set(w)}
        assert got == want


def test_forms_are_few(spark):
    assert max(len(r.s) for r in spark.createDataFrame([("abcdefghijkl",), ("abcdef",), ("ab",)], "w string").select(X.shortened(F.col("w")).alias("s")).collect()) == 15
