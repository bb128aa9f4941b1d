import json
from datetime import datetime

import pytest
from lodestone.errors import ExportError
from lodestone.operators import export as E
from lodestone.operators import history as H
from lodestone.operators import vectors as V
from pyspark.sql import functions as F


def test_history(spark, tmp_path):
    h = H.History(str(tmp_path / "h.json"))
    for q, p, t in (("error", "logs", "log"), ("Error", "logs", "log"), ("error", "src", "rs"), ("warning", "logs", None)):
        h.record(H.Entry(q, p, t, results=4, ms=10))
    df = H.History(str(tmp_path / "h.json")).frame(spark)
    assert [tuple(r) for r in H.frequencies(df).collect()] == [("error", 3), ("warning", 1)]
    s = H.statistics(df, "ERR").first()
    assert (s["count"], s.mean_results, s.path) == (3, 4.0, "logs") and H.statistics(df, "nope").count() == 0
    assert {tuple(r) for r in H.co_occurrence(df).collect()} == {("logs", "log", 2), ("src", "rs", 1)}
    assert [r.query for r in H.recent(df, 2).collect()] == ["warning", "error"]
    got = {(r.kind, r.value): r.confidence for r in H.recommend(df, "err").collect()}
    assert got[("query", "error")] == pytest.approx(0.3) and got[("path", "logs")] == 0.7 and got[("search_type", "standard")] == 0.6
    assert {r.value for r in H.recommend(df, "py files", 9).where("kind = 'file_type'").collect()} == {"log", "rs"}
    assert len(h) == 4
    h.clear()
    assert len(h) == 0 and h.record(H.Entry("x")) == 5
    ago = spark.range(1).select(*[H.time_ago(F.lit(datetime(2024, 1, 1)), F.lit(x)) for x in (datetime(2024, 1, 1, 0, 0, 9), datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 3))]).first()
    assert tuple(ago) == ("9s ago", "5min ago", "2d ago")


def test_session(tmp_path):
    p = tmp_path / "s.json"
    s = H.SessionContext(str(p))
    for k in range(7):
        s.add("query", f"t{k}", "SELECT " + "x" * 99)
    s.set("a", "b")
    again = H.SessionContext(str(p))
    assert len(again.get()) == 7 and len(again.get(short=True)) == 3 and again.variables == {"a": "b"}
    assert again.inject("go").startswith("- query t6") and again.inject("go").count("\n") == 5
    p.write_text("{broken")
    assert H.SessionContext(str(p)).get() == [] and json.loads(s.export())["variables"] == {"a": "b"}
    assert H.token_savings(1000, 100)["saved"] == 450


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None, [1]), (2, 'q"', 1.5, None)], "id int, s string, x double, a array<int>")
    n = E.export(df, str(tmp_path / "o.csv"), E.ExportOptions(single=True))
    assert (tmp_path / "o.csv").read_text() == 'id,s,x,a\n1,"a,b",,[1]\n2,"q""",1.5,\n' and n == (tmp_path / "o.csv").stat().st_size
    E.export(df.orderBy("id"), str(tmp_path / "o.jsonl"), E.ExportOptions(single=True))
    assert json.loads((tmp_path / "o.jsonl").read_text().split("\n")[0]) == {"id": 1, "s": "a,b", "x": None, "a": [1]}
    E.export(df, str(tmp_path / "o.parquet"), E.ExportOptions(compression="zstd"))
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    E.export(df, str(tmp_path / "o.arrow"), E.ExportOptions(single=True))
    import pyarrow as pa

    assert pa.ipc.open_file(str(tmp_path / "o.arrow")).read_all().to_pydict()["s"] == ["a,b", 'q"']
    assert E.convert(spark, str(tmp_path / "o.parquet"), str(tmp_path / "c.json")) > 0
    E.export(df.limit(0).select("id", "x"), str(tmp_path / "e.csv"), E.ExportOptions(single=True))
    assert (tmp_path / "e.csv").read_text() in ("id,x\n", "")
    with pytest.raises(ExportError):
        E.export(df, str(tmp_path / "o.csv"), E.ExportOptions(single=True))
    with pytest.raises(ExportError):
        E.format_of("x.xls")
    assert list(E.lines(df.select("id", "s"))) == ["id,s", '1,"a,b"', '2,"q"""'] and json.loads(next(E.lines(df, "json")))["a"] == [1]
    assert "..." in E.render(spark.createDataFrame([("x" * 80, 1.23456)], "s string, f double")) and "first 2 rows" in E.render(spark.range(5), rows=2)
    assert E.preview(df)["rows"] == 2 and E.preview_json('[{"a": 1}, {"a": 2}]') == [["a"], ["1"], ["2"]] and E.preview_json('{"k": [1]}') == [["k", "[1]"]]
    assert json.loads(E.json_objects(df).first()[0])["x"] is None


def test_vectors(spark):
    f = lambda *a: F.array(*[F.lit(float(x)) for x in a]) if a else F.array().cast("array<double>")
    r = spark.range(1).select(V.cosine(f(1, 2), f(2, 4)), V.cosine(f(1, 0), f(0, 1)), V.cosine(f(1), f(-1)), V.cosine(f(), f()), V.cosine(f(1), f(1, 2)), V.cosine(f(0, 0), f(1, 2)), V.l2_normalize(f(3, 4)), V.l2_normalize(f(0, 0))).first()
    assert list(r[:6]) == pytest.approx([1, 0, -1, 0, 0, 0]) and r[6] == pytest.approx([0.6, 0.8]) and r[7] == [0.0, 0.0]
    pool = spark.range(1).select(V.mean_pool(F.array(f(1, 2), f(3, 4), f(9, 9)), F.array(F.lit(1), F.lit(1), F.lit(0))), V.mean_pool(F.array(f(1, 2)), F.array(F.lit(0)))).first()
    assert pool[0] == [2.0, 3.0] and pool[1] == [0.0, 0.0]
    i = V.VectorIndex(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<float>"))
    i = i.add(spark.createDataFrame([(3, [1.0, 1.0])], "id int, embedding array<float>"))
    assert [x.id for x in i.search([1.0, 0.1], 2).collect()] == [1, 3] and i.count() == 3 and i.clear().search([1.0]).count() == 0


def test_arrow_parts_and_a_failed_task(spark, tmp_path):
    """Each task writes a file; a job that fails leaves none; nothing is collected."""
    from lodestone.engine import Engine
    from lodestone.errors import ExportError
    from lodestone.sources.readers import read_arrow

    where = str(tmp_path / "parts.arrow")
    df = spark.range(1000, numPartitions=4).selectExpr("id", "array(id, id + 1) AS a", "named_struct('x', cast(id AS string)) AS s", "timestamp_seconds(id) AS t")
    Engine(spark).sql("SELECT 1").collect()  # now another session is the active one
    assert E.export(df, where) > 0
    names = sorted(p.name for p in (tmp_path / "parts.arrow").iterdir())
    assert names[0] == "_SUCCESS" and len([n for n in names if n.endswith(".arrow")]) == 4 and "_temporary" not in names
    assert sorted(r.id for r in read_arrow(spark, where).where("s.x = cast(id AS string) AND a[1] = id + 1").collect()) == list(range(1000))
    with pytest.raises(ExportError):
        E.export(df, where)
    E.export(df.limit(3), where, E.ExportOptions(mode="overwrite"))
    assert read_arrow(spark, where).count() == 3
    bad = str(tmp_path / "bad.arrow")
    with pytest.raises(Exception, match="boom"):
        E.export(df.selectExpr("CASE WHEN id = 900 THEN raise_error('boom') ELSE id END AS x"), bad)
    left = [p for p in (tmp_path / "bad.arrow").rglob("*") if p.is_file()] if (tmp_path / "bad.arrow").exists() else []
    assert left == []
    none = str(tmp_path / "none.arrow")
    E.export(df.where("id < 0"), none)
    assert read_arrow(spark, none).count() == 0 and read_arrow(spark, none).columns == df.columns


@pytest.mark.parametrize("when", ["before", "during"])
def test_arrow_task_that_outlives_its_job_leaves_nothing(tmp_path, monkeypatch, when):
    import pyarrow as pa
    from lodestone.sources import arrow_sink
    from pyspark.sql.types import LongType, StructType

    task = type("Task", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 7})()
    monkeypatch.setattr(arrow_sink.TaskContext, "get", lambda: task)
    writer = arrow_sink.ArrowWriter(str(tmp_path / "a.arrow"), StructType().add("x", LongType()), False)
    x = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])

    def rows():
        yield x
        writer.abort([])
        yield x

    if when == "before":
        writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([x]) if when == "before" else rows())
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
