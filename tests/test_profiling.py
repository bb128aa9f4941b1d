import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from lodestone.operators import kernels, profiling, sampling
from lodestone.operators.positions import with_positions
from pyspark.sql import functions as F


def frame(spark, *columns, names=None, kind="double"):
    names = names or [f"c{k}" for k in range(len(columns))]
    cast = (lambda v: None if v is None else float(v)) if kind == "double" else (lambda v: v)
    return spark.createDataFrame([(i, *map(cast, r)) for i, r in enumerate(zip(*columns, strict=True))], "i bigint, " + ", ".join(f"`{n}` {kind}" for n in names))


def where(df, order=("i",)):
    out = {}
    for r in profiling.outliers(df.drop(), [c for c in df.columns if c != "i"], list(order)).collect():
        out.setdefault(r.column, set()).add(r.row)
    return out


def test_missing_and_columns(spark):
    df = spark.createDataFrame([(25, "a"), (30, "a"), (None, "b"), (35, None), (40, "b")], "age int, s string")
    assert {(r.column, r.missing, r.percentage) for r in profiling.missing_values(df).collect()} == {("age", 1, 20.0), ("s", 1, 20.0)}
    assert {(r.column, r.distinct, r.missing) for r in profiling.column_stats(df).collect()} == {("age", 5, 1), ("s", 3, 1)}
    assert {(r.column, r.nullable, r.rows) for r in profiling.schema_summary(df).collect()} == {("age", True, 5), ("s", True, 5)}
    none = df.limit(0)
    assert profiling.missing_values(none).collect() == [] and profiling.duplicate_rows(none).first()[0] == 0
    assert all(r.percentage == 0.0 for r in profiling.schema_summary(none).collect())


def test_duplicates(spark):
    rows = [(1, 10), (2, 20), (3, 30), (2, 20), (1, 10), (None, None), (None, None)]
    assert profiling.duplicate_rows(spark.createDataFrame(rows[:5], "a int, b int")).first()[0] == 4
    assert profiling.duplicate_rows(spark.createDataFrame(rows, "a int, b int")).first()[0] == 6


def test_outliers(spark):
    df = frame(spark, [1.0, 2, 3, 4, 5, 100], [10.0, 20, 30, 40, 50, 500], [1.0, 2, 3, 4, 5, 6])
    assert where(df) == {"c0": {5}, "c1": {5}}
    assert where(frame(spark, [None, None, 1.0, 2.0, 3.0])) == {}
    assert where(frame(spark, [1.0, 2, 3, 4, 5, float("nan"), 100, -math.inf])) == {"c0": {7}}
    assert where(frame(spark, [None] * 3)) == {}
    s = {r.column: r for r in profiling.outlier_summary(df.drop("i")).collect()}
    assert s["c0"].outliers == 1 and s["c0"].rows == [5] and round(s["c0"].percentage, 2) == 16.67


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_quartiles_are_the_picked_ranks(spark, values):
    got = profiling.quartiles(frame(spark, values, kind="int"), ["c0"])["c0"]
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    want = ordered[len(values) // 4], ordered[3 * len(values) // 4]
    assert got == (None if None in want else want)


def test_suggestions(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, 3.0), (2, 4.0), (3, 100.0)], "age int, score double")
    got = [(r.severity, r.kind, r.column) for r in profiling.suggestions(df).collect()]
    assert got == [("warning", "missing", "age"), ("warning", "outliers", "score")]
    half = spark.createDataFrame([(None,), (None,), (1,), (2,)], "a int")
    assert [(r.severity, r.kind) for r in profiling.suggestions(half).collect()] == [("warning", "duplicates"), ("warning", "missing")]
    assert profiling.suggestions(spark.createDataFrame([(None,)] * 4 + [(1,)], "a int")).first().severity == "error"
    assert "missing  age: 2 (40.0%)" in profiling.report(df)
    assert profiling.json_structure([{"a": 1}, {"b": 1}, 3]) == {"length": 3, "fields": 1, "inconsistent": 1}


def test_positions_and_samples(spark):
    df = spark.range(23).repartition(5)
    assert [r.id for r in sampling.smart(df, 5, ["id"]).collect()] == [0, 4, 8, 12, 16]
    assert [r.id for r in sampling.head(df, 3, ["id"]).collect()] == [0, 1, 2] and [r.id for r in sampling.tail(df, 3, ["id"]).collect()] == [20, 21, 22]
    assert sampling.smart(df, 0).count() == 0 and sampling.smart(df, 50, ["id"]).count() == 23
    r = [x.id for x in sampling.random(df, 7, 3, ["id"]).collect()]
    assert len(set(r)) == 7 and r == sorted(r)
    assert sampling.strategy("HEAD") == "head" and sampling.strategy("x") == "smart" and sampling.sample(df, "tail", 2, ["id"]).count() == 2
    p = with_positions(df, ["id"]).collect()
    assert all(x.id == x["_pos"] for x in p) and sorted(x["_pos"] for x in with_positions(df).collect()) == list(range(23))
    assert [x.id for x in sampling.tail(spark.range(0, 10, 1, 3), 2).collect()] == [8, 9]


def test_kernels(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    r = df.agg(kernels.total("x"), kernels.mean("x"), kernels.variance("x"), kernels.std_dev("x"), kernels.minimum("x"), kernels.maximum("x")).first()
    assert r[0] == 40 and r[1] == 5 and r[2] == pytest.approx(4.571428571428571) and r[3] == pytest.approx(2.1380899352993947) and (r[4], r[5]) == (2, 9)
    assert df.limit(0).agg(kernels.total("x"), kernels.mean("x")).first()[:] == (0.0, None)
    assert df.limit(1).agg(kernels.variance("x")).first()[0] is None
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert nan.agg(kernels.maximum("x")).first()[0] == 1.0
    assert df.agg(kernels.percentile_rank(F.collect_list("x"), 95)).first()[0] == 9.0


def test_duplicates_by_digest(spark, monkeypatch):
    """Equal rows have equal digests, whatever zeros, nulls and not-a-numbers they hold; digests that meet by chance are told apart."""
    rows = [(0.0, None, "a"), (-0.0, None, "a"), (float("nan"), 1, None), (float("nan"), 1, None), (1.0, 2, "b"), (1.0, 2, "c"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "x double, y int, z string")
    assert profiling.duplicate_rows(df).first()[0] == 6
    assert profiling.duplicate_rows(df.where("x = 1")).first()[0] == 0
    monkeypatch.setattr(profiling, "REPEATED", 1)
    assert profiling.duplicate_rows(df).first()[0] == 6
    monkeypatch.setattr(profiling.F, "xxhash64", lambda *c: profiling.F.lit(1).cast("bigint"))
    assert profiling.duplicate_rows(df).first()[0] == 6
