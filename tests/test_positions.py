"""Positions of tables of many files: the order of files and rows, without copies of the rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import positions, profiling, sampling

SIZES = [(0, 10), (10, 5000), (5000, 5100), (5100, 5103)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Files of unequal size, the small ones first and last; a blank in the name."""
    root = tmp_path_factory.mktemp("some files")
    for kind in ("parquet", "csv"):
        for k, (a, b) in enumerate(SIZES):
            part = str(root / f"{kind}-{k}")
            df = spark.range(a, b, 1, 1).select(F.col("id"), (F.col("id") % 7).alias("m"), F.when(F.col("id") % 1000 == 999, 1e9).otherwise(F.col("id") % 5).alias("x"))
            (df.write.parquet(part) if kind == "parquet" else df.write.option("header", True).csv(part))
            found = next(p for p in (root / f"{kind}-{k}").iterdir() if p.name.startswith("part-"))
            (root / kind).mkdir(exist_ok=True)
            found.rename(root / kind / f"f {k}.{kind}")
    return root


@pytest.fixture(params=["parquet", "csv", "small blocks"])
def table(request, spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if request.param == "parquet":
        yield spark.read.parquet(str(folder / "parquet"))
    else:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000" if request.param == "small blocks" else old)
        yield spark.read.option("header", True).schema("id bigint, m bigint, x double").csv(str(folder / "csv"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_order_of_files_and_rows(table):
    assert ids(sampling.head(table, 5)) == [0, 1, 2, 3, 4]
    assert ids(sampling.head(table, 15)) == list(range(15))
    assert ids(sampling.tail(table, 5)) == [5098, 5099, 5100, 5101, 5102]
    assert ids(sampling.tail(table, 150)) == list(range(4953, 5103))
    assert ids(sampling.smart(table, 6)) == [0, 850, 1700, 2550, 3400, 4250]
    assert ids(sampling.head(table, 9999)) == list(range(5103)) == ids(sampling.smart(table, 9999))
    got = ids(sampling.random(table, 40, seed=3))
    assert got == sorted(got) and len(set(got)) == 40
    assert sampling.head(table, 0).count() == sampling.tail(table, 0).count() == sampling.smart(table, 0).count() == 0


def test_positions_are_dense(table):
    every = positions.with_positions(table)
    assert [tuple(r) for r in every.select("id", "_pos").orderBy("_pos").collect()] == [(k, k) for k in range(5103)]
    some = positions.with_positions(table.where("m = 3").select("id", "m"))
    assert [tuple(r) for r in some.select("id", "_pos").orderBy("_pos").collect()] == [(k, n) for n, k in enumerate(range(3, 5103, 7))]
    assert ids(sampling.head(table.where("m = 3"), 3)) == [3, 10, 17] and ids(sampling.tail(table.where("m = 3"), 2)) == [5092, 5099]
    assert ids(sampling.smart(table.where("m = 3"), 3)) == [3, 1704, 3405]


def test_no_copy_of_the_rows(table):
    for df in (positions.with_positions(table), sampling.head(table, 5), sampling.tail(table, 5), sampling.smart(table, 5), sampling.random(table, 5)):
        plan = df._jdf.queryExecution().toString()
        assert "ExistingRDD[id" not in plan and "LogicalRDD [id" not in plan
        assert "FileScan" in plan


def test_only_the_files_that_it_takes(spark, folder):
    """As the scan's own count of files says. Files are taken 1, 2, 4, ... at a time."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.read.parquet(str(folder / "parquet"))
        for df, n in ((sampling.head(table, 5), 1), (sampling.tail(table, 3), 1), (sampling.tail(table, 4), 3), (sampling.smart(table, 2), 2)):
            df.collect()
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
            read = [leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if "FileScan" in leaves.apply(k).toString()]
            assert read == [n]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_outliers_have_positions(table):
    got = {(r["row"], r["value"]) for r in profiling.outliers(table, ["x"]).collect()}
    assert got == {(k, 1e9) for k in range(999, 5103, 1000)}


def test_with_a_key(table):
    want = sorted(range(5103), key=lambda k: (k % 7, k))
    assert ids(sampling.smart(table, 6, ["m", "id"])) == want[: 6 * 850 : 850]
    assert [k % 7 for k in ids(sampling.smart(table, 6, ["m"]))] == [k % 7 for k in want[: 6 * 850 : 850]]


def test_without_files(spark):
    made = spark.range(20, numPartitions=3).selectExpr("id", "id % 2 AS m")
    assert positions.file_order(made) is None and positions.file_order(made.groupBy("m").count()) is None
    assert ids(sampling.tail(made, 3)) == [17, 18, 19] and ids(sampling.smart(made, 4)) == [0, 5, 10, 15]
    assert positions.with_positions(made.where("id < 0")).count() == 0


def test_joined_tables_have_no_order(spark, folder):
    t = spark.read.parquet(str(folder / "parquet"))
    assert positions.file_order(t.join(t.select("id"), "id")) is None and positions.file_order(t.distinct()) is None
    assert positions.file_order(t.select("id").where("id > 3").select("id")) is not None
