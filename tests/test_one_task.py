"""Steps that were one task's, or shuffled whole rows more often than once."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import profiling
from lodestone.plans import coverage


@pytest.mark.parametrize("n", [1000, 0])
def test_csv_options_is_written_by_all_tasks(spark, tmp_path, monkeypatch, n):
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("l_orderkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") / 2).alias("l_quantity"), F.lit("A").alias("l_returnflag"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(coverage, "_new", lambda spark, ending="": f"{tmp_path}/out{ending}")
    found = coverage.QUERIES["csv_options"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("l_orderkey", "l_linenumber").collect())) == [(k, k % 7) for k in range(n)]
    assert found.columns == ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "shipped"]
    assert len(list((tmp_path / "out.csv").glob("part-*"))) > (2 if n else 0)


def test_many_duplicates_shuffle_rows_once(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 300).alias("a"), F.when(F.col("id") % 300 != 7, "x").alias("b"))
    assert profiling.duplicate_rows(df).first()[0] == 200
    monkeypatch.setattr(profiling, "REPEATED", 10)
    many = profiling.duplicate_rows(df)
    assert many.first()[0] == 200 and "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
