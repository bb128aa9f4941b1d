"""Rounded values keep the sign of zero, as those of the SQL do."""

import math

import duckdb
from pyspark.sql import functions as F

from lodestone.operators import kernels
from lodestone.plans import coverage


def test_rounded_as_duckdb(spark):
    values = [-4.02e-6, -0.0, 0.0, 4.02e-6, -1.5, 2.5, 0.123455, -0.123455, 1e300, -1e308, float("inf"), float("-inf"), float("nan"), None]
    found = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(kernels.rounded("v", 5).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    assert [repr(x) for x in found] == [repr(x) for x in want]


def test_mean_pooling_of_small_negatives(spark, tmp_path):
    spark.range(1).select(F.col("id").alias("vec_id"), F.array(*[F.lit(x).cast("float") for x in [-1e-6] * 63 + [0.3]]).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    pooled = coverage.QUERIES["mean_pooling"](spark, str(tmp_path)).first().pooled
    assert pooled[0] == 0 and math.copysign(1, pooled[0]) == -1 and pooled[63] == 0.6
