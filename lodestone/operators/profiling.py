"""Data quality: missing values, duplicates, outliers, suggestions, column facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import checkpointed

from .positions import with_positions

#: approx_percentile is off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _unpivot(row: DataFrame, columns: list[str], facts: dict[str, str]) -> DataFrame:
    """A one-row aggregate with columns <fact>_<k> as a row per column; facts: name -> type."""
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{k}").cast(t).alias(f) for f, t in facts.items()]) for k, c in enumerate(columns)]
    return row.select("total", F.explode(F.array(*each)).alias("x")).select("x.*", "total")


def missing_values(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, missing, percentage): nulls of each column, in one pass. NaN is a value. Columns without nulls are left out unless asked for."""
    aggs = [F.count(F.when(_q(c).isNull(), 1)).alias(f"missing_{k}") for k, c in enumerate(df.columns)]
    out = _unpivot(df.agg(F.count(F.lit(1)).alias("total"), *aggs), df.columns, {"missing": "bigint"})
    out = out.select("column", "missing", F.when(F.col("total") > 0, F.col("missing") * 100.0 / F.col("total")).otherwise(F.lit(0.0)).alias("percentage"))
    return out.where("missing > 0") if only_missing else out


#: Digests that come more than once and are broadcast to find their rows; with more, whole rows are grouped.
REPEATED = 1_000_000


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicates): rows whose values all occur in another row too, the first of them included; nulls equal nulls.

    Rows are counted by a digest of 128 bits, so 16 bytes a row are shuffled. Only rows whose digest comes again are looked at whole; where these are too many to be
    named to all tasks, all rows are, as a join would shuffle them just so, and the grouping once more.
    """
    columns, digest = [_q(c) for c in df.columns], ["__d1", "__d2"]
    if not columns:
        return df.agg(F.when(F.count("*") > 1, F.count("*")).otherwise(F.lit(0)).alias("duplicates"))
    marked = df.select("*", F.xxhash64(F.lit(1), *columns).alias("__d1"), F.xxhash64(F.lit(2), *columns, F.lit(3)).alias("__d2"))
    repeated = checkpointed(marked.groupBy(*digest).count().where("count > 1").select(*digest))
    n = repeated.count()
    if not n:
        return df.sparkSession.createDataFrame([(0,)], "duplicates bigint")
    whole = marked.join(F.broadcast(repeated), digest, "left_semi") if n <= REPEATED else df
    return whole.groupBy(*columns).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicates"))


def quartiles(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple | None]:
    """Column -> (q1, q3): the values at ranks n div 4 and 3 n div 4 of the sorted column, nulls first; None if one of them is null.

    Three passes for all columns together: a sketch brackets each rank, the rows under the brackets are counted, and the distinct values
    inside a bracket (about 4 / ACCURACY of the rows) are ranked exactly. A bracket that misses its rank is widened to the whole column.
    """
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return {}
    around = 2.0 / ACCURACY
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(columns):
        aggs += [F.count(_q(c)).alias(f"c{k}"), F.min(_q(c)).alias(f"lo{k}"), F.max(_q(c)).alias(f"hi{k}")]
    first = df.agg(*aggs).first()
    n = first["n"]
    wanted: list[tuple[int, int, int]] = []  # column, which quartile, rank among values
    out: dict[str, tuple | None] = {}
    for k, c in enumerate(columns):
        nulls = n - first[f"c{k}"]
        ranks = [n // 4 - nulls, 3 * n // 4 - nulls]
        if n == 0 or min(ranks) < 0 or first[f"c{k}"] == 0:
            out[c] = None
        else:
            wanted += [(k, i, r) for i, r in enumerate(ranks)]
    if not wanted:
        return out
    shares = [F.percentile_approx(_q(columns[k]), [max(0.0, (r + 0.5) / first[f"c{k}"] - around), min(1.0, (r + 0.5) / first[f"c{k}"] + around)], ACCURACY).alias(f"b{j}") for j, (k, _, r) in enumerate(wanted)]
    bracket = df.agg(*shares).first()
    found: dict[int, object] = {}
    for whole in (False, True):
        todo = [j for j in range(len(wanted)) if j not in found]
        if not todo:
            break
        ends = {j: (first[f"lo{wanted[j][0]}"], first[f"hi{wanted[j][0]}"]) if whole else tuple(bracket[f"b{j}"]) for j in todo}
        below = df.agg(*[F.count(F.when(_q(columns[wanted[j][0]]) < F.lit(ends[j][0]), 1)).alias(f"x{j}") for j in todo]).first()
        parts = []
        for j in todo:
            v = _q(columns[wanted[j][0]])
            inside = v.isNotNull() if whole else v.between(F.lit(ends[j][0]), F.lit(ends[j][1]))
            parts.append(F.when(inside, F.struct(F.lit(j).alias("j"), v.cast("double").alias("v"))))
        values = df.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).groupBy("x.j", "x.v").count()
        upto = F.sum("count").over(Window.partitionBy("j").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = values.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("count"))
        cond = reduce(lambda a, b: a | b, [(F.col("j") == j) & (F.col("start") <= wanted[j][2] - below[f"x{j}"]) & (F.col("upto") > wanted[j][2] - below[f"x{j}"]) for j in todo])
        for r in ranked.where(cond).collect():
            if wanted[r["j"]][2] >= below[f"x{r['j']}"]:
                found[r["j"]] = r["v"]
    for k, c in enumerate(columns):
        if c not in out:
            q = [found[j] for j, w in enumerate(wanted) if w[0] == k]
            out[c] = (q[0], q[1])
    return out


def bounds(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Column -> (low, high); columns with a null quartile are left out."""
    return {c: (float(q[0]) - factor * (float(q[1]) - float(q[0])), float(q[1]) + factor * (float(q[1]) - float(q[0]))) for c, q in quartiles(df, columns).items() if q}


def _outside(c: str, low: float, high: float) -> Column:
    v = _q(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & ((v < F.lit(low)) | (v > F.lit(high)))


def outliers(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """(column, row, value): values strictly outside the bounds, with their dense row positions."""
    limits = bounds(df, columns, factor)
    rows = with_positions(df, order_by)
    cases = [F.when(_outside(c, lo, hi), F.struct(F.lit(c).alias("column"), F.col("_pos").alias("row"), _q(c).cast("double").alias("value"))) for c, (lo, hi) in limits.items()]
    if not cases:
        return df.sparkSession.createDataFrame([], "column string, row bigint, value double")
    return rows.select(F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x")).select("x.*")


def outlier_summary(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, factor: float = 1.5, first: int = 10, positions: bool = True) -> DataFrame:
    """(column, outliers, percentage, low, high[, rows]): numeric columns with outliers; rows: the first positions."""
    limits = bounds(df, columns, factor)
    spark = df.sparkSession
    kind = "column string, outliers bigint, percentage double, low double, high double"
    if not limits:
        return spark.createDataFrame([], kind + (", rows array<bigint>" if positions else ""))
    names = list(limits)
    aggs = [F.count(F.when(_outside(c, *limits[c]), 1)).alias(f"outliers_{k}") for k, c in enumerate(names)]
    out = _unpivot(df.agg(F.count(F.lit(1)).alias("total"), *aggs), names, {"outliers": "bigint"}).where("outliers > 0")
    low = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(limits[c][0]))])
    high = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(limits[c][1]))])
    out = out.select("column", "outliers", (F.col("outliers") * 100.0 / F.col("total")).alias("percentage"), low[F.col("column")].alias("low"), high[F.col("column")].alias("high"))
    if not positions:
        return out
    where = outliers(df, names, order_by, factor)
    # each partition keeps its first ones before they meet
    local = where.withColumn("part", F.spark_partition_id()).groupBy("column", "part").agg(F.slice(F.sort_array(F.collect_list("row")), 1, first).alias("rows"))
    firsts = local.groupBy("column").agg(F.slice(F.sort_array(F.flatten(F.collect_list("rows"))), 1, first).alias("rows"))
    return out.join(firsts, "column", "left")


SEVERITY = {"error": 3, "warning": 2, "info": 1}


def suggestions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(severity, kind, column, percentage, message), gravest first, then by kind and column. All thresholds are strict."""
    n = F.lit(float(max(1, df.count())))
    missing = missing_values(df).select("column", "percentage", F.lit("missing").alias("kind"), F.when(F.col("percentage") > 50, "error").when(F.col("percentage") > 10, "warning").otherwise("info").alias("severity"), F.concat("column", F.lit(": fill or drop missing values")).alias("message"))
    twice = duplicate_rows(df).where("duplicates > 0").select(F.lit(None).cast("string").alias("column"), (F.col("duplicates") * 100.0 / n).alias("percentage"), F.lit("duplicates").alias("kind")).withColumn("severity", F.when(F.col("percentage") > 20, "warning").otherwise("info")).withColumn("message", F.lit("remove duplicate rows"))
    far = outlier_summary(df, columns, positions=False).select("column", "percentage", F.lit("outliers").alias("kind"), F.when(F.col("percentage") > 5, "warning").otherwise("info").alias("severity"), F.concat("column", F.lit(": look at outliers")).alias("message"))
    rank = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    every = missing.unionByName(twice).unionByName(far)
    return every.orderBy(F.desc(rank[F.col("severity")]), "kind", "column").select("severity", "kind", "column", "percentage", "message")


def column_stats(df: DataFrame) -> DataFrame:
    """(column, type, distinct, missing, percentage); null counts as one of the distinct values."""
    n, aggs = F.count(F.lit(1)).alias("total"), []
    for k, c in enumerate(df.columns):
        aggs += [(F.count_distinct(_q(c)) + F.coalesce(F.max(_q(c).isNull().cast("int")), F.lit(0))).alias(f"distinct_{k}"), F.count(F.when(_q(c).isNull(), 1)).alias(f"missing_{k}")]
    out = _unpivot(df.agg(n, *aggs), df.columns, {"distinct": "bigint", "missing": "bigint"})
    kinds = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return out.select("column", kinds[F.col("column")].alias("type"), "distinct", "missing", F.when(F.col("total") > 0, F.col("missing") * 100.0 / F.col("total")).otherwise(0.0).alias("percentage"))


def schema_summary(df: DataFrame) -> DataFrame:
    """(column, type, nullable, missing, percentage, rows): nullable means that there are nulls."""
    kinds = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    aggs = [F.count(F.when(_q(c).isNull(), 1)).alias(f"missing_{k}") for k, c in enumerate(df.columns)]
    out = _unpivot(df.agg(F.count(F.lit(1)).alias("total"), *aggs), df.columns, {"missing": "bigint"})
    return out.select("column", kinds[F.col("column")].alias("type"), (F.col("missing") > 0).alias("nullable"), "missing", F.when(F.col("total") > 0, F.col("missing") * 100.0 / F.col("total")).otherwise(0.0).alias("percentage"), F.col("total").alias("rows"))


def report(df: DataFrame) -> str:
    """The findings as text: five columns with most missing values, five with most outliers, errors and warnings, three notes."""
    n = df.count()
    lines = [f"{n} rows, {len(df.columns)} columns"]
    lines += [f"missing  {r.column}: {r.missing} ({r.percentage:.1f}%)" for r in missing_values(df).orderBy(F.desc("missing"), "column").limit(5).collect()]
    lines.append(f"duplicate rows: {duplicate_rows(df).first()[0]}")
    lines += [f"outliers {r.column}: {r.outliers} ({r.percentage:.1f}%)" for r in outlier_summary(df, positions=False).orderBy(F.desc("outliers"), "column").limit(5).collect()]
    found = suggestions(df).collect()
    lines += [f"{r.severity}: {r.message}" for r in found if r.severity != "info"] + [f"info: {r.message}" for r in found if r.severity == "info"][:3]
    return "\n".join(lines)


def json_structure(items: list) -> dict:
    """Of a JSON array: length, fields of the first object, objects after it with other keys."""
    first = next(iter(items), None)
    keys = set(first) if isinstance(first, dict) else set()
    return {"length": len(items), "fields": len(keys), "inconsistent": sum(isinstance(x, dict) and set(x) != keys for x in items[1:]) if isinstance(first, dict) else 0}
