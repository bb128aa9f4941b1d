"""Registered queries and the SQL that gives the same rows.

Queries that both dialects spell alike share one text. The rest are built by the operators; their SQL says the same in DuckDB's words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import history, kernels, peek, profiling, sampling, text_index, vectors
from lodestone.plans import coverage
from lodestone.session import spread
from lodestone.sources import files
from lodestone.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> SQL that Spark and DuckDB read alike
SHARED: dict[str, str] = {
    "flagship": "SELECT o_orderpriority, COUNT(*) AS cnt FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY cnt DESC, o_orderpriority",
    "project_filter": "SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
    "date_filter": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'",
    "predicates": "SELECT p_partkey, p_name, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' WHEN p_size IN (1, 2, 3) THEN 'small' ELSE 'other' END AS bin FROM part WHERE p_type LIKE '%A%' OR p_brand IS NULL OR p_name ILIKE '%b%'",
    "null_safe": "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS DISTINCT FROM 2 AS differs, NULLIF(n_regionkey, 1) IS NULL AS was_one FROM nation",
    "group_count": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_sum_avg_min_max": "SELECT l_returnflag, ROUND(SUM(l_quantity), 4) AS s, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_discount) AS mi, MAX(l_tax) AS ma, COUNT(l_tax) AS n FROM lineitem GROUP BY l_returnflag",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, ROUND(AVG(l_discount), 6) AS disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "global_agg": "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders",
    "csv_style_count": "SELECT COUNT(*) AS n FROM lineitem",
    "count_distinct": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 40",
    "group_by_all": "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ALL",
    "inner_join_agg": "SELECT n.n_name, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "left_join": "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "right_join": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "full_join": "SELECT a.p_partkey AS a_key, b.s_suppkey AS b_key FROM part a FULL JOIN supplier b ON a.p_partkey = b.s_suppkey",
    "cross_join": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "natural_using_join": "SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)",
    "theta_join": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "semi_join": "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "anti_join": "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "in_subquery": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
    "cte": "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(t), 4) AS mean_total FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000",
    "window_sum": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "window_rank": "SELECT p_partkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "window_lag_lead": "SELECT event_id, LAG(value) OVER w AS before_value, LEAD(event_type) OVER w AS after_type, NTILE(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "conditional_funcs": "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg, GREATEST(c_acctbal, 0) AS up, LEAST(c_acctbal, 0) AS down FROM customer",
    "cube_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
}

#: name -> (SQL for our engine, SQL for DuckDB)
PAIRS: dict[str, tuple[str, str]] = {
    "integer_sums": ("SELECT p_brand, SUM(p_size) AS s, MEDIAN(p_retailprice) AS m FROM part GROUP BY p_brand", "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS s, MEDIAN(p_retailprice) AS m FROM part GROUP BY p_brand"),
    "dispersion": ("SELECT l_linestatus, ROUND(stdev(l_quantity), 6) AS s, ROUND(var(l_quantity), 6) AS v FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, ROUND(stddev_samp(l_quantity), 6) AS s, ROUND(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY l_linestatus"),
    "array_agg": ("SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "star_except": ("SELECT * EXCLUDE (c_acctbal, c_name) FROM customer", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer"),
    "union_by_name": ("SELECT n_name, n_regionkey FROM nation UNION ALL BY NAME SELECT r_name AS n_name FROM region", "SELECT n_name, n_regionkey FROM nation UNION ALL BY NAME SELECT r_name AS n_name FROM region"),
    "first_last": ("SELECT user_id, max_by(event_type, struct(ts, event_id)) AS last_type, min_by(event_type, struct(ts, event_id)) AS first_type FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id"),
    "string_funcs": (
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, octet_length(p_name) AS b, concat(p_brand, '-', p_type) AS c, concat_ws('/', p_brand, p_type) AS cw, left(p_name, 3) AS lf, right(p_name, 3) AS rt, ltrim('  a ') AS lt, replace(p_type, 'A', '_') AS rp, reverse(p_name) AS rv, substr(p_name, 2, 3) AS sb, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, strpos(p_name, 'e') AS sp, p_name ~ '^[a-m]' AS re FROM part",
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, octet_length(encode(p_name)) AS b, concat(p_brand, '-', p_type) AS c, concat_ws('/', p_brand, p_type) AS cw, left(p_name, 3) AS lf, right(p_name, 3) AS rt, ltrim('  a ') AS lt, replace(p_type, 'A', '_') AS rp, reverse(p_name) AS rv, substr(p_name, 2, 3) AS sb, starts_with(p_name, 'a') AS sw, ends_with(p_name, 'e') AS ew, strpos(p_name, 'e') AS sp, regexp_matches(p_name, '^[a-m]') AS re FROM part",
    ),
    "date_funcs": (
        "SELECT o_orderkey, date_part('year', o_orderdate) AS y, extract(month FROM o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y/%m') AS f, CAST(strptime('2024-05-06', '%Y-%m-%d') AS DATE) AS p FROM orders",
        "SELECT o_orderkey, date_part('year', o_orderdate) AS y, extract(month FROM o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y/%m') AS f, CAST(strptime('2024-05-06', '%Y-%m-%d') AS DATE) AS p FROM orders",
    ),
    "math_funcs": (
        "SELECT s_suppkey, round(cbrt(s_suppkey), 6) AS c, CAST(ceil(s_acctbal) AS BIGINT) AS ce, CAST(floor(s_acctbal) AS BIGINT) AS fl, round(exp(s_suppkey / 1000D), 6) AS ex, round(ln(s_suppkey), 6) AS l, round(log2(s_suppkey), 6) AS l2, round(log10(s_suppkey), 6) AS l10, mod(s_suppkey, 7) AS m, round(sqrt(s_suppkey), 6) AS q, CAST(sign(s_acctbal) AS INT) AS sg, abs(s_acctbal) AS ab, s_suppkey // 7 AS dv, round(pow(s_suppkey, 1.5), 4) AS pw FROM supplier WHERE s_suppkey > 0",
        "SELECT s_suppkey, round(cbrt(s_suppkey), 6) AS c, CAST(ceil(s_acctbal) AS BIGINT) AS ce, CAST(floor(s_acctbal) AS BIGINT) AS fl, round(exp(s_suppkey / 1000), 6) AS ex, round(ln(s_suppkey), 6) AS l, round(log2(s_suppkey), 6) AS l2, round(log10(s_suppkey), 6) AS l10, mod(s_suppkey, 7) AS m, round(sqrt(s_suppkey), 6) AS q, CAST(sign(s_acctbal) AS INT) AS sg, abs(s_acctbal) AS ab, s_suppkey // 7 AS dv, round(pow(s_suppkey, 1.5), 4) AS pw FROM supplier WHERE s_suppkey > 0",
    ),
    "trig_degrees": ("SELECT p_partkey, round(sind(CAST(p_size AS DOUBLE)), 6) AS s, round(cosd(CAST(p_size AS DOUBLE)), 6) AS c, round(atan2d(CAST(p_size AS DOUBLE), 3D), 6) AS a, round(degrees(p_size), 6) AS d FROM part", "SELECT p_partkey, round(sin(radians(p_size)), 6) AS s, round(cos(radians(p_size)), 6) AS c, round(degrees(atan2(p_size, 3)), 6) AS a, round(degrees(p_size), 6) AS d FROM part"),
    "bitwise": ("SELECT p_partkey, bit_and(p_partkey, 12) AS a, bit_or(p_partkey, 3) AS o, bit_xor(p_partkey, 5) AS x, bit_not(p_partkey) AS n, bit_count(p_partkey) AS c FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, ~p_partkey AS n, CAST(bit_count(p_partkey) AS INT) AS c FROM part"),
    "array_funcs": (
        "SELECT vec_id, size(embedding) AS n, round(array_min(embedding), 5) AS lo, round(array_max(embedding), 5) AS hi, round(array_sum(CAST(embedding AS ARRAY<DOUBLE>)), 5) AS s, round(array_mean(CAST(embedding AS ARRAY<DOUBLE>)), 6) AS m, array_contains(embedding, embedding[0]) AS c FROM embeddings",
        "SELECT vec_id, len(embedding) AS n, round(list_min(embedding), 5) AS lo, round(list_max(embedding), 5) AS hi, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS s, round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS m, list_contains(embedding, embedding[1]) AS c FROM embeddings",
    ),
    "json_props": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"),
    "try_cast": ("SELECT p_partkey, try_cast(substr(p_type, 1, 2) AS INT) AS t, CAST(p_size AS STRING) AS s, p_size::double AS d FROM part", "SELECT p_partkey, try_cast(substr(p_type, 1, 2) AS INT) AS t, CAST(p_size AS VARCHAR) AS s, p_size::double AS d FROM part"),
}


#: One engine for a session and folder: its tables stay registered, as in a shell that asks one question after the other.
_ENGINES: WeakKeyDictionary[SparkSession, dict[str, Engine]] = WeakKeyDictionary()


def _engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    mine = _ENGINES.setdefault(spark, {})
    e = mine[sf_dir] = mine.get(sf_dir) or Engine(spark)
    for t in TABLES:
        if t not in e.tables and re.search(rf"\b{t}\b", text):
            e.register(t, f"{sf_dir}/{t}.parquet")
    return e


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _engine(spark, sf_dir, text).sql(text)

    return run


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers an operator's query with its SQL."""

    def add(f):
        OTHER[f.__name__] = (f, sql)
        return f

    return add


# ---------------------------------------------------------------- quality


def _holey(spark, sf_dir):
    """customer with nulls where a segment or sign says so."""
    return _t(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))


_HOLEY = "(SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer)"


@query(f"""SELECT * FROM (SELECT 'seg' AS "column", COUNT(*) - COUNT(seg) AS missing, (COUNT(*) - COUNT(seg)) * 100.0 / COUNT(*) AS percentage FROM {_HOLEY}
UNION ALL SELECT 'bal', COUNT(*) - COUNT(bal), (COUNT(*) - COUNT(bal)) * 100.0 / COUNT(*) FROM {_HOLEY}
UNION ALL SELECT 'c_custkey', COUNT(*) - COUNT(c_custkey), (COUNT(*) - COUNT(c_custkey)) * 100.0 / COUNT(*) FROM {_HOLEY}) WHERE missing > 0""")
def missing_values(spark, sf_dir):
    return profiling.missing_values(_holey(spark, sf_dir)).withColumn("percentage", F.col("percentage").cast("double"))


@query("SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicates FROM (SELECT COUNT(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity > 40) GROUP BY ALL HAVING COUNT(*) > 1)".replace("SELECT COUNT(*) AS n FROM (", "SELECT COUNT(*) AS n, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM ("))
def duplicate_rows(spark, sf_dir):
    """Over all columns of lineitem, of which a part comes twice."""
    rows = _t(spark, sf_dir, "lineitem")
    return profiling.duplicate_rows(rows.unionByName(rows.where("l_quantity > 40")))


_QUARTILES = """WITH r AS (SELECT {key}, {col} AS v, row_number() OVER (ORDER BY {col} ASC NULLS FIRST, {key}) - 1 AS k, COUNT(*) OVER () AS n FROM {table}),
q AS (SELECT MAX(CASE WHEN k = n // 4 THEN v END) AS q1, MAX(CASE WHEN k = 3 * n // 4 THEN v END) AS q3, MAX(n) AS n FROM r)"""


@query(_QUARTILES.format(key="c_custkey", col="c_acctbal", table="customer") + """,
p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer)
SELECT 'c_acctbal' AS "column", p.row, r.v AS value FROM r JOIN p USING (c_custkey), q WHERE NOT isnan(r.v) AND (r.v < q1 - 0.25 * (q3 - q1) OR r.v > q3 + 0.25 * (q3 - q1))""")
def iqr_outliers(spark, sf_dir):
    """With a small factor, as the column has nothing far out."""
    return profiling.outliers(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], ["c_custkey"], factor=0.25)


_LINE_NUMBERS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()


@query(" UNION ALL ".join(f"SELECT * FROM ({_QUARTILES.format(key='l_orderkey', col=c, table='lineitem')} SELECT '{c}' AS \"column\", COUNT(*) AS outliers, ROUND(COUNT(*) * 100.0 / MAX(q.n), 6) AS percentage, ROUND(MAX(q1 - 0.1 * (q3 - q1))::DOUBLE, 4) AS low, ROUND(MAX(q3 + 0.1 * (q3 - q1))::DOUBLE, 4) AS high FROM r, q WHERE r.v < q1 - 0.1 * (q3 - q1) OR r.v > q3 + 0.1 * (q3 - q1) HAVING COUNT(*) > 0)" for c in _LINE_NUMBERS))
def outlier_summary(spark, sf_dir):
    """Of all numeric columns; a small factor, as these columns have nothing far out."""
    out = profiling.outlier_summary(_t(spark, sf_dir, "lineitem"), factor=0.1, positions=False)
    return out.select("column", "outliers", kernels.rounded("percentage", 6).alias("percentage"), kernels.rounded("low", 4).alias("low"), kernels.rounded("high", 4).alias("high"))


@query(f"""SELECT CASE WHEN p > 50 THEN 'error' WHEN p > 10 THEN 'warning' ELSE 'info' END AS severity, 'missing' AS kind, c AS "column", ROUND(p, 6) AS percentage FROM (
SELECT 'seg' AS c, (COUNT(*) - COUNT(seg)) * 100.0 / COUNT(*) AS p FROM {_HOLEY} UNION ALL SELECT 'bal', (COUNT(*) - COUNT(bal)) * 100.0 / COUNT(*) FROM {_HOLEY}) WHERE p > 0""")
def suggestions(spark, sf_dir):
    return profiling.suggestions(_holey(spark, sf_dir)).select("severity", "kind", "column", kernels.rounded("percentage", 6).alias("percentage"))


@query(f"""SELECT 'seg' AS "column", 'string' AS type, COUNT(DISTINCT seg) + MAX(CASE WHEN seg IS NULL THEN 1 ELSE 0 END) AS "distinct", COUNT(*) - COUNT(seg) AS missing FROM {_HOLEY}
UNION ALL SELECT 'bal', 'double', COUNT(DISTINCT bal) + MAX(CASE WHEN bal IS NULL THEN 1 ELSE 0 END), COUNT(*) - COUNT(bal) FROM {_HOLEY}
UNION ALL SELECT 'c_custkey', 'bigint', COUNT(DISTINCT c_custkey), COUNT(*) - COUNT(c_custkey) FROM {_HOLEY}""")
def column_stats(spark, sf_dir):
    return profiling.column_stats(_holey(spark, sf_dir)).select("column", "type", "distinct", "missing")


@query(f"""SELECT 'seg' AS "column", 'string' AS type, COUNT(*) > COUNT(seg) AS nullable, COUNT(*) - COUNT(seg) AS missing, COUNT(*) AS rows FROM {_HOLEY}
UNION ALL SELECT 'bal', 'double', COUNT(*) > COUNT(bal), COUNT(*) - COUNT(bal), COUNT(*) FROM {_HOLEY}
UNION ALL SELECT 'c_custkey', 'bigint', false, 0, COUNT(*) FROM {_HOLEY}""")
def schema_summary(spark, sf_dir):
    return profiling.schema_summary(_holey(spark, sf_dir)).select("column", "type", "nullable", "missing", "rows")


# ---------------------------------------------------------------- samples, kernels


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 7")
def sample_head(spark, sf_dir):
    return sampling.head(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 7, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def sample_tail(spark, sf_dir):
    return sampling.tail(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 7, ["o_orderkey"])


@query("WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, COUNT(*) OVER () AS n FROM orders) SELECT o_orderkey, o_custkey FROM r WHERE p % greatest(1, n // 11) = 0 AND p < 11 * greatest(1, n // 11)")
def sample_smart(spark, sf_dir):
    return sampling.smart(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 11, ["o_orderkey"])


@query("SELECT ROUND(SUM(l_extendedprice), 2) AS total, ROUND(AVG(l_extendedprice), 6) AS mean, ROUND(var_samp(l_quantity), 6) AS variance, ROUND(stddev_samp(l_quantity), 6) AS std_dev, MIN(l_tax) AS lo, MAX(l_tax) AS hi FROM lineitem")
def numeric_kernels(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").agg(kernels.rounded(kernels.total("l_extendedprice"), 2).alias("total"), kernels.rounded(kernels.mean("l_extendedprice"), 6).alias("mean"), kernels.rounded(kernels.variance("l_quantity"), 6).alias("variance"), kernels.rounded(kernels.std_dev("l_quantity"), 6).alias("std_dev"), kernels.minimum("l_tax").alias("lo"), kernels.maximum("l_tax").alias("hi"))


@query("SELECT event_type, v[least(len(v) * 95 // 100, len(v) - 1) + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)")
def percentile_rank(spark, sf_dir):
    return kernels.group_percentile(_t(spark, sf_dir, "events"), ["event_type"], "value", 95, "p95")


@query("SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS c, quantile_disc(l_extendedprice, 0.9) AS d FROM lineitem GROUP BY l_returnflag")
def quantiles(spark, sf_dir):
    q = kernels.group_quantiles(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", c=("cont", 0.25), d=("disc", 0.9))
    return q.select("l_returnflag", kernels.rounded("c", 4).alias("c"), "d")


# ---------------------------------------------------------------- text

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_POST = f"tok AS (SELECT doc_id, lang, unnest({_TOK}) AS term FROM documents), tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len({_TOK}) AS n FROM documents), st AS (SELECT COUNT(*) AS docs, AVG(n) AS av FROM dl), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term)"
_SCORE = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))"


def _found(spark, sf_dir, q, k=None, **how):
    """Hits in the saved index: the best k, or all."""
    i = coverage.index_of(spark, sf_dir)
    return (i.scores(q, **how) if k is None else i.search(q, k, **how)).select("doc_id", kernels.rounded("score", 6).alias("score"))


@query(f"SELECT term, COUNT(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term")
def tokenize_counts(spark, sf_dir):
    """Terms of all texts, counted inside each partition before they meet."""
    return spread(_t(spark, sf_dir, "documents").select("text")).select(F.explode(text_index.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_POST} SELECT term, df FROM df")
def postings_df(spark, sf_dir):
    return text_index.postings_of(spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_POST} SELECT doc_id, ROUND(SUM({_SCORE}), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('idiot', 'license', 'version') GROUP BY doc_id ORDER BY SUM({_SCORE}) DESC, doc_id LIMIT 50")
def bm25_top(spark, sf_dir):
    return _found(spark, sf_dir, "idiot license version", 50)


@query(f"WITH {_POST} SELECT doc_id, ROUND(SUM({_SCORE}), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('license', 'version') GROUP BY doc_id HAVING COUNT(*) = 2")
def bool_and(spark, sf_dir):
    return _found(spark, sf_dir, "+license +version")


@query(f"WITH {_POST} SELECT doc_id, ROUND(SUM({_SCORE}), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term IN ('moron', 'scum') GROUP BY doc_id")
def bool_or(spark, sf_dir):
    return _found(spark, sf_dir, "moron OR scum")


@query(f"WITH {_POST} SELECT doc_id, ROUND(SUM({_SCORE}), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st WHERE term = 'license' AND doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'mit') GROUP BY doc_id")
def bool_not(spark, sf_dir):
    return _found(spark, sf_dir, "license -mit")


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' general public license ')")
def phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"general public license"').select("doc_id")


@query(f"WITH {_POST} SELECT DISTINCT doc_id FROM tf WHERE term LIKE 'licens%'")
def prefix(spark, sf_dir):
    return _found(spark, sf_dir, "licens*").select("doc_id")


@query(f"WITH {_POST} SELECT DISTINCT doc_id FROM tf WHERE term IN (SELECT term FROM df WHERE damerau_levenshtein(term, 'pathtic') <= 2)")
def fuzzy(spark, sf_dir):
    return _found(spark, sf_dir, "~pathtic").select("doc_id")


@query(f"WITH {_POST} SELECT DISTINCT doc_id FROM tok WHERE term = 'version' AND lang = 'de'")
def type_filtered_search(spark, sf_dir):
    return _found(spark, sf_dir, "version", file_type="de").select("doc_id")


@query("SELECT doc_id, CAST(length(left(lower(text), strpos(lower(text), 'license') - 1)) - length(replace(left(lower(text), strpos(lower(text), 'license') - 1), chr(10), '')) + 1 AS INTEGER) AS line FROM documents WHERE strpos(lower(text), 'license') > 0")
def snippet_line(spark, sf_dir):
    line, _ = text_index.line_column(F.col("text"), ["license"])
    return _t(spark, sf_dir, "documents").select("doc_id", line.alias("line")).where("line is not null")


# ---------------------------------------------------------------- vectors


@query("SELECT vec_id, label, ROUND(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS sq, ROUND(embedding[1] / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS first_part FROM embeddings")
def l2_normalize(spark, sf_dir):
    u = vectors.l2_normalize(F.col("embedding"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", kernels.rounded(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("sq"), kernels.rounded(F.get(u, 0), 5).alias("first_part"))


@query("SELECT b.vec_id, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()
    return vectors.VectorIndex(e, "vec_id").search(list(q.embedding), 20).select("vec_id", kernels.rounded("score", 6).alias("score"))


# ---------------------------------------------------------------- events, history


def _file_events(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for p in (("signup", "created"), ("view", "modified"), ("click", "modified"), ("purchase", "modified"), ("error", "deleted")) for x in p])
    e = _t(spark, sf_dir, "events")
    return e.select(kinds[F.col("event_type")].alias("kind"), F.col("user_id").cast("string").alias("path"), F.lit(None).cast("string").alias("to_path"), F.col("ts").cast("timestamp").alias("event_time"))


_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END"


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT path, ts, SUM(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT path, MAX(ts) AS event_time, COUNT(*) AS merged FROM s GROUP BY path, g""")
def debounce_sessions(spark, sf_dir):
    return incremental.debounce(_file_events(spark, sf_dir), "2 hours").select("path", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "merged")


@query(f"SELECT path, CASE WHEN gone = 1 THEN 'delete' ELSE 'put' END AS op FROM (SELECT CAST(user_id AS VARCHAR) AS path, arg_max(CASE WHEN {_KIND} = 'deleted' THEN 1 ELSE 0 END, (ts, CASE WHEN {_KIND} = 'deleted' THEN 1 ELSE 0 END)) AS gone FROM events GROUP BY 1)")
def upsert_latest(spark, sf_dir):
    return incremental.latest(incremental.operations(_file_events(spark, sf_dir))).select("path", "op")


def _searches(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("path"), F.nullif("event_type", F.lit("view")).alias("file_type"), F.lit("standard").alias("search_type"), F.col("user_id").alias("results"), F.lit(1).cast("bigint").alias("ms"), F.col("ts").alias("timestamp"))


@query("SELECT lower(event_type) AS query, COUNT(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def query_frequency(spark, sf_dir):
    return history.frequencies(_searches(spark, sf_dir), 3)


@query("SELECT 'u' || (user_id % 10) AS path, event_type AS file_type, COUNT(*) AS count FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def path_type_assoc(spark, sf_dir):
    return history.co_occurrence(_searches(spark, sf_dir))


@query("WITH c AS (SELECT 'u' || (user_id % 10) AS p, COUNT(*) AS n FROM events WHERE contains(event_type, 'r') GROUP BY 1) SELECT (SELECT p FROM c ORDER BY n DESC, p LIMIT 1) AS path, COUNT(*) AS count, ROUND(AVG(user_id), 6) AS mean_results FROM events WHERE contains(event_type, 'r')")
def modal_type(spark, sf_dir):
    return history.statistics(_searches(spark, sf_dir), "R").select("path", "count", kernels.rounded("mean_results", 6).alias("mean_results"))


# ---------------------------------------------------------------- files


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 1024 AND 2560")
def size_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(files.size_filter("1KB-2.5KB", "n_chars")).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def mtime_filter(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where(files.time_filter("1997-06-01", F.col("o_orderdate").cast("timestamp"))).select("o_orderkey")


@query("SELECT page_id FROM pages WHERE lower(split_part(split_part(url, '#', 1), '?', 1)) LIKE '%.html'")
def file_type_filter(spark, sf_dir):
    path = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return _t(spark, sf_dir, "pages").where(files.type_filter("html,htm", path)).select("page_id")


@query("SELECT COUNT(*) AS files, CAST(0 AS BIGINT) AS folders, CAST(SUM(n_chars) AS BIGINT) AS total_size, CAST(0 AS BIGINT) AS errors FROM documents")
def scan_statistics(spark, sf_dir):
    return files.scan_stats(_t(spark, sf_dir, "documents").select(F.col("n_chars").alias("size"), F.lit(False).alias("is_dir")))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS lines FROM documents")
def line_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", peek.line_count(F.col("text")).alias("lines"))


@query("SELECT doc_id, CASE WHEN len(l) <= 25 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:15], chr(10)) || chr(10) || '... [truncated] ...' || chr(10) || array_to_string(l[len(l) - 9:len(l)], chr(10)) END AS preview FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)")
def preview_head_tail(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", peek.preview(F.col("text")).alias("preview"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _sql(v) for k, v in SHARED.items()} | {k: _sql(a) for k, (a, _) in PAIRS.items()} | {k: f for k, (f, _) in OTHER.items()} | coverage.QUERIES
ORACLE_SQL: dict[str, str] = SHARED | {k: b for k, (_, b) in PAIRS.items()} | {k: s for k, (_, s) in OTHER.items() if s} | coverage.ORACLE
#: DuckDB's names of the semi and anti joins.
ORACLE_SQL |= {k: ORACLE_SQL[k].replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN") for k in ("semi_join", "anti_join")}
