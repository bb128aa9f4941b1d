"""The dialect layer against DuckDB: the same statements, random expressions, and what it must leave alone."""

import random

import duckdb
import pytest

from lodestone.engine import Engine
from lodestone.errors import QueryError
from lodestone.plans.dialect import rewrite

T = [(k, k * 7 % 11, f"n{k % 4}", None if k % 5 == 0 else k * 3) for k in range(1, 41)]
U = [(k, f"u{k}", k % 3) for k in range(1, 6)]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame(T, "a long, b long, c string, d long"))
    e.register("u", spark.createDataFrame(U, "a long, name string, b long"))
    return e


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("CREATE TABLE t (a BIGINT, b BIGINT, c VARCHAR, d BIGINT)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", T)
    c.execute("CREATE TABLE u (a BIGINT, name VARCHAR, b BIGINT)")
    c.executemany("INSERT INTO u VALUES (?, ?, ?)", U)
    return c


ALIKE = [
    "SELECT a * 7 // 2 AS q, abs(0 - a) // 2 AS r, (a + b) // (b + 1) AS s, a // 2 // 3 AS t, 100 // a * b AS v, a - b // 2 AS w FROM t",
    "SELECT a, row_number() OVER (PARTITION BY c ORDER BY b, a) AS r FROM t QUALIFY r = 1 ORDER BY a",
    "WITH x AS (SELECT a, b, c FROM t WHERE d IS NOT NULL) SELECT c, a FROM x QUALIFY row_number() OVER (PARTITION BY c ORDER BY b DESC, a) <= 2 ORDER BY b DESC, a LIMIT 5",
    "SELECT s.c, s.n FROM (SELECT c, count(*) AS n FROM t GROUP BY c QUALIFY row_number() OVER (ORDER BY count(*) DESC, c) <= 2) s ORDER BY 1",
    "SELECT a FROM u WHERE a IN (SELECT b FROM t QUALIFY row_number() OVER (PARTITION BY c ORDER BY a) = 1) ORDER BY a",
    "SELECT count(*) AS n FROM (SELECT DISTINCT ON (c) c, a, b FROM t ORDER BY c, b DESC, a) x WHERE x.b > 5",
    "WITH f AS (SELECT DISTINCT ON (c) c, a FROM t ORDER BY c, b DESC, a) SELECT f.c, u.name FROM f LEFT JOIN u ON f.a = u.a ORDER BY 1",
    "SELECT DISTINCT ON (c) a, b FROM t ORDER BY c, d DESC NULLS LAST, a",
    "SELECT DISTINCT ON (b % 3, c) b % 3 AS m, c, a FROM t ORDER BY 1, 2, a DESC",
    "SELECT sum(x.a) AS s, max(x.b) AS m FROM (SELECT * REPLACE (a * 2 AS a, b // 2 AS b) FROM t) x",
    "WITH x AS (SELECT * REPLACE (upper(c) AS c) FROM t) SELECT DISTINCT c FROM x ORDER BY c",
    "SELECT u.* EXCLUDE (b) FROM t JOIN u ON t.a = u.a ORDER BY 1",
    "SELECT * EXCLUDE a FROM u ORDER BY name",
    "SELECT COLUMNS('^(a|name)$') FROM u ORDER BY 1",
    "SELECT * FROM (SELECT a, b FROM u UNION ALL BY NAME SELECT b, c FROM t WHERE a < 4) ORDER BY a NULLS LAST, b, c",
    "WITH x AS (SELECT a, name FROM u UNION BY NAME SELECT b AS a, name FROM u) SELECT count(*) AS n, sum(a) AS s FROM x",
    "SELECT a FROM u EXCEPT SELECT b FROM t WHERE b > 2 ORDER BY a",
    "SELECT bit_and(a, 6) + bit_or(b, 1) AS x, bit_and(a, 3) // 2 AS y FROM u ORDER BY 1, 2",
    "SELECT CASE WHEN a % 2 = 0 THEN a // 2 ELSE b END // 2 AS x FROM t ORDER BY a",
    "SELECT c, sum(a) // count(*) AS m, max(a) OVER () // 2 AS w FROM t GROUP BY c, a ORDER BY c, a",
    "SELECT c, count(*) FILTER (WHERE a > 9) // 2 AS x FROM t GROUP BY c ORDER BY c",
    "SELECT (SELECT max(a) FROM u) // 2 + 1 AS x, a[1] // 2 AS y FROM (SELECT 3 AS b, [5, 7] AS a)",
    "SELECT a IS NOT DISTINCT FROM d AS x, a IS DISTINCT FROM b AS y FROM t ORDER BY a",
    "SELECT c, quantile_cont(a, 0.5) AS m FROM t GROUP BY c HAVING max(b) // 2 > 3 ORDER BY c",
]


@pytest.mark.parametrize("sql", ALIKE)
def test_same_rows(engine, duck, sql):
    want = duck.execute(sql.replace("bit_and(a, 6)", "(a & 6)").replace("bit_or(b, 1)", "(b | 1)").replace("bit_and(a, 3)", "(a & 3)")).fetchall()
    ours = sql.replace("a[1] // 2", "a[0] // 2").replace("[5, 7]", "array(5, 7)")
    got = [tuple(r) for r in engine.sql(ours).collect()]
    assert (got if "ORDER BY" in sql else sorted(got)) == (want if "ORDER BY" in sql else sorted(want))


REGEX = [
    ("SELECT a FROM u WHERE lower(name) ~ '^u[13]$' ORDER BY a", "SELECT a FROM u WHERE regexp_matches(lower(name), '^u[13]$') ORDER BY a"),
    ("SELECT a FROM u WHERE NOT name ~ '1' AND name !~ concat('^', 'u2') ORDER BY a", "SELECT a FROM u WHERE name NOT IN ('u1', 'u2') ORDER BY a"),
    ("SELECT name ~* '^U' AS x, name !~* 'U3' AS y, name ^@ 'u' || '2' AS z, ~a AS n FROM u ORDER BY a", "SELECT true, name <> 'u3', name = 'u2', -a - 1 FROM u ORDER BY a"),
    ("SELECT count(*) AS n FROM (SELECT a FROM u WHERE coalesce(name, '') ~ ('u' || '4'))", "SELECT 1"),
]


@pytest.mark.parametrize(("sql", "other"), REGEX)
def test_patterns(engine, duck, sql, other):
    assert [tuple(r) for r in engine.sql(sql).collect()] == duck.execute(other).fetchall()


def expression(r, depth):
    """An integer expression without negative values, whose divisors are not 0."""
    if depth == 0:
        return r.choice(["a", "b", "t.a", "7", "12", "length(c)", "coalesce(d, 4)"])
    x, y = expression(r, depth - 1), expression(r, r.randrange(depth))
    divisor = r.choice(["3", "(b + 1)", "length(c)", "greatest(a, 2)", "CASE WHEN a > 9 THEN 2 ELSE 5 END"])
    return r.choice([f"{x} + {y}", f"{x} * {r.choice('23')} // {divisor}", f"({x}) // {divisor}", f"{x} // {divisor} % {divisor}", f"abs({x}) // {divisor}", f"greatest({x}, {y} // {divisor})", f"CASE WHEN {x} > {y} THEN {x} // 2 ELSE {y} END", f"({x} + {y}) * 2", f"- - {x} // {divisor}"])


def test_random_expressions(engine, duck):
    r = random.Random(31)
    wanted = [expression(r, 3) for _ in range(60)]
    sql = "SELECT " + ", ".join(f"{e} AS e{k}" for k, e in enumerate(wanted)) + " FROM t ORDER BY a"
    want, got = duck.execute(sql).fetchall(), [tuple(x) for x in engine.sql(sql).collect()]
    for k, e in enumerate(wanted):
        assert [int(x[k]) for x in got] == [int(x[k]) for x in want], e


@pytest.mark.parametrize("sql", ["SELECT 'a // b ~ QUALIFY' AS s -- x // y", "SELECT `a // b` FROM t", "SELECT a FROM t /* QUALIFY */ WHERE b = 1", "SELECT a FROM t WHERE (b = 1", "SELECT a) FROM t", "SELECT a EXCEPT", "SELECT // FROM t", "SELECT qualify.a FROM qualify"])
def test_left_alone(sql):
    assert rewrite(sql, lambda q: []).replace(" ", "") == sql.replace(" ", "")


def test_errors_have_texts(engine):
    for sql in ("SELECT a FROM t QUALIFY", "SELECT FROM WHERE", "SELECT * FROM (SELECT a FROM", "SELECT * REPLACE (1 AS nope) FROM u", "SELECT COLUMNS('zz') FROM u", "SELECT nope // 2 FROM t", "SELECT * FROM read_csv('/x.csv', colour = 1)"):
        with pytest.raises(QueryError) as e:
            engine.sql(sql)
        assert str(e.value).strip()


def test_explain_takes_all_spellings(engine):
    sql = "SELECT * REPLACE (a // 2 AS a) FROM t QUALIFY row_number() OVER (ORDER BY a) = 1"
    assert "Window" in engine.explain(sql)
    assert "Window" in engine.sql(f"EXPLAIN {sql}").first()[0] and "Parsed" in engine.sql(f"EXPLAIN EXTENDED {sql}").first()[0]


def test_files_in_queries(engine, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "b.csv").write_text("y;x;z\n9;8;7\n")
    (tmp_path / "c.json").write_text('{"x": 5}\n{"x": 6}\n')
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    assert [tuple(r) for r in engine.sql(f"SELECT x, y // 2 AS h FROM read_csv('{a}', delim = ';') ORDER BY x").collect()] == [(1, 1), (3, 2)]
    assert engine.sql(f"SELECT sum(x) s, max(z) m FROM read_csv(['{a}', '{b}'], sep = ';')").first()[:] == (12, 7)
    assert engine.sql(f"SELECT count(*) FROM read_csv('{a}', header = false)").first()[0] == 3
    assert engine.sql(f"SELECT count(*) FROM (SELECT x FROM read_json('{tmp_path}/c.json') QUALIFY row_number() OVER (ORDER BY x) = 1)").first()[0] == 1


def test_created_table_keeps_its_rows(spark, tmp_path):
    e = Engine(spark)
    p = str(tmp_path / "p")
    spark.range(3).write.parquet(p)
    e.sql(f"CREATE TABLE k AS SELECT id // 2 AS h FROM read_parquet('{p}')")
    spark.range(50).write.mode("overwrite").parquet(p)
    assert sorted(r[0] for r in e.sql("SELECT h FROM k").collect()) == [0, 0, 1]
