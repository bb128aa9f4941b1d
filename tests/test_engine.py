import pytest
from lodestone.engine import Engine, table_name
from lodestone.errors import NotFound, QueryError, UnsupportedFormat
from lodestone.plans.dialect import commas, rewrite, text_of, tree, typo_hint
from lodestone.sources.readers import CsvOptions, read_any, read_csv


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("users", spark.createDataFrame([(1, "Alice", 25), (2, "Bob", 30), (3, "Carol", 35)], "id int, name string, age int"))
    e.register("orders", spark.createDataFrame([(1, 100), (1, 200), (2, 150)], "user_id int, amount int"))
    e.register("cats", spark.createDataFrame([("A", 10.0), ("B", 30.0), ("A", 20.0), ("C", 5.0), ("B", 40.0)], "category string, v double"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT name FROM users WHERE age > 28 ORDER BY id", [("Bob",), ("Carol",)]),
        ("SELECT category, COUNT(*) AS n FROM cats GROUP BY category ORDER BY 1", [("A", 2), ("B", 2), ("C", 1)]),
        ("SELECT category, SUM(v) s, AVG(v) a FROM cats WHERE category < 'C' GROUP BY ALL ORDER BY 1", [("A", 30.0, 15.0), ("B", 70.0, 35.0)]),
        ("SELECT u.name, SUM(o.amount) t FROM users u INNER JOIN orders o ON u.id = o.user_id GROUP BY u.name ORDER BY 1", [("Alice", 300), ("Bob", 150)]),
        ("SELECT * EXCLUDE (age) FROM users ORDER BY id LIMIT 1", [(1, "Alice")]),
        ("SELECT DISTINCT ON (category) category, v FROM cats ORDER BY category, v DESC", [("A", 20.0), ("B", 40.0), ("C", 5.0)]),
        ("SELECT quantile_cont(v, 0.5) a, quantile_disc(v, 0.5) b FROM cats", [(20.0, 20.0)]),
        ("SELECT 7 // 2 AS q, bit_and(6, 3) AS b, bit_not(0) AS n, starts_with('abc', 'ab') AS s, strpos('abc', 'c') AS p", [(3, 2, -1, True, 3)]),
        ("SELECT name FROM users WHERE name ~ '^A' AND name ^@ 'Al'", [("Alice",)]),
        ("SELECT strftime(timestamp '2024-03-05 06:07:08', '%Y/%m/%d %H:%M:%S') AS d", [("2024/03/05 06:07:08",)]),
        ("SELECT array_sum(array(1D, 2D)) s, array_mean(array(1D, 2D)) m, array_to_string(array('a','b'), '-') j, array_get(array('a','b'), 1) g", [(3.0, 1.5, "a-b", "b")]),
        ("SELECT round(sind(30D), 6) s, round(atan2d(1D, 1D), 6) a", [(0.5, 45.0)]),
        ("SELECT stdev(v) > 0 s, var(v) > 0 w FROM cats", [(True, True)]),
        ("SELECT id FROM users UNION ALL BY NAME SELECT amount, user_id AS id FROM orders", [(1, None), (2, None), (3, None), (1, 100), (1, 200), (2, 150)]),
        ("SELECT bit_and(id) b FROM users", [(0,)]),
        ("SELECT 'x // y ~ EXCLUDE(' AS s", [("x // y ~ EXCLUDE(",)]),
    ],
)
def test_sql(engine, sql, want):
    assert rows(engine.sql(sql)) == want


def test_limit_in_plan_and_errors(engine):
    assert engine.sql("SELECT * FROM users", limit=2).count() == 2
    with pytest.raises(QueryError, match="SELECT instead of SELCT"):
        engine.sql("selct * from users")
    with pytest.raises(QueryError):
        engine.sql("SELECT nope FROM users")
    assert "Filter" in engine.explain("SELECT * FROM users WHERE id > 1")
    assert typo_hint("select * form users")[1] == "select * FROM users" and typo_hint("select 1") is None


def test_files(spark, tmp_path):
    p = tmp_path / "my-log.csv"
    p.write_text("id,ts,ok,name,n\n1,2026-01-06T09:9:20Z,true,a,1.5\n2,2026-01-06,false,\"b,c\",2\n")
    df = read_csv(spark, str(p))
    assert df.dtypes == [("id", "bigint"), ("ts", "string"), ("ok", "boolean"), ("name", "string"), ("n", "double")]
    e = Engine(spark)
    e.open(str(p))
    assert rows(e.sql("SELECT name FROM this WHERE id = 2")) == rows(e.sql("SELECT name FROM `my-log` WHERE id = 2")) == [("b,c",)]
    assert e.names() == ["my-log", "this"] and table_name("/x/y.csv") == "y"
    q = tmp_path / "t.csv"
    q.write_text("junk\nmore junk\na;b\n1;2\n" + "3;4\n" * 400_000)  # over 1 MiB: options hold all the same
    d = read_csv(spark, str(q), CsvOptions(separator=";", skip_rows=2))
    assert d.columns == ["a", "b"] and d.count() == 400_001
    with pytest.raises(UnsupportedFormat):
        read_any(spark, str(tmp_path / "x.txt"))
    with pytest.raises(NotFound):
        read_any(spark, str(tmp_path / "x.csv"))
    df.write.parquet(str(tmp_path / "p.parquet"))
    assert rows(e.sql(f"SELECT count(*) c FROM read_parquet('{tmp_path}/p.parquet')")) == [(2,)]


def test_rewriter_pieces():
    assert [text_of(x).strip() for x in commas(tree("a, f(b, c), 'x,y'"))] == ["a", "f(b, c)", "'x,y'"]
    assert rewrite("SELECT * FROM t;") == "SELECT * FROM t"
