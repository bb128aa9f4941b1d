"""Rules that read no table, and expressions over made rows, against their SQL or stated results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import history, peek
from lodestone.plans import coverage

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(coverage.FIXED))
def test_fixed(spark, name):
    run, sql = coverage.FIXED[name]
    df = run(spark, SMALL)
    columns = sorted(df.columns)
    cursor = duckdb.connect().execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize(
    ("ext", "text", "want"),
    [
        ("py", "import os\nfrom x import y\nclass A(B):\n    def f(self, a: int):\n        pass\nasync def g():\n", "class A(B); def f(self, a; async def g()"),
        ("rs", "use std::fs;\npub fn a(x: u8) -> u8 {\nimpl T for U {\nconst X: u8 = 1;\npub(crate) fn b() {}\nenum E { A }\n", "pub fn a(x: u8) -> u8; impl T for U; enum E"),
        ("ts", "import x\nexport class A {\n  const b = { c }\nlet d\ninterface E {}\n", "export class A; const b ="),
        ("go", "// c\npackage main\n\nfunc a() {\n# no\n}\n", "package main; func a() {; }"),
        ("py", "x = 1\n", "[empty]"),
        ("js", "\n".join(f"function f{k}() {{" for k in range(20)), "; ".join(f"function f{k}()" for k in range(8))),
    ],
)
def test_outline(spark, ext, text, want):
    assert spark.createDataFrame([(ext, text)], "e string, t string").select(peek.outline(F.col("e"), F.col("t"))).first()[0] == want


def test_type_advice_has_an_else(spark):
    kind = "id long, query string, path string, file_type string, search_type string"
    h = spark.createDataFrame([(k, "q", p, t, "text") for k, (p, t) in enumerate([("a", "py"), ("a", "py"), ("a", "rs"), ("b", "rs"), ("b", "rs"), ("c", "csv")])], kind)
    of = lambda q: sorted((r.value, r.confidence) for r in history.recommend_types(h, q).collect())
    assert of("all rs files") == [("csv", 0.6), ("py", 0.6)]
    assert of("anything") == [("rs", 0.5)]
    assert of("rs and py") == [("csv", 0.6), ("py", 0.6), ("rs", 0.6)]
    only = h.where("path = 'b'")
    assert [r.value for r in history.recommend_types(only.unionAll(only), "rs files").collect()] == ["rs"]


def test_savings_of_columns_and_numbers(spark):
    got = spark.createDataFrame([(1000, 100), (7, 5), (10, 90)], "a long, b long").select(*[c.alias(k) for k, c in history.savings(F.col("a"), F.col("b")).items()]).collect()
    assert [r.asDict() for r in got] == [pytest.approx(history.token_savings(a, b)) for a, b in ((1000, 100), (7, 5), (10, 90))]


def test_compressed_rust(spark):
    text = "use a;\n\n// no\nlet x = 1;\nx + 1;\n    return x;\n}\n"
    assert spark.createDataFrame([("rs", text)], "e string, t string").select(peek.compress(F.col("e"), F.col("t"))).first()[0] == "use a;\nlet x = 1;\n    return x;\n}"
