import os
from datetime import UTC, datetime, timedelta

import pytest
from lodestone.errors import FilterSyntax
from lodestone.operators import peek
from lodestone.sources import files as X
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    for name, text in {"src/main.rs": "use std;\n// hi\npub fn main() {\n}\nstruct A {\n", "src/lib.rs": "", "data/users.csv": "a\n1\n", "data/large.csv": "x" * 5000, "config.json": '{"a": 1}', "logs/app.log": "x", ".hidden/secret.txt": "s", ".gitignore": "*.log\n.hidden/\n!keep.log\n/build/\n", "build/o.txt": "o", "keep.log": "k", "src/deep/er/x.py": "import os\n\n# c\ndef f():\n    pass\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def names(df, root):
    return {os.path.relpath(r.path, root) for r in df.collect() if not r.is_dir}


def test_scan(spark, tree):
    assert names(X.scan(spark, tree), tree) == {"src/main.rs", "src/lib.rs", "data/users.csv", "data/large.csv", "config.json", "keep.log", "src/deep/er/x.py"}
    assert names(X.scan(spark, tree, kind="csv"), tree) == {"data/users.csv", "data/large.csv"}
    assert names(X.scan(spark, tree, kind="code", size="<1KB"), tree) == {"src/main.rs", "src/lib.rs", "src/deep/er/x.py"}
    assert names(X.scan(spark, tree, size=">1KB", mtime="-7d"), tree) == {"data/large.csv"}
    assert names(X.scan(spark, tree, depth=1), tree) == {"config.json", "keep.log"} and "src/deep/er/x.py" not in names(X.scan(spark, tree, depth=2), tree)
    assert {"logs/app.log", "build/o.txt"} <= names(X.scan(spark, tree, ignore=False), tree)
    assert ".hidden/secret.txt" in names(X.scan(spark, tree, ignore=False, hidden=True), tree)
    s = X.scan_stats(X.scan(spark, tree)).first()
    assert (s.files, s.errors) == (7, 0) and s.folders >= 3


@pytest.mark.parametrize(("f", "hits"), [("1024", {1024}), (">1KB", {1025, 10485760, 10485761}), ("<10MB", {0, 1024, 1025}), ("1KB-10MB", {1024, 1025, 10485760}), ("gt: 1KB", {1025, 10485760, 10485761}), ("lt:1KB", {0}), ("eq:10MB", {10485760})])
def test_sizes(spark, f, hits):
    df = spark.createDataFrame([(x,) for x in (0, 1024, 1025, 10485760, 10485761)], "size bigint")
    assert {r.size for r in df.where(X.size_filter(f)).collect()} == hits


def test_times_types_and_syntax(spark):
    now = datetime(2024, 6, 1, tzinfo=UTC)
    df = spark.createDataFrame([(0, now - timedelta(days=3)), (1, now - timedelta(days=40)), (2, None)], "i int, modified timestamp")
    ids = lambda f: {r.i for r in df.where(X.time_filter(f, now=now)).collect()}
    assert ids("-7d") == {0} and ids("+30d") == {1} and ids("2024-01-01") == {0, 1}
    for bad in ("-24h", "soon"):
        with pytest.raises(FilterSyntax):
            X.time_filter(bad)
    with pytest.raises(FilterSyntax):
        X.parse_size("big")
    p = spark.createDataFrame([("a/data.tsv",), ("b.XML",), ("noext",), ("d.e/f",)], "path string")
    assert [r.path for r in p.where(X.type_filter("csv")).collect()] == ["a/data.tsv"] and [r.path for r in p.where(X.type_filter("xml,.yaml")).collect()] == ["b.XML"]
    assert p.where(X.path_contains("DATA")).count() == 1 and p.select(X.extension_of(F.col("path"))).collect()[2][0] is None


def test_peek(spark, tree):
    rows = {os.path.basename(r.path): r for r in peek.peek(X.read_contents(X.scan(spark, tree))).collect()}
    assert rows["main.rs"].summary == "pub fn main(); struct A" and rows["main.rs"].lines == 5 and rows["main.rs"].kind == "code"
    assert rows["x.py"].summary == "def f()" and rows["users.csv"].summary == "[binary]" and rows["config.json"].kind == "config" and rows["lib.rs"].lines == 0
    t = spark.createDataFrame([("\n".join(map(str, range(100))),), ("a\n\n# c\nb\n",)], "t string")
    got = [tuple(r) for r in t.select(peek.preview(F.col("t")), peek.compress(F.lit("py"), F.col("t")), peek.line_count(F.col("t"))).collect()]
    assert "[truncated]" in got[0][0] and got[0][2] == 100 and got[1] == ("a\n\n# c\nb", "a\nb", 4)
    p = peek.peek(X.read_contents(X.scan(spark, tree)))
    assert "main.rs" in peek.markdown(p) and "src/" in peek.tree(p) and peek.totals(p).count() >= 2
