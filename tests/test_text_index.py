import pytest
from hypothesis import given
from hypothesis import strategies as st
from lodestone.errors import SearchSyntax
from lodestone.operators import text_index as X
from pyspark.sql import functions as F

DOCS = [
    ("error.log", "2024 ERROR Failed to connect. error message: timeout\nsecond line\ncritical error message here"),
    ("chinese.txt", "这是一个错误日志 数据处理"),
    ("mixed.txt", "error 错误处理 log file"),
    ("hello.rs", 'fn main() { println!("Hello, world"); }'),
    ("data.json", '{"name": "test", "config_value": 42}'),
    ("db.txt", "database connection pool"),
    ("typo.txt", "databse error"),
    ("config.log", "configuration of the configurator message error"),
]


@pytest.fixture(scope="module")
def index(spark):
    return X.TextIndex.build(spark.createDataFrame(DOCS, "path string, content string"))


def found(index, q, **k):
    return [r.path for r in index.search(q, **k).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [("hello world", ["hello", "world"]), ("Hello WORLD", ["hello", "world"]), ("test123 error404", ["test123", "error404"]), ("hello_world test_case", ["hello_world", "test_case"]), ("  ", []), ("数据处理", ["数据", "据处", "处理"]), ("error 错误处理 log", ["error", "错误", "误处", "处理", "log"]), ("a,错。b", ["a", "错", "b"])],
)
def test_tokens(spark, text, want):
    assert X.tokenize(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(X.tokens(F.col("t"))).first()[0] == want


def test_standard_queries(index):
    assert set(found(index, "error")) == {"error.log", "mixed.txt", "typo.txt", "config.log"}
    assert set(found(index, '"error message"')) == {"error.log"}
    assert set(found(index, "+error +critical")) == {"error.log"}
    assert set(found(index, "error AND log")) == {"mixed.txt"}
    assert set(found(index, "error -message")) == {"mixed.txt", "typo.txt"}
    assert set(found(index, "error NOT (message OR log)")) == {"typo.txt"}
    assert set(found(index, "Hello, world")) == {"hello.rs"}
    assert set(found(index, "database fn")) == {"db.txt", "hello.rs"}
    assert set(found(index, "数据处理")) == {"chinese.txt"} and set(found(index, "错误")) == {"chinese.txt", "mixed.txt"}
    assert found(index, "") == found(index, "!!") == []
    assert set(found(index, "error", file_type="log")) == {"error.log", "config.log"} and found(index, "error", k=1)[0] in {"typo.txt", "error.log"}


def test_prefix_and_fuzzy(index):
    assert set(found(index, "config*")) == {"data.json", "config.log"}
    assert set(found(index, "~databse")) == {"db.txt", "typo.txt"} and found(index, "~databse")[0] == "typo.txt"
    assert "error.log" in found(index, "~eror")
    assert found(index, "~zzzzzzzz") == []


@pytest.mark.parametrize(("q", "want"), [("config*", ("prefix", "config")), ("~databse", ("fuzzy", "databse")), ("error", ("standard", "error")), ("*", ("standard", "*")), ("~", ("standard", "~")), ("", ("standard", "")), ("  config*  ", ("prefix", "config"))])
def test_analyze(q, want):
    assert X.analyze(q) == want


@pytest.mark.parametrize("q", ['"open', "(a", "a)", "AND a", "a NOT"])
def test_syntax(q):
    with pytest.raises(SearchSyntax):
        X.parse(q)


def test_scores_are_bm25(index):
    import math

    rows = index.search("error").collect()
    docs = {p: X.tokenize(t) for p, t in DOCS}
    avg = sum(map(len, docs.values())) / len(docs)
    df = sum("error" in t for t in docs.values())
    for r in rows:
        t = docs[r.path]
        tf = t.count("error")
        assert r.score == pytest.approx(math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)))
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_snippets_and_places(spark, index):
    row = index.search("critical").select(X.snippet(F.col("content"), ["critical"]), *X.line_column(F.col("content"), ["critical"])).first()
    assert "<b>critical</b>" in row[0] and (row[1], row[2]) == (3, 1)


def test_saved_index_and_updates(spark, tmp_path):
    from lodestone.operators.text_index import TextIndex

    old = spark.createDataFrame([("a.txt", "initial text", 1), ("a.txt", "updated text", 2), ("bin.dat", "x\x00y", 1)], "path string, content string, modified bigint")
    TextIndex.build(old).save(str(tmp_path / "i"))
    i = TextIndex.open(spark, str(tmp_path / "i"))
    assert found(i, "updated") == ["a.txt"] and found(i, "initial") == [] and i.doc_count() == 1


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_damerau_is_a_metric(a, b):
    d = X.damerau(a, b, 20)
    assert d == X.damerau(b, a, 20) and (d == 0) == (a == b) and d <= max(len(a), len(b))
    assert X.damerau("abcd", "badc", 9) == 2 and X.damerau("ca", "abc", 9) == 2 and X.damerau("ab", "ba", 9) == 1


def test_every_term_of_a_prefix_or_fuzzy_leaf_counts(spark):
    docs = [(f"{k:04d}", f"pre{k:04d} rest") for k in range(1200)] + [("z", "prezzz rest"), ("other", "rest only")]
    docs += [(f"f{a}{b}", f"wor{a}{b} filler") for a in "abcdefghijklmnopqrstuvwxyzäöüß0123456789" for b in "abcdefghijklmnopqrstuvwxyzäöüß0123456789"]
    i = X.TextIndex.build(spark.createDataFrame(docs, "path string, content string"))
    assert len(found(i, "pre*", k=5000)) == 1201 and found(i, "+pre* +prezzz", k=5000) == ["z"]
    assert found(i, "rest NOT pre*", k=5000) == ["other"]
    assert len(found(i, "~world", k=5000)) == sum(X.damerau(c.split()[0], "world", 2) <= 2 for _, c in docs) > 1000
