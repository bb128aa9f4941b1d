import os

import numpy as np
import pytest
from lodestone import tools
from lodestone.engine import Engine
from lodestone.errors import ModelFailed, NotFound, NotPermitted, QueryError, from_os
from lodestone.operators import encoder, kernels
from lodestone.operators.text_index import bucket, bucket_of
from lodestone.plans import dialect as R
from lodestone.sources import files
from lodestone.streaming.watch import WatchReader, changes


def test_rewriter_leaves_literals_and_comments():
    sql = "SELECT 'a ~ b' AS t FROM x WHERE t ~ 'b.*' AND c ^@ 'q''s' AND d !~ e -- f ~ g"
    assert R.rewrite(sql) == "SELECT 'a ~ b' AS t FROM x WHERE t RLIKE 'b.*' AND startswith(c, 'q''s') AND NOT (d RLIKE e) -- f ~ g"
    assert R.rewrite("SELECT 'UNION BY NAME' AS a", lambda q: ["x"]) == "SELECT 'UNION BY NAME' AS a"
    both = R.rewrite("SELECT 1 AS a UNION BY NAME SELECT 2 AS b UNION ALL BY NAME SELECT 3 AS c", lambda q: ["a"])
    assert both.count("UNION ALL") == 1 and both.count("UNION") == 2 and "NAME" not in both
    assert R.typo_hint("SELECT selected FROM t") is None and R.typo_hint("selec a from t")[1] == "SELECT a from t"


def test_star_forms_and_statements(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "a int, b string, c_a double"))
    assert e.sql("SELECT 0 AS z, * REPLACE (a * 2 AS a) FROM t ORDER BY a").collect() == [(0, 2, "x", 2.0), (0, 4, "y", 3.0)]
    assert e.sql("SELECT COLUMNS('a$') FROM t").columns == ["a", "c_a"]
    for bad in ("SELECT COLUMNS('zz') FROM t", "SELECT * REPLACE (1 AS zz) FROM t", "DROP TABLE zz", "TRUNCATE TABLE zz", "CREATE TABLE t AS SELECT 1"):
        with pytest.raises(QueryError):
            e.sql(bad)
    e.sql("CREATE OR REPLACE TABLE t AS SELECT 1 AS a")
    assert e.sql("SELECT * FROM t").collect() == [(1,)] and e.sql("DROP TABLE IF EXISTS zz") is not None
    with pytest.raises(QueryError):
        e.sql("DROP TABLE t")
        e.sql("SELECT * FROM t").collect()


def test_folder_of_a_term_is_that_of_the_column(spark):
    words = ["license", "数据", "", "𠮷", "a" * 100]
    got = spark.createDataFrame([(w,) for w in words], "term string").select("term", bucket().alias("b")).collect()
    assert {r.term: r.b for r in got} == {w: bucket_of(w) for w in words}


def test_ranks_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3 if k % 7 else None, None if k % 11 == 0 else float(rng.integers(0, 40))) for k in range(2000)] + [(9, None), (8, 1.5)]
    df = spark.createDataFrame(rows, "g int, v double")
    for p in (0, 50, 95, 100):
        got = {r.g: r.x for r in kernels.group_percentile(df, ["g"], "v", p, "x").collect()}
        want = {}
        for g in {r[0] for r in rows}:
            v = sorted((x for k, x in rows if k == g), key=lambda x: (x is not None, x))
            want[g] = v[min(len(v) * p // 100, len(v) - 1)]
        assert got == want


def test_rules_from_outside_and_errors(tmp_path):
    root = tmp_path / "r"
    (root / ".git" / "info").mkdir(parents=True)
    (root / "sub").mkdir()
    for name in ("a.txt", "b.log", "sub/c.bak", "sub/d.txt"):
        (root / name).write_text("x")
    (root / ".git" / "info" / "exclude").write_text("*.bak\n")
    (tmp_path / "git").mkdir()
    (tmp_path / "git" / "ignore").write_text("*.log\n")
    rules = files.outer_rules(str(root), {"XDG_CONFIG_HOME": str(tmp_path)})
    assert sorted(os.path.basename(r[0]) for r in files.walk(str(root), above=rules)) == ["a.txt", "d.txt", "sub"]
    os.symlink("/no/such", root / "broken")
    told = [r for r in files.walk(str(root), links=True, errors=True, above=[]) if r[-1]]
    assert len(told) == 1 and told[0][0].endswith("broken") and "FileNotFound" in told[0][-1]
    assert isinstance(from_os(FileNotFoundError(2, "gone", "f")), NotFound) and isinstance(from_os(PermissionError(13, "no", "f")), NotPermitted)


def test_looks_are_kept_and_bounded(tmp_path):
    root, state = tmp_path / "r", tmp_path / "s"
    root.mkdir()
    for k in range(5):
        (root / f"{k}.txt").write_text("x")
    reader = WatchReader({"path": str(root), "state": str(state), "batch_size": "3"})
    first, at = reader.read(reader.initialOffset())
    second, end = reader.read(at)
    third, same = reader.read(end)
    assert [len(list(x)) for x in (first, second, third)] == [3, 2, 0] and same == end
    again, _ = reader.read(reader.initialOffset())
    assert [r[1] for r in again] == [r[1] for r in reader.readBetweenOffsets({"look": 0}, {"look": 1})]
    (root / "0.txt").write_text("longer")
    os.remove(root / "1.txt")
    assert [(r[0], os.path.basename(r[1])) for r in reader.read(end)[0]] == [("modified", "0.txt"), ("deleted", "1.txt")]
    assert changes({"a": [1, 1]}, {"a": [1, 1]}) == []


def _field(n: int, value) -> bytes:
    def varint(x: int) -> bytes:
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(n << 3 | 2) + varint(len(value)) + value


def tiny_model(path, table: np.ndarray) -> None:
    """An ONNX file whose states are rows of a table, one for each id."""
    kind = lambda name, elem, *dims: _field(1, name) + _field(2, _field(1, _field(1, elem) + _field(2, b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims))))
    weights = b"".join(_field(1, d) for d in table.shape) + _field(2, 1) + _field(8, "t") + _field(9, table.astype("<f4").tobytes())
    node = _field(1, "t") + _field(1, "input_ids") + _field(2, "states") + _field(3, "n") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "g") + _field(5, weights) + _field(11, kind("input_ids", 7, "n", "w")) + _field(12, kind("states", 1, "n", "w", table.shape[1]))
    path.write_bytes(_field(1, 8) + _field(8, _field(1, "") + _field(2, 13)) + _field(7, graph))


def test_encoder_of_a_tiny_model(spark, tmp_path):
    import public_tokenizers

    words = public_tokenizers.path("byte_bpe_50k.json")
    of = encoder.Tokenizer(words)
    table = np.random.default_rng(2).normal(size=(of.vocab_size(), 6))
    model = tmp_path / "m.onnx"
    tiny_model(model, table)
    texts = ["one two three", "one", "", "a longer text than the others, cut at the end " * 40]
    want = []
    for ids in of.encode(texts):
        v = table[ids[:512]].astype(np.float32).mean(0) if ids else np.zeros(6)
        want.append(v / (np.linalg.norm(v) or 1))
    got = encoder.Encoder(str(model), words)(texts, batch=3)
    assert np.allclose(got, want, atol=1e-5)
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "path int, content string")
    rows = {r.path: r.embedding for r in encoder.encode_frame(df, str(model), words).collect()}
    assert np.allclose([rows[k] for k in range(4)], want, atol=1e-5) and rows[4] is None
    hits = tools.semantic_search(spark, str(_texts(tmp_path)), "one two", encoder.Encoder(str(model), words), 1)
    assert hits[0]["path"].endswith("b.txt")
    with pytest.raises(ModelFailed):
        encoder.Encoder(str(tmp_path / "none.onnx"), words)
    with pytest.raises(ModelFailed):
        encoder.Tokenizer(str(tmp_path / "none.json"))


def _texts(tmp_path):
    root = tmp_path / "texts"
    root.mkdir()
    (root / "a.txt").write_text("quite another thing")
    (root / "b.txt").write_text("one two")
    return root


def test_deltas_are_merged_and_old_ones_deleted(spark, tmp_path):
    from datetime import datetime

    from lodestone.operators.text_index import TextIndex
    from lodestone.streaming import incremental as I

    world = {f"d{k}": f"text number{k}" for k in range(6)}
    index = I.IncrementalIndex(spark, str(tmp_path / "i"), lambda p: p.join(spark.createDataFrame(list(world.items()), "path string, content string"), "path"), compact=2)
    event = lambda kind, path, k: (kind, path, None, datetime(2024, 1, 1, 0, 0, k))
    for k in range(4):
        index.apply(spark.createDataFrame([event("created", f"d{k}", k), event("deleted", f"d{k - 2}", k)], I.EVENTS), k)
        i = TextIndex.open(spark, index.folder)
        alive = {f"d{j}" for j in range(max(0, k - 1), k + 1)}
        assert {r.doc_id for r in i.scores("text").collect()} == alive and i.doc_count() == len(alive) and i.stats[1] == 2.0
    names = [n for n in os.listdir(index.folder) if n.startswith(("gen-", "delta-"))]
    assert {n[: n.rindex("-")] for n in names} == {"gen-b1", "gen-b3", "delta-b2", "delta-b3"} and index.batch_done() == 3 and index.log().count() == 8




def test_group_quantiles_gather_no_group(spark):
    """As DuckDB has them, with nulls, infinities, copies and groups of one; no aggregate of the plan keeps a group's values."""
    import random

    import duckdb

    r = random.Random(4)
    rows = [(None if k % 17 == 0 else f"g{k % 3}", None if r.random() < 0.1 else r.choice([r.random() * 1e6, 7.0, -0.5, float("inf")])) for k in range(5000)]
    rows += [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"a": ("cont", 0.25), "b": ("disc", 0.9), "c": ("cont", 0.0), "d": ("disc", 1.0), "e": ("cont", 0.5), "f": ("disc", 0.0)}
    out = kernels.group_quantiles(df, ["g"], "v", **shares)
    got = {x["g"]: tuple(x)[1:] for x in out.collect()}
    con = duckdb.connect()
    con.execute("create table t (g varchar, v double)")
    con.executemany("insert into t values (?, ?)", rows)
    want = con.execute(f"select g, {', '.join(f'quantile_{k}(v, {p})' for k, p in shares.values())} from t group by g").fetchall()
    assert set(got) == {x[0] for x in want}
    for g, *values in want:
        assert all(a == b or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got[g], values, strict=True)), (g, got[g], values)
    from lodestone.plans import catalog

    plan = catalog.QUERIES["quantiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile_cont" not in plan and "percentile(" not in plan
