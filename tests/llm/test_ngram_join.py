import re

import pytest
from lodestone.llm.ngram_join import link_sets, ngram_jaccard, op6, pipeline_stage

SMALL = "/root/testdata/sf0.01"


def brute(rows):
    """doc_id -> (n, component) by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        k = len(sets[a] & sets[b])
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op6(spark, SMALL).collect()}
    assert got == want
    assert sum(d != c for d, (_, c) in got.items()) > 20


@pytest.mark.parametrize("tile", [2048, 3])
def test_small_cases(spark, monkeypatch, tile):
    monkeypatch.setattr("lodestone.llm.ngram_join.TILE", tile)
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, "\t".join(base).upper()), (3, ""), (4, None), (5, "one two"), (6, "ONE  two\n"), (7, "one")]
    rows += [(100 + k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(0, 40, 3)] + [(8, " ".join(base[:20]))]
    rows += [(9, "long " * 50_000), (10, "é" * 70_000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(df).collect()}
    assert got == brute(rows)


def test_large_components_by_tiles(spark, monkeypatch):
    import random

    monkeypatch.setattr("lodestone.llm.ngram_join.TILE", 8)
    r = random.Random(5)
    rows = []
    for g in range(3):  # chains of slowly changing texts, and one group of near copies
        words = [f"g{g}w{i}" for i in range(40)]
        for k in range(45):
            if g < 2:
                words[(3 * k) % 40] = f"g{g}x{k}"
                rows.append((1000 * g + r.randrange(500) * 2 + k % 2, " ".join(words)))
            else:
                rows.append((1000 * g + k, " ".join(w if i != k % 40 else "y" for i, w in enumerate(words))))
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard(df).collect()} == brute(rows)


def test_empty_null_ids_and_repeats(spark):
    kind = "doc_id long, text string"
    assert ngram_jaccard(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A b c d e f"), (None, None)]
    got = sorted(map(tuple, ngram_jaccard(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 0, None)], key=str)
    few = spark.createDataFrame([(1, "the dog " * 40), (2, "x")], kind)  # only sets that nothing can link with are left at the end
    assert sorted(map(tuple, ngram_jaccard(few).collect())) == [(1, 2, 1), (2, 1, 2)]
    kept = pipeline_stage(spark, spark.createDataFrame(rows, kind), "")
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5]


def test_trie_links_what_brute_force_links():
    import numpy as np

    rng = np.random.default_rng(3)
    core = rng.choice(4000, 60, replace=False)
    sets = []
    for _ in range(80):
        s = set(core.tolist()) if rng.random() < 0.7 else set(rng.choice(4000, 60, replace=False).tolist())
        for x in rng.choice(sorted(s), rng.integers(0, 14), replace=False).tolist():
            s.discard(x)
        s |= set(rng.integers(4000, 9000, rng.integers(0, 6)).tolist())
        sets.append(np.array(sorted(s), np.uint64))
    left, right = link_sets(sets, np.array([len(s) for s in sets]))

    def groups(pairs):
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    every = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))]
    assert groups(zip(left.tolist(), right.tolist(), strict=True)) == groups(every)


def test_stage_keeps_what_links_with_nothing_whatever_its_id(spark):
    first = [f"a{i}" for i in range(30)]
    rows = [(None, f"alone n{k} m{k} o{k} p{k} q{k}") for k in range(4)] + [(None, None), (None, ""), (None, "")]
    rows += [(3, "one id of its own here"), (3, "and another text under it"), (3, "and another text under it")]
    rows += [(None, " ".join(first)), (9, " ".join([*first[:29], "x"])), (9, "quite something else than that is"), (None, "only null ids have this"), (None, "Only null ids have this")]
    kind = "doc_id long, text string"
    found = {(r.doc_id, r.component_id) for r in ngram_jaccard(spark.createDataFrame(rows, kind)).where("n_shingles > 20").collect()}
    assert found == {(None, 9), (9, 9)}  # a class without ids is linked too
    kept = [tuple(r) for r in pipeline_stage(spark, spark.createDataFrame(rows, kind), "").collect()]
    want = [*rows[:8], rows[8], rows[11], rows[12]]
    assert sorted((r for r in kept if r[1] not in (rows[13][1], rows[14][1])), key=str) == sorted(want, key=str)
    assert sum(t in (rows[13][1], rows[14][1]) for _, t in kept) == 1
    one_null = [(None, "a b c d e f"), (5, "a b c d e f")]
    assert [r.doc_id for r in pipeline_stage(spark, spark.createDataFrame(one_null, kind), "").collect()] == [5]


def test_stage_takes_columns_of_any_name(spark):
    text = "one two three four five six seven eight"
    names = ["rid", "keep_id", "keep_rid", "one", "__rid", "c", "component_id", "RID_", "digest"]
    rows = [(2, text, *names), (1, text, *names), (3, "something else", *names), (None, None, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = pipeline_stage(spark, df, "")
    assert got.columns == df.columns and sorted((r.doc_id or 0, *r[2:]) for r in got.collect()) == [(0, *names), (1, *names), (3, *names)]
