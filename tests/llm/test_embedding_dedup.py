import numpy as np
import pytest
from lodestone.llm.embedding_dedup import near_duplicates


def brute(rows):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and bool(np.isfinite(r[1]).all()) and bool(np.any(r[1])) for r in rows]
    links, up = [0] * n, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [2048, 7])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr("lodestone.llm.embedding_dedup.TILE", tile)
    rng = np.random.default_rng(5)
    rows, k = [], 1000
    for c in range(30):
        core = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 12))):
            v = core + rng.standard_normal(16) * rng.choice([0, 0.01, 0.1, 0.14])
            rows.append((k, [float(x) for x in v], c % 3))
            k -= 1
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None] * 8, 1), (2003, [float("nan")] * 16, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [3.0, 4.0], 1), (2007, [6.0, 8.0], 1), (2008, [1e200, 1e200], 2), (2009, [2e200, 2e200], 2)]
    rows += [(2010, [float("inf")] + [1.0] * 15, 0)]
    want = {r[0]: r for r in brute([r for r in rows if r[0] not in (2008, 2009)])}
    want |= {2008: (2008, 1, 2008, True), 2009: (2009, 1, 2008, False)}
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == want


def test_empty_null_ids_and_repeats(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert near_duplicates(spark.createDataFrame([], kind)).collect() == []
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1), (4, [1.0], 1), (None, None, 1)], kind)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, None)], key=str)
