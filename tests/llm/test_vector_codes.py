"""Operator 12 against a plain version in Python's integers, and its edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v string, of int, part int"


def brute(rows, parts, entries, rounds, scale=256):
    """rows: (vec_id, vector, label), all sound, in the order of their ids."""
    ints = [[math.floor(x * scale) for x in v] for _, v, _ in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [best(c[p], books[p])[1] for c in cut]
            new.append([[sum(col) // len(col) for col in zip(*[c[p] for c, o in zip(cut, of, strict=True) if o == k], strict=True)] if k in of else e for k, e in enumerate(books[p])])
        books = new
    got = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in g) for g in got]
    label = {}
    for (_, _, lab), e in zip(rows, error, strict=True):
        label[lab] = label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in g), e, label[lab], sha) for (i, _, lab), g, e in zip(rows, got, error, strict=True))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, lab, "x", "y", 3, 1) for i, v, lab in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("size", [1.0, 1e-3, 3e4, 1e12, 1e30])
def test_equals_plain_version(spark, size):
    r = random.Random(5)
    rows = [(i, [r.uniform(-size, size) if r.random() < 0.9 else float(round(r.uniform(-2, 2))) for _ in range(8)], r.choice([None, 1, 2])) for i in range(90)]
    want = brute(rows, 4, 10, 2)
    got = rows_of(V.compress(frame(spark, rows), parts=4, entries=10))
    fits = all(w[2] < 1 << 63 for w in want)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
    if fits:
        assert got == want
    else:
        assert [g[2] for g in got] == [w[2] if w[2] < 1 << 63 else None for w in want]


def test_large_entry_among_small_rows(spark):
    rows = [(0, [1e25, 1.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.5], None), (3, [-1e25, 7.0], None), (4, [2.0, 2.0], 2)]
    for rounds in (0, 1, 2):
        want = brute(rows, 1, 3, rounds)
        got = rows_of(V.compress(frame(spark, rows), parts=1, entries=3, rounds=rounds))
        assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
        assert [g[2] for g in got] == [w[2] if w[2] < 1 << 63 else None for w in want]


def test_left_out_rows_and_empty_table(spark):
    good = [(5, [0.1, 0.2], 1), (6, [0.1, 0.2], 1), (9, [-0.5, 4.0], None)]
    bad = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 1.0], 2), (7, [], 1), (8, [1.0, 2.0, 3.0], 1), (10, [1.0, 2.0, 3.0, 4.0], 1)]
    assert rows_of(V.compress(frame(spark, good + bad), parts=2)) == brute(good, 2, 64, 2)
    assert V.compress(frame(spark, bad[:5]), parts=2).collect() == []
    empty = V.compress(spark.createDataFrame([], SCHEMA), parts=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_repeated_rows_ties_and_null_ids(spark):
    rows = [(1, [1.0, 1.0], 1)] * 3 + [(2, [1.0, 1.0], 1), (3, [2.0, 2.0], 1)]
    assert rows_of(V.compress(frame(spark, rows), parts=1, entries=4)) == brute(rows, 1, 4, 2)
    got = V.compress(frame(spark, [*rows, (None, [2.0, 2.0], 1)]), parts=1, entries=5).collect()
    assert [r["code"] for r in got if r["vec_id"] is None] == ["04"] and len(got) == 6
    assert len(V.compress(frame(spark, [(None, [2.0, 2.0], 1)] * 2), parts=1).collect()) == 2


def test_decode_gives_entries(spark):
    rows = [(i, [float(i % 3), float(i % 2) - 0.5], 0) for i in range(30)]
    books = V.train(frame(spark, rows), parts=2, entries=30)
    coded = V.encode(frame(spark, rows), books)
    assert coded.where("error <> 0").count() == 0
    back = {r["vec_id"]: r["vector"] for r in V.decode(coded, books).collect()}
    assert back == {i: v for i, v, _ in rows}


def test_limbs():
    for v in (0, 1, -1, 1 << 40, -(1 << 40), 3 << 80, -(7 << 90) - 5, (1 << 39) - 1):
        whole = sum(int(x[0]) << (V.LIMB * k) for k, x in enumerate(V.limbs_of(np.array([v], object))))
        assert whole == v


def test_plan_has_no_cross_join(spark):
    rows = [(i, [float(i), 0.0], i % 2) for i in range(20)]
    plan = V.compress(frame(spark, rows), parts=2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
