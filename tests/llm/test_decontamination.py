import re
from collections import Counter

import pytest
from lodestone.llm import decontamination as D

SMALL = "/root/testdata/sf0.01"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    """{(doc_id, item_id): best similarity} over all windows of the size of the item."""
    out = {}
    bags = []
    for i, t in items:
        w = split(t)
        if w:
            k = min(5, len(w))
            bags.append((i, len(w), k, Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))))
    for d, t in docs:
        w = split(t)
        have = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in {b[2] for b in bags}}
        for i, m, k, bag in bags:
            if len(w) < m or not (bag.keys() & have[k]):
                continue
            n = m - k + 1
            for s in range(len(w) - m + 1):
                own = Counter(tuple(w[j : j + k]) for j in range(s, s + n))
                c = sum((own & bag).values())
                if 100 * c >= 75 * (2 * n - c):
                    out[d, i] = max(out.get((d, i), 0), c / (2 * n - c))
    return out


def got_of(df):
    return {(r.doc_id, r.item_id): r.similarity for r in df.collect()}


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = got_of(D.op1(spark, SMALL))
    assert len(want) > 5 and got == pytest.approx(want)


def test_edits_and_edges(spark):
    item = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(item)), (2, "just four short words"), (3, None), (4, ""), (5, "Only\tONE"), (None, "a b c d e f g h"), (1, " ".join(item)), (6, "x y x y x y x y x y x y")]
    pre = [f"p{i}" for i in range(30)]
    docs = [(10, " ".join(pre + item + pre)), (11, " ".join(pre + item[:20] + ["new"] + item[20:] + pre)), (12, " ".join(pre + item[:20] + item[21:] + pre)), (13, " ".join(item[:30])), (14, " ".join(item[:10] + pre + item[10:]))]
    docs += [(15, "one JUST four Short words two"), (16, "only one"), (17, "only"), (18, None), (19, ""), (None, "z a b c d e f g h"), (20, "y x y x y x y x y x y x y x"), (10, " ".join(pre)), (21, "far " * 20_000 + " ".join(item))]
    docs += [(30 + k, " ".join(pre + [w if j not in (3 * k, 3 * k + 1) else "q" for j, w in enumerate(item)] + pre)) for k in range(12)]
    d = spark.createDataFrame([(a, t, "c") for a, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(10, 1), (11, 1), (12, 1), (15, 2), (16, 5), (None, None), (20, 6), (21, 1)} <= want.keys() and (14, 1) not in want
    assert got_of(D.contaminated(d, b)) == pytest.approx(want)
    kept = {r.doc_id for r in d.join(spark.createDataFrame([(x,) for x, _ in want], "bad long"), d["doc_id"].eqNullSafe(__import__("pyspark").sql.functions.col("bad")), "left_anti").collect()}
    assert 13 in kept and 14 in kept


def test_empty_and_native(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(d, item).collect() == D.contaminated(full, b).collect() == []
    plan = D.op1(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprints_within_the_radius_share_a_block(spark):
    import random

    r = random.Random(4)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        pairs.append((a - 2**63, (a ^ sum(1 << j for j in r.sample(range(64), D.RADIUS))) - 2**63))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.select(D.F.size(D.F.array_intersect(D.blocks(D.F.col("a")), D.blocks(D.F.col("b")))).alias("n")).where("n < 1").count() == 0


def test_one_block_gives_a_pair(spark):
    import random

    r = random.Random(5)
    pairs = [(r.getrandbits(64) - 2**63, r.getrandbits(64) - 2**63) for _ in range(200)] + [(5, 5), (-1, 0)]
    df = spark.createDataFrame(pairs, "a long, b long")
    both = D.F.array_intersect(D.blocks(D.F.col("a")), D.blocks(D.F.col("b")))
    low = D.F.floor(D.F.array_min(both) / 65536).cast("int")
    assert df.where(~low.eqNullSafe(D.first_equal(D.F.col("a"), D.F.col("b")))).count() == 0


def test_the_stage_judges_rows_by_their_own_texts(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"pre {item} post", "a"), (1, "clean words of another row", "b"), (None, item, "c"), (None, "clean words without an id", "d"), (2, None, "e"), (2, "", "f"), (3, f"pre {item} post", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    assert sorted(r.k for r in D.pipeline_stage(spark, docs, str(tmp_path)).collect()) == ["b", "d", "e", "f"]


def test_texts_shorter_than_the_item(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(item[:38])), (2, " ".join(item[2:])), (3, " ".join(item[:18] + item[19:])), (4, " ".join(item[:31])), (5, " ".join(item[:30])), (6, " ".join(item[:4])), (7, " ".join(item[:38]) + " w38 w39")]
    docs += [(8, "x y x y x y x y x y x"), (9, "just four short"), (10, " ".join(item[:20] + ["q"] + item[21:39]))]
    items = [(1, " ".join(item)), (2, "x y x y x y x y x y x y"), (3, "just four short words")]
    want = {}
    for d, t in docs:
        for i, u in items:
            w, v = split(t), split(u)
            k, size = min(5, len(v)), min(len(w), len(v))
            bag = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            for s in range(len(w) - size + 1):
                own = Counter(tuple(w[j : j + k]) for j in range(s, s + size - k + 1))
                c = sum((own & bag).values())
                if 100 * c >= 75 * (sum(own.values()) + sum(bag.values()) - c):
                    want[d, i] = max(want.get((d, i), 0), c / (sum(own.values()) + sum(bag.values()) - c))
    assert {(1, 1), (2, 1), (4, 1), (7, 1), (8, 2)} <= want.keys() and not {5, 6, 9} & {d for d, _ in want} and want[1, 1] == 34 / 36
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert got_of(D.contaminated(d, spark.createDataFrame(items, "item_id long, text string"))) == pytest.approx(want)
