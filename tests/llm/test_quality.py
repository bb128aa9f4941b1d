import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from lodestone.llm import quality
from lodestone.llm.common import WORD_POINTS, word_blocks

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op9(spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "good words here", "c"), (4, "x " * 60_000, "d"), (4, "x", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (2, 1, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in got)
    assert quality.score(docs.limit(0), quality.fit([])).collect() == []
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == 5


def network(model, text):
    f, n = quality.document_features(text)
    return 1 / (1 + np.exp(-((model.folded[f] * n).sum() / max(n.sum(), 1) + model.bias)))


def test_folded_scores_equal_the_network(spark):
    rows = [(k % 2, *quality.document_features(("spam! " if k % 2 else "fine prose ") * (k + 1))) for k in range(30)]
    model = quality.fit(rows)
    texts = ["spam! spam! fine", "fine prose", "unseen", "", None, "a  a\u00a0a\nb"]
    assert np.allclose(model.scores(pa.array(texts)), [network(model, t) for t in texts], atol=1e-5)
    bad, good = model.scores(pa.array(["spam! spam!", "fine prose"]))
    assert bad > 0.9 > 0.1 > good


def brute_features(text):
    """Buckets and counts, one word and one n-gram after the other."""
    words = []
    for w in (text or "").split():
        words += [w[k : k + WORD_POINTS] for k in range(0, len(w), WORD_POINTS)]
    hashed = lambda x, mult, start: int(quality._bucket(np.array([sum_of(x, mult, start)], np.uint64))[0])

    def sum_of(codes, mult, h):
        for j, c in enumerate(codes):
            h = (h * int(mult[j]) + c + 1) % 2**64
        return h

    key_of = {w: next(word_blocks(pa.array([w]))).key[0] for w in set(words)}
    out = Counter()
    for w in words:
        out[int(quality._bucket(np.array([key_of[w] ^ quality._MULT[9]]))[0])] += 1
        data = [32, *map(ord, w), 32]
        for k in quality.GRAMS:
            for i in range(len(data) - k + 1):
                out[hashed(data[i : i + k], quality._MULT, k)] += 1
    for a, b in zip(words, words[1:], strict=False):
        pair = (int(key_of[a]) * int(quality._MULT[10]) + int(key_of[b]) * int(quality._MULT[11])) % 2**64
        out[int(quality._bucket(np.array([pair], np.uint64))[0])] += 1
        out[quality._SAME if a == b else quality._OTHER] += quality.SAME_WEIGHT
    return out


def test_every_part_of_every_word_counts():
    for text in ("x" * 61, "aé中🙂 " * 50, "ab ab ab\u3000c", "ก" * 70_000 + "z", "w" * 140_000 + " q", "one two " * 300):
        f, n = quality.document_features(text)
        assert dict(zip(f.tolist(), n.tolist(), strict=True)) == dict(brute_features(text))
    # a text in several blocks gives what it gives at once
    text = "some words and " * 3000 + "y" * 70_000 + " end"
    want, whole = quality.document_features(text), quality.word_blocks
    try:
        quality.word_blocks = lambda column: whole(column, 3001)
        got = quality.document_features(text)
    finally:
        quality.word_blocks = whole
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    rows = [(k % 2, *quality.document_features("x" * 70 + ("spam" if k % 2 else "fine") * (20 + k))) for k in range(40)]
    bad, good = quality.fit(rows).scores(pa.array(["x" * 70 + tail * 45 for tail in ("spam", "fine")]))
    assert bad > 0.9 > 0.1 > good


def test_gradient_against_finite_differences():
    """One step of the training moves every weight by the rate times the slope of the loss."""
    rng = np.random.default_rng(3)
    f, n = np.arange(4), np.array([1.0, 2.0, 1.0, 3.0])
    vectors, layer, bias = rng.normal(size=(4, quality.DIM)), rng.normal(size=(2, quality.DIM)), rng.normal(size=2)
    share = (n / n.sum())[:, None]

    def loss(v, w, b):
        z = w @ (v[f] * share).sum(0) + b
        return float(np.log(np.exp(z).sum()) - z[1])

    slope_v, slope_w, slope_b = quality.gradients(vectors[f], share, layer, bias, 1)
    for x, slope in ((vectors, slope_v), (layer, slope_w), (bias, slope_b)):
        for at in np.ndindex(*x.shape):
            old = x[at]
            x[at] = old + 1e-6
            up = loss(vectors, layer, bias)
            x[at] = old - 1e-6
            down = loss(vectors, layer, bias)
            x[at] = old
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-5


def test_sample_is_bounded_where_ids_repeat(spark):
    """A labelled id that comes often is one row, and neither label loses rows to it."""
    docs = spark.createDataFrame([(k % 30, f"text {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] * 3, "doc_id long, quality int")
    got = quality.sample(docs, labels, "quality", 1000).collect()
    ids = [k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(got) == len(ids) and sum(r.label for r in got) == sum(k % 2 for k in ids)
    assert len(quality.sample(docs, labels, "quality", 5).collect()) == 5
