import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import language_id as L

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = L.op8(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_spans_of_a_mixed_text_and_scripts(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog sat on the mat with this", "en"), ("der Hund und die Katze sitzen auf einer Matte", "de"), ("кот и собака сидят на коврике", "ru")] * 12)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    en, de = "the dog and the cat with this mat", "der Hund und die Katze auf einer Matte"
    text = f"{en} {de} {de}"
    lang, score, spans = model.label(pa.array([text, "собака и кот", "12 34 !", ""]), True)
    assert lang == ["de", "ru", "und", "und"] and score[2] == score[3] == 0
    assert spans[0] == [(0, len(en), "en"), (len(en) + 1, len(text), "de")]


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_viterbi_against_enumeration(monkeypatch, segment):
    from itertools import product

    monkeypatch.setattr(L, "SEGMENT", segment)
    rng = np.random.default_rng(2)
    words, count = rng.normal(0, 6, (17, 3)), np.array([5, 0, 7, 5])
    path = L.best_path(words, count)
    stop = np.cumsum(count)
    for t in (0, 2, 3):
        at = np.arange(stop[t] - count[t], stop[t])
        cost = lambda p, at=at: sum(words[i, x] for i, x in zip(at, p, strict=True)) - L.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert abs(cost(path[at]) - max(map(cost, product(range(3), repeat=len(at))))) < 1e-9


def test_scripts_and_long_texts(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog sat on the mat", "en"), ("der Hund und die Katze sitzen auf einer Matte", "de"), ("ሰላም ለዓለም ሁሉ", "am"), ("မြန်မာ စကား ပြော", "my")] * 10)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["ሰላም ሁሉ", "စကား", "ｔｈｅ ｃａｔ", "१२३ ४५", "the cat sat " * 400_000 + "der Hund", "der" * 700_000]
    lang, score, spans = model.label(pa.array(texts), True)
    assert lang[:2] == ["am", "my"] and lang[2] != "und" and lang[3] == "und" and lang[4] == "en" and lang[5] != "und"
    assert spans[4][-1][1] == len(texts[4]) and [g for _, _, g in spans[4]] in (["en", "de"], ["en"])
    # a text in blocks gives what it gives at once
    monkey = L.word_blocks
    try:
        L.word_blocks = lambda column: monkey(column, 4000)
        small = pa.array([("the dog and der Hund sitzen " * 900) + "ሰላም ሁሉ", None, "x" * 9000])
        cut = model.label(small, True)
    finally:
        L.word_blocks = monkey
    whole = model.label(small, True)
    assert cut[0] == whole[0] and cut[2] == whole[2] and np.allclose(cut[1], whole[1], atol=1e-5)


def test_edge_rows(spark):
    kind = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(1, None, "en", ""), (2, "", "en", ""), (3, "hello there", None, ""), (None, "hello", "en", ""), (5, "the and " * 30_000, "en", ""), (5, "the", "", ""), (6, "\x00  …", "en", "")], kind)
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs, L.train(docs)).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "en"), (None, "en"), (5, "en"), (6, "und")}
    assert L.identify(docs.limit(0), L.train(docs.limit(0))).collect() == []
    assert {r.lang_pred for r in L.identify(docs, L.train(docs.limit(0))).collect()} == {"und"}
