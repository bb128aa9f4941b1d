import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import sentencepiece_codec as S

SMALL = "/root/testdata/sf0.01"
PIECES = S.Pieces(S.default_model())
MODEL = sentencepiece.SentencePieceProcessor(model_file=S.default_model())


def test_whole_table_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = S.op4(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.ids == MODEL.encode(docs[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    back = {r.doc_id: r.text for r in S.decode_frame(S.op4(spark, SMALL)).collect()}
    assert back == docs


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "a\n\nb\tc\r\n", "café ünï 😀 日本 ﬁ", "x" * 1000, " " * 100, "<s> </s> <unk> <0x0A>", "▁ under▁line", "\x00\x01", "a" + " " * 17 + "b", "12 345.67", "мир" * 40])
def test_texts(text):
    (ids,) = S.encode_block([text], PIECES)
    assert ids.tolist() == MODEL.encode(text)
    assert S.decode(ids, PIECES) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n▁aethnosri.é😀"), st.characters(blacklist_categories=("Cs",))), max_size=80), min_size=1, max_size=4))
def test_random_texts(texts):
    assert [i.tolist() for i in S.encode_block(texts, PIECES)] == [MODEL.encode(t) for t in texts]


def test_long_words_by_heap_equal_the_columns():
    r = random.Random(2)
    for _ in range(200):
        w = "▁" + "".join(r.choice("aethnosrixq") for _ in range(r.randint(1, 60)))
        got = [PIECES.id[p] for p in S.fold_long(w, PIECES)]
        points = np.array([ord(c) for c in w], np.uint32)
        ids, n = S.fold_words(points, np.array([0]), np.array([len(w)]), PIECES)
        assert ids.tolist() == got and n.tolist() == [len(got)]


def test_edge_rows(spark):
    kind = "doc_id long, text string, ids string"
    rows = [(1, None, "c"), (2, "", "c"), (None, "a b", "c"), (3, "long " * 60_000 + "y" * 60_000, "c"), (3, "a b", "c")]
    got = S.encode(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert {(r.doc_id, r.n_tokens, r.ids is None) for r in got if r.n_tokens < 9} == {(1, 0, True), (2, 0, False), (None, 2, False), (3, 2, False)}
    assert S.encode(spark.createDataFrame([], kind)).collect() == []


def test_relational_lattice_of_words(spark):
    words = {"▁" * k + w for d in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect() for k in (0, 1) for w in (d.text or "").split()[:200]}
    words = sorted(w for w in words if len(w) <= 30) + ["▁▁▁", "🙂é", "\x01", "▁中a", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "▁" + "-" * 25]
    df = spark.createDataFrame([(w,) for w in words] + [("",), (None,), (words[0],)], "word string")
    got = {r.word: r.ids for r in S.encode_words(df).collect()}
    pieces = S.Pieces(S.default_model())

    def want(w):
        out = []
        for p in S.fold_long(w, pieces):
            out += [pieces.id[p]] if p in pieces.id else pieces.byte_id[list(p.encode())].tolist()
        return out

    assert len(got) == len(words) + 2 and got[""] == [] and got[None] is None
    assert all(got[w] == want(w) for w in words)
