import numpy as np
from lodestone.llm import toxicity as T

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_disguises(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    decoder = T.Decoder(T.character_counts(docs))
    lexicon = T.train(docs, labels, decoder)
    rows = T.score(docs, decoder, lexicon).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.9
    of = T.scorer(decoder, lexicon)
    plain = of("the thing an idiot and a moron said")
    assert plain > of("the thing an and a said") and plain >= 0.5
    for text in ("the thing an 1d10t and a m0r0n said", "the thing an idiooot and a morooon said", "the thing an i d i o t and a m o r o n said", "the thing an i.d.i.o.t and a m-o-r-o-n said", "the thing an IDIOT!!! and a *moron* said"):
        assert of(text) >= plain - 1e-9, text


def test_counts_are_of_all_texts(spark):
    docs = spark.createDataFrame([("ab",), ("AB c",), (None,), ("",)], "text string")
    c = T.character_counts(docs)
    assert c[0, 0, 1] == 2 and c[0, 1, 2] == 2 and c[2, 0, 3] == 1
    assert T.character_counts(docs.limit(0)).sum() == 0


def test_decoding_against_all_readings():
    from itertools import product

    rng = np.random.default_rng(0)
    d = T.Decoder(rng.integers(0, 50, (T.SYMBOLS,) * 3))

    def cost(parts):
        a = b = 0
        q = 0.0
        for p in parts:
            q -= 1.0 if not p else 0.0
            for c in p:
                q += d.logp[a, b, T.symbol(c)]
                a, b = b, T.symbol(c)
        return q + d.logp[a, b, 0]

    for word in ("1d10t", "a--b11", "s4@ss", "x|y"):
        best = max(product(*d.lattice(word)), key=cost)
        assert d.decode(word)[0] == "".join(best)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "bad word", ""), (4, "x " * 50_000 + "1" * 50_000, ""), (4, "a b c d e f g h " * 50, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    decoder = T.Decoder(T.character_counts(docs))
    for some in (docs, docs.limit(0)):
        for marks in (labels, labels.limit(0)):
            got = T.score(some, decoder, T.train(some, marks, decoder)).collect()
            assert len(got) == some.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_long_tokens_are_decoded(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    decoder = T.Decoder(T.character_counts(docs))
    of = T.scorer(decoder, T.train(docs, labels, decoder))
    plain = of("the thing an idiot and a moron said")
    noise = "/".join(f"{a}.{b}" for a in "bcdfgh" for b in "klmnpq")
    for text in (f"an i{'d' * 40}iot and a mo{'r' * 50}on said", "i.d.i.o.t/m.o.r.o.n/" * 4, f"{noise}/i.d.i.o.t/{noise}/m-o-r-o-n/{noise}"):
        assert of(text) >= plain - 1e-9, text
    assert of(noise * 3) < 0.5


def test_plain_words_are_passed_over_rightly():
    decoder = T.Decoder(np.ones((T.SYMBOLS,) * 3, np.int64))
    lexicon = T.Lexicon({"idiot": 3.0, "moro~": 2.0, "abc": 1.5}, np.array([1.0, 1.0, -2.0]))
    of = T.scorer(decoder, lexicon)
    for text in ("idiot", "a moronic thing", "abc", "abcd", "IDIOT!", "idiooot", "plain words only", "mississippi", "(idiot), plain.", "éàü слово 中文"):
        tokens = set(text.split())
        want = [w for t in tokens for w in [max((lexicon.of_word(r) for r in T.readings(t, decoder)), default=0.0)] if w]
        assert of(text) == lexicon.probability(want)


def test_letters_of_other_alphabets():
    assert len({T.symbol(c) for c in "abcxyzéüабвяαβω"}) == 15 and T.symbol("Я") == T.symbol("я") and T.symbol("1") == T.symbol(" ") == 0
    assert all(0 < T.symbol(c) < T.SYMBOLS for c in "中かกሰ") and (T.symbols(np.array([ord(c) for c in "aя中1"], np.uint32)) == [T.symbol(c) for c in "aя中1"]).all()
