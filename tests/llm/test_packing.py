"""Operator 11: packings against exhaustive search, ids against the library, and edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing as P

SCHEMA = "doc_id long, text string, piece string, length int, sequence_id string, ids string, part string"


def fewest(sizes, capacity):
    """The least number of bins, by search over multisets of rooms."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def check(patterns, counts, capacity):
    have = Counter()
    for contents, times in patterns:
        assert times > 0 and sum(k * c for k, c in contents.items()) <= capacity
        for k, c in contents.items():
            have[k] += c * times
    assert have == Counter({k: v for k, v in counts.items() if v})
    return sum(t for _, t in patterns)


def test_small_packings_are_the_best():
    r = random.Random(11)
    beaten = 0
    for _ in range(250):
        capacity = r.choice([10, 20, 50, 100])
        low = r.choice([1, capacity // 5, capacity // 4])
        sizes = [r.randint(max(1, low), max(1, capacity * 6 // 10)) for _ in range(r.randint(1, 11))]
        counts = Counter(sizes)
        n = check(P.pack(counts, capacity), counts, capacity)
        assert n == fewest(sizes, capacity) >= P.lower_bound(counts, capacity)
        beaten += n < check(P.best_fit(counts, capacity), counts, capacity)
    assert beaten  # best fit alone would not do


def test_bin_completion_beats_best_fit():
    counts = {5: 1000, 4: 2000, 3: 1000, 2: 2000}
    assert check(P.pack(counts, 10), counts, 10) == P.lower_bound(counts, 10)
    triples = Counter()  # full sequences cut in three
    r = random.Random(2)
    for _ in range(400):
        a, b = sorted(r.sample(range(200, 800), 2))
        triples.update([a, b - a, 1000 - b])
    assert check(P.pack(triples, 1000, 3000), triples, 1000) <= check(P.best_fit(triples, 1000), triples, 1000)


@pytest.mark.parametrize("counts", [{}, {1: 1}, {2048: 5}, {1: 10_000_000_000}, {1: 3, 2047: 10**12}, {k: 10**9 + k for k in range(1, 2049)}])
def test_counts_of_any_size(counts):
    n = check(P.pack(counts, 2048, 200), counts, 2048)
    bound = P.lower_bound(counts, 2048)
    assert bound <= n <= bound * 1.01 + 1


def crowded():
    """Lengths of which a few neighbours have a third of all pieces, as many copies of one document and its variants make."""
    r = random.Random(7)
    counts = Counter(min(2048, max(2, int(r.lognormvariate(5.8, 0.75)))) for _ in range(10_000))
    counts.update({330: 1700, 331: 250, 329: 220, 332: 190, 328: 190, 333: 150, 327: 110, 334: 100, 326: 90, 335: 80})
    return counts


def test_a_crowd_of_lengths_leaves_no_waste():
    counts = crowded()
    bound = P.lower_bound(counts, 2048)
    assert check(P.best_fit(counts, 2048), counts, 2048) > bound
    assert check(P.pack(counts, 2048, nodes=200), counts, 2048) == bound
    many = Counter({k: 1000 * v for k, v in counts.items()})
    patterns = P.pack(many, 2048, nodes=200)
    assert check(patterns, many, 2048) <= P.lower_bound(many, 2048) + 1 and len(patterns) < P.SHARES


def test_steps_bound_the_fillings_looked_at(monkeypatch):
    """Also where most fillings are dominated."""
    counts, looked = {k: v for k, v in crowded().items() if 300 <= k <= 360}, []
    plain = P._Search.dominated
    monkeypatch.setattr(P._Search, "dominated", lambda *a: (looked.append(1), plain(*a))[1] if len(looked) < 400 * P.TRIES else pytest.fail("too many fillings"))
    check(P.pack(counts, 2048, nodes=400), counts, 2048)
    assert looked


def test_dominated_by_what_is_left():
    """As told by trying each length left in place of nothing, of one length and of two."""
    r, told = random.Random(4), Counter()
    for _ in range(2000):
        counts = Counter(r.randint(1, 30) for _ in range(r.randint(1, 8)))
        pieces = r.sample(sorted(counts.elements()), r.randint(0, min(4, counts.total())))
        waste, left = r.randint(0, 6), counts - Counter(pieces)
        gone = [0, *(pieces if waste else []), *(a + b for i, a in enumerate(pieces) for b in pieces[i + 1 :])]
        want = any(g < y <= g + waste or (y == g > 0 and g not in pieces) for y in left for g in gone) or any(y == a + b for i, a in enumerate(pieces) for b in pieces[i + 1 :] for y in left)
        told[want] += 1
        assert P._Search(counts, 60).dominated(tuple(sorted(Counter(pieces).items(), reverse=True)), waste) == want
    assert min(told.values()) > 200


TEXTS = [
    "", " ", "\n\n  \t x", "Hello world's ISN'T", "  two  blanks ", "<|endoftext|> x<|endoftext|>", "日本語のテキスト 漢字", "emoji 👩‍👩‍👧 ok", "عربى نص", "é   ᠎   x", "\x00\x01 ctl", "ⱯⰯ Ⱟ 𞤀 ꟓ", "１２３ ½ ² x²",
    "a" * 3000, " " * 3000, "ab1 " * 900 + "  " * 50, "\n" * 2000 + "x", "—…–«»",
]


def test_ids_are_the_librarys(monkeypatch):
    plain = Tokenizer.from_file(P.default_tokenizer())
    plain.encode_special_tokens = True
    encoder = P.Encoder(P.default_tokenizer())
    assert encoder.quick is not None
    import pyarrow.parquet as pq

    texts = TEXTS + [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.ids(t).tolist() for t in texts] == want
    parts = P.segments
    monkeypatch.setattr(P, "segments", lambda text: parts(text, 40))
    assert [encoder.ids(t).tolist() for t in texts[:300]] == want[:300]
    assert all("".join(parts(t, 25)) == t for t in texts[:60])


def test_other_vocabularies_use_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = P.Encoder(path)
    assert encoder.quick is None
    assert encoder.ids("Some words here").tolist() == Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids


def verify(rows, docs, capacity, tokenizer):
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"], r["start"] if r["doc_id"] is None else 0].append(r)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        want.update((i, j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    assert got == want
    return len(sequences)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_pieces_and_places(spark, capacity):
    r = random.Random(capacity)
    docs = [(i, " ".join(r.choice(["alpha", "be", "gamma.", "δ", "漢字"]) for _ in range(int(r.expovariate(0.01))))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (None, "x y"), (None, "x y"), (None, None), (900, ""), (901, None), (902, "word " * 9000), *[(1000 + k, t) for k, t in enumerate(TEXTS)]]
    df = spark.createDataFrame([(i, t, "p", 1, "s", "x", "q") for i, t in docs], SCHEMA).repartition(6)
    plain = Tokenizer.from_file(P.default_tokenizer())
    plain.encode_special_tokens = True
    pieces = P.packed_pieces(df, capacity=capacity, ids=True)
    rows = pieces.collect()
    n = verify(rows, docs, capacity, plain)
    assert n >= P.lower_bound(Counter(r["length"] for r in rows), capacity)
    whole = P.sequences(pieces).collect()
    assert len(whole) == n and sum(len(s["ids"]) for s in whole) == sum(r["length"] for r in rows) and all(len(s["ids"]) <= capacity and s["starts"][0] == 0 for s in whole)


def test_empty_table(spark):
    out = P.packed_pieces(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
