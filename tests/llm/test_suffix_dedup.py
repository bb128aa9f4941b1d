import hashlib

import numpy as np
import pytest
from lodestone.llm.suffix_dedup import column_repeats, op10, remove_repeats

SMALL = "/root/testdata/sf0.01"


def brute(rows, n=400):
    places = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - n + 1):
            key = b[i : i + n]
            places[key] = places.get(key, 0) + 1
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if places[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 5
    assert got_of(op10(spark, "/root/testdata/sf0.001")) == want


@pytest.mark.parametrize("tile", [8192, 2])
def test_small_cases(spark, monkeypatch, tile):
    monkeypatch.setattr("lodestone.llm.suffix_dedup.TILE", tile)
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    p = word(900)
    rows = [(1, word(300) + p + word(200)), (2, word(10) + p[100:700] + word(10)), (3, None), (4, ""), (5, "x" * 1500), (6, word(3000))]
    rows += [(7, p[:399]), (8, word(500) + p[300:] + word(50) + p[:420]), (None, word(20) + p), (6, p[5:]), (9, "ab" * 300 + word(100)), (10, "q" + p[200:640])]
    rows += [(20 + k, word(60) + p[k * 11 : k * 11 + 480] + word(60)) for k in range(8)]
    rows += [(40 + k, word(30) + p[:600] + word(30)) for k in range(9)] + [(60, p), (61, p), (62, p), (63, p)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, n_bytes string")
    assert got_of(remove_repeats(df)) == brute(rows)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_find_repeats_in_their_group_only():
    a = b"0123456789abcdef"
    found = column_repeats(np.array([0, 0, 1]), [b"zz" + a, b"yyy" + a, b"zz" + a], np.array([6, 7, 6]), np.array([8, 9, 8]), 10)
    assert [np.flatnonzero(f).tolist() for f in found] == [[2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7, 8], []]


def test_texts_longer_than_a_window(spark):
    """Repeats across windows, inside one text and between texts, at places that no window begins at."""
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    p, q = b"<" + letters(5000) + b">", b"[" + letters(450) + b"]"
    long = letters(1_300_000) + b"1" + p + b"2" + letters(1_700_001) + b"3" + q + b"4" + letters(900_000) + b"5" + p + b"6"
    at = (1 << 20) - 200
    other = letters(at) + b"7" + q + b"8" + letters(100)
    rows = [(1, long), (2, other), (3, letters(2_500_000))]
    df = spark.createDataFrame([(d, b.decode()) for d, b in rows], "doc_id long, text string")
    kept = {1: long.replace(p, b"").replace(q, b""), 2: other.replace(q, b""), 3: rows[2][1]}
    spans = {1: 3, 2: 1, 3: 0}
    assert got_of(remove_repeats(df)) == sorted(((d, len(b), len(b) - len(kept[d]), spans[d], hashlib.sha256(kept[d]).hexdigest()) for d, b in rows), key=str)


def test_windows_and_sightings():
    from lodestone.llm.suffix_dedup import CHUNK_BYTES, LENGTH, Sightings, _windows

    off = np.array([0, 10, 10 + 3 * CHUNK_BYTES, 20 + 3 * CHUNK_BYTES])
    starts = [s for a, _, s, e in _windows(off) if a == 1 for s in range(s, e - LENGTH + 1)]
    assert starts == list(range(10, 10 + 3 * CHUNK_BYTES - LENGTH + 1))
    seen = Sightings(bits=4)
    h, g = np.array([1, 1, 2, 1], np.uint64), np.array([5, 5, 5, 6], np.uint64)
    assert seen.known(h, g).tolist() == [False] * 4 and seen.known(h, g)[:2].tolist() == [True, True]
    kinds = np.arange(1000, dtype=np.uint64)
    for _ in range(3):  # a small table forgets, and never tells a kind known that has not been met twice
        fresh = np.random.default_rng(0).integers(0, 2**60, 1000).astype(np.uint64) + kinds
        assert not Sightings(bits=4).known(fresh, kinds).any()
