"""Operator 5, toxicity through a noisy channel.

1. A character trigram model counts all words of all documents (arrays of fixed size, added up over the cluster).
2. Words that look disguised (digits or signs between letters, runs of one letter, single letters set apart) become lattices of the letters that may
   stand for each character; Viterbi decoding under the model restores them.
3. Restored words and their beginnings are weighed by log odds of toxic against other labelled documents; a logistic layer on the two heaviest words
   of a document gives its score. Weights are learned from at most TRAIN_ROWS rows of either label (the smallest hashes of their ids).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, code_points, small_batches, table, text_bytes, trim
from .quality import held_out

SYMBOLS, TRAIN_ROWS, PARTS = 128, 2500, 64
#: Letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h"}
#: Signs that may stand between letters for nothing.
APART = set(".-_~'`·|/\\*,:;^=+")
ANY = "abcdefghijklmnopqrstuvwxyz"
ENDS = ".,;:!?\"'()[]{}%&*#$~<>|-_=+/\\…«»“”„’‘"
#: Those of them that stand for no letter.
SOFT_ENDS = ".,;:?\"'()[]{}<>…«»“”„’‘"
_RUN = re.compile(r"(.)\1\1", re.S)
_DOUBLES = re.compile(r"(\w)\1")
_INNER = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|[0-9@$!|][^\W\d_]|[^\W\d_][0-9@$!|]")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
BEGINNINGS = (4, 5, 6)


#: Classes of letters: a to z, the accented ones of western Europe, Greek and Cyrillic have one each; those of other alphabets share the rest.
_OTHER = 117
_LETTERS_FROM = 0x3040


def symbol_table() -> np.ndarray:
    """Class of each code point under 0x3040: 0 is no letter; cases are equal."""
    out = np.zeros(_LETTERS_FROM, np.uint8)
    for c in range(_LETTERS_FROM):
        if (x := chr(c)).isalpha():
            k = ord(x.lower()[:1])
            own = [(0x61, 0x7A, 1), (0xDF, 0xFE, 27), (0x430, 0x44F, 59), (0x3B1, 0x3C9, 91)]
            out[c] = next((first + k - a for a, b, first in own if a <= k <= b), _OTHER + k % (SYMBOLS - _OTHER))
    return out


SYMBOL = symbol_table()


def symbols(points: np.ndarray) -> np.ndarray:
    """Classes of code points; from kana on all count as letters."""
    return np.where(points < _LETTERS_FROM, SYMBOL[np.minimum(points, _LETTERS_FROM - 1)], _OTHER + points % (SYMBOLS - _OTHER))


def symbol(c: str) -> int:
    k = ord(c)
    return int(SYMBOL[k]) if k < _LETTERS_FROM else _OTHER + k % (SYMBOLS - _OTHER)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for x in batches:
        raw, off = text_bytes(x.column(0))
        for a, b in chunks(off):
            cp = code_points(raw[off[a] : off[b]].tobytes())
            s = symbols(cp).astype(np.int32)
            s = np.concatenate([[0, 0], s, [0]])
            code = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]
            total += np.bincount(code, minlength=SYMBOLS**3)
    step = SYMBOLS**3 // PARTS
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([total[k * step : (k + 1) * step].tobytes() for k in range(PARTS)], pa.binary())], ["part", "counts"])


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [key[0]], "counts": [sum(np.frombuffer(x, np.int64) for x in rows["counts"]).tobytes()]})


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of letter classes over all texts, [before last, last, next]."""
    small_batches(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(_count_batches, "part int, counts binary").groupBy("part").applyInPandas(_add, "part int, counts binary").collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    step = SYMBOLS**3 // PARTS
    for r in parts:
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(bytes(r.counts), np.int64)
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """Viterbi decoding of disguised words."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(np.float64)
        c[0, 0, 0] = 0  # what lies between words says nothing
        pair, one = c.sum(0), c.sum((0, 1))
        p3 = c / np.maximum(c.sum(2, keepdims=True), 1)
        p2 = pair / np.maximum(pair.sum(1, keepdims=True), 1)
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        self.logp = np.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1[None, None, :]).astype(np.float32)

    def lattice(self, word: str) -> list[list[str]]:
        """For each run of one character the strings that may stand for it."""
        out = []
        for m in re.finditer(r"(.)\1*", word, re.S):
            c, n = m[1], len(m[0])
            options: list[str] = []
            if symbol(c):
                options = [c] if n == 1 else [c, c + c]
            else:
                for x in STANDS_FOR.get(c, ""):
                    options += [x] if n == 1 else [x, x + x]
                if c == "*" and n == 1:
                    options += list(ANY)
                if c in APART or not options:
                    options.append("")
            out.append(options)
        return out

    def decode(self, word: str, best: int = 3) -> list[str]:
        """The likeliest readings of a word, at most `best` with different last two letters."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(word):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (p, s) in states.items():
                for o in options:
                    x, y, q = a, b, p
                    for c in o:
                        k = symbol(c)
                        q += self.logp[x, y, k]
                        x, y = y, k
                    if not o:
                        q -= 1.0
                    if (x, y) not in new or new[x, y][0] < q:
                        new[x, y] = (q, s + o)
            states = new
        ends = sorted(((p + self.logp[a, b, 0], s) for (a, b), (p, s) in states.items()), reverse=True)
        return [s for _, s in ends[:best]]


def disguised(word: str) -> bool:
    return bool(_INNER.search(word) or _RUN.search(word) or len(_DOUBLES.findall(word)) >= 3)


#: Runs of one character up to which a disguised token is decoded at once.
WHOLE = 40


def _pieces(shape: str) -> Iterator[str]:
    """Windows of 2 * WHOLE runs that can say something, at every WHOLE of them, with the signs between them."""
    said = [m.start() for m in re.finditer(r"(.)\1*", shape, re.S) if symbol(m[1]) or m[1] in STANDS_FOR or m[1] == "*"]
    for k in range(0, len(said), WHOLE):
        yield shape[said[k] : said[k + 2 * WHOLE] if k + 2 * WHOLE < len(said) else len(shape)]
        if k + 2 * WHOLE >= len(said):
            break


def _shapes(low: str) -> set[str]:
    return {s for s in (low.strip(SOFT_ENDS), low.strip(ENDS)) if len(s) >= 3 and disguised(s)}


def _fits(shape: str) -> bool:
    return len(shape) <= WHOLE or sum(1 for _ in re.finditer(r"(.)\1*", shape, re.S)) <= WHOLE


def readings(token: str, decoder: Decoder) -> list[str]:
    """What a token of a text may say, in lower case; part_readings has what one of over WHOLE runs says."""
    low = token.lower()
    plain = low.strip(ENDS)
    out = [plain] if plain else []
    for shape in _shapes(low):
        if _fits(shape):
            out += [s for s in decoder.decode(shape) if s]
    return out


def part_readings(token: str, decoder: Decoder) -> Iterator[str]:
    """All parts of four letters or more of what the windows of a disguised token of over WHOLE runs say."""
    for shape in _shapes(token.lower()) if len(token) > WHOLE else ():
        for piece in () if _fits(shape) else _pieces(shape):
            for s in decoder.decode(piece)[:2]:
                yield from {s[i:j] for i in range(len(s)) for j in range(i + 4, min(len(s), i + 20) + 1)}


def spaced_readings(text: str, decoder: Decoder) -> list[str]:
    """Readings of letters set apart by spaces, with all their parts of four letters or more."""
    out: list[str] = []
    for m in _SPACED.finditer(text):
        letters = "".join(m[0].split()).lower()
        for k in range(0, len(letters), 20):
            part = letters[k : k + 40]
            for s in decoder.decode(part)[:2] if len(part) >= 3 else []:
                out += [s[i:j] for i in range(len(s)) for j in range(i + 4, min(len(s), i + 20) + 1)]
    return out


def _word_batches(decoder: Decoder):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            said = []
            for t in x.column(1).to_pylist():
                words = {r for w in set((t or "").split()) for r in readings(w, decoder)} | set(spaced_readings(t or "", decoder))
                said.append("\n".join(sorted(words)))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(said, pa.string())], ["label", "words"])

    return rows


def _keys(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon has them."""
    return [word] + [word[:k] + "~" for k in BEGINNINGS if len(word) > k]


class Lexicon:
    def __init__(self, weight: dict[str, float], layer: np.ndarray):
        self.weight, self.layer = weight, layer

    def of_word(self, word: str) -> float:
        return max((self.weight.get(k, 0.0) for k in _keys(word)), default=0.0)

    def probability(self, weights: list[float]) -> float:
        top = sorted(weights, reverse=True)[:2] + [0.0, 0.0]
        z = self.layer @ np.array([top[0], top[1], 1.0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _weigh(rows: list[tuple[int, list[str]]]) -> dict[str, float]:
    bad, other, n_bad, n_other = Counter(), Counter(), 0, 0
    for label, words in rows:
        keys = {k for w in words for k in _keys(w)}
        if label:
            bad.update(keys)
            n_bad += 1
    for label, words in rows:
        if not label:
            other.update({k for w in words for k in _keys(w)} & bad.keys())
            n_other += 1
    least = max(3, 0.004 * n_bad)
    out = {}
    for k, n in bad.items():
        if n >= least:
            w = np.log((n + 0.5) / (n_bad + 1)) - np.log((other[k] + 0.5) / (n_other + 1))
            # few sightings are trusted less
            w -= 1.5 / np.sqrt(n)
            if w > 1:
                out[k] = float(w)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, balance: float) -> np.ndarray:
    """Newton's method with a small ridge; balance: weight of the rows labelled 1."""
    w = np.zeros(3)
    each = np.where(y == 1, balance, 1.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + 0.05 * w
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
        w[:2] = np.maximum(w[:2], 0.02)  # a toxic word never speaks for a text
    return w


def fit(rows: list[tuple[int, list[str]]], share: float = 0.5) -> Lexicon:
    """rows: (label, distinct readings); share: of the rows labelled 1 among all labelled rows."""
    rows = [(a, b) for a, b in rows]
    weight = _weigh(rows)
    x, y = [], []
    for half in (0, 1):  # weights of one half judge the other
        part = Lexicon(_weigh([r for i, r in enumerate(rows) if i % 2 == half]), np.zeros(3))
        for i, (label, words) in enumerate(rows):
            if i % 2 != half:
                top = sorted(map(part.of_word, words), reverse=True)[:2] + [0.0, 0.0]
                x.append([top[0], top[1], 1.0])
                y.append(label)
    if not weight or len(set(y)) < 2:
        return Lexicon(weight, np.array([1.0, 0.0, -4.0]))
    mean = float(np.mean(y))
    layer = _logistic(np.array(x), np.array(y), share / (1 - share) * (1 - mean) / mean if 0 < share < 1 else 1.0)
    return Lexicon(weight, layer)


def train(docs: DataFrame, labels: DataFrame, decoder: Decoder, label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    ids = known.where("label = 1").orderBy(*order).limit(rows).unionByName(known.where("label = 0").orderBy(*order).limit(rows))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text").mapInArrow(_word_batches(decoder), "label int, words string").distinct().collect()
    said = sorted((r.words, r.label) for r in found)
    share = n.get(1, 0) / max(1, sum(n.values()))
    del found
    trim()
    return fit([(label, words.split("\n") if words else []) for words, label in said], share)


def scorer(decoder: Decoder, lexicon: Lexicon, remembered: int = 400_000) -> Callable[[str | None], float]:
    known: dict[str, list[float]] = {}
    heads = {k.removesuffix("~")[:4] for k in lexicon.weight}
    nothing: list[float] = []

    def weights_of(token: str) -> list[float]:
        """The weight of a token, or of the two heaviest words of a long one, neither of which is in the other."""
        low = token.lower().strip(SOFT_ENDS)
        if low.isalpha():  # letters only: it says nothing else unless letters are repeated, and weighs nothing unless the lexicon has its beginning
            if low[:4] not in heads and not _RUN.search(low) and len(_DOUBLES.findall(low)) < 3:
                return nothing
        got = known.get(token)
        if got is None:
            got = [max(map(lexicon.of_word, readings(token, decoder)), default=0.0)]
            parts = {s: w for s in part_readings(token, decoder) if (w := lexicon.of_word(s))}
            if parts:
                first = min(parts, key=lambda s: (-parts[s], len(s), s))
                second = max((w for s, w in parts.items() if s not in first and first not in s), default=0.0)
                got = sorted([*got, parts[first]])[1:] + [second]
            got = [w for w in got if w]
            if len(known) > remembered:
                known.clear()
            known[token] = got
        return got

    def score(text: str | None) -> float:
        text = text or ""
        weights = [w for token in set(text.split()) for w in weights_of(token)]
        weights += [w for w in (lexicon.of_word(s) for s in set(spaced_readings(text, decoder))) if w]
        return lexicon.probability(weights)

    return score


def score(docs: DataFrame, decoder: Decoder, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: (id, held_out, score, predicted). Null and empty texts score as texts without toxic words; other columns are not looked at."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(decoder, lexicon)
        for x in it:
            s = np.array([of(t) for t in x.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_col)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    decoder = Decoder(character_counts(docs))
    return score(docs, decoder, train(docs, table(spark, sf_dir, "labels"), decoder))
