"""Operator 8, language identification of mixed texts.

Words are the runs between white space. The script of a word's letters leaves the languages whose training text uses that script. Each distinct word is scored
under the others by its character n-grams (1 to 4, with a blank before and after it, hashed, log probabilities with add-half smoothing), and a Viterbi pass over
the words of a document, with a penalty for each switch, labels spans of one language. The document's language is the one whose spans hold most letters.

The pass runs in segments of SEGMENT words at once: one sweep finds the best value of every way through each segment, a scan over the segments joins them, and a
second sweep keeps the choices. So a document of millions of words takes as many array steps as one of some hundreds, plus one for each segment.

Counts are learned from at most TRAIN_ROWS documents (those whose ids have the smallest hashes), added up by language over the cluster.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordBlock, mix64, small_batches, table, trim, word_blocks
from .quality import held_out

BUCKETS, GRAMS, TRAIN_ROWS, SWITCH, SEGMENT = 1 << 16, 4, 4000, 8.0, 64
_LETTERS_BELOW = 0x32400


@lru_cache(maxsize=1)
def scripts() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Script of each code point (0: no letter), its lower case, and the names of the scripts, which are the first words of the names of their letters."""
    names, script, lower = [""], np.zeros(_LETTERS_BELOW, np.int16), np.arange(_LETTERS_BELOW, dtype=np.uint32)
    at = {"": 0}
    for c in range(_LETTERS_BELOW):
        x = chr(c)
        if not x.isalpha():
            continue
        words = unicodedata.name(x, "OTHER").split(" ", 2)
        # forms of other letters are named after them
        name = words[1] if words[0] in ("FULLWIDTH", "HALFWIDTH", "MODIFIER", "MATHEMATICAL") and len(words) > 1 else words[0].split("-")[0]
        name = "LATIN" if name in ("FEMININE", "MASCULINE", "MICRO") else name
        if name not in at:
            at[name] = len(names)
            names.append(name)
        script[c] = at[name]
        low = x.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return script, lower, names


def script_of(points: np.ndarray) -> np.ndarray:
    return np.where(points < _LETTERS_BELOW, scripts()[0][np.minimum(points, _LETTERS_BELOW - 1)], 0)


def lowered(points: np.ndarray) -> np.ndarray:
    return np.where(points < _LETTERS_BELOW, scripts()[1][np.minimum(points, _LETTERS_BELOW - 1)], points)


class Distinct:
    """Distinct words of a block: how often each occurs, its letters, the script of most of them, and the n-gram buckets of all."""

    def __init__(self, block: WordBlock):
        flat, self.at, self.size, self.which = block.distinct()
        script = script_of(flat)
        n = len(self.size)
        self.word = np.repeat(np.arange(n), self.size + 2)
        self.stop = (self.at + self.size + 2)[self.word] if n else np.zeros(0, np.int64)
        self.low, self.letter = lowered(flat).astype(np.uint64), script > 0
        self.letters = np.bincount(self.word[self.letter], minlength=n)
        kinds = len(scripts()[2])
        pair, self.pair_n = np.unique(self.word[self.letter] * np.int64(kinds) + script[self.letter], return_counts=True)
        self.pair_word, self.pair_script = pair // kinds, pair % kinds
        self.script = np.zeros(n, np.int64)
        order = np.argsort(self.pair_n, kind="stable")  # the most common script of a word is written last
        self.script[self.pair_word[order]] = self.pair_script[order]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each n from 1: (n - 1, word and bucket of each n-gram that lies in a word and its two blanks and holds a letter)."""
        h, inner = np.zeros(len(self.low), np.uint64), np.zeros(len(self.low), bool)
        for n in range(1, min(GRAMS, len(self.low)) + 1):
            m = len(self.low) - n + 1
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + self.low[n - 1 :] + np.uint64(n)
            inner = inner[:m] | self.letter[n - 1 :]
            at = np.flatnonzero(inner & (np.arange(m) + n <= self.stop[:m]))
            yield n - 1, self.word[at], (mix64(h[at]) >> np.uint64(48)).astype(np.int64)


def best_path(words: np.ndarray, count: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word; words[i, j]: score of word i in language j; count: words of each text, one text after the other."""
    n, k = words.shape
    if not n:
        return np.zeros(0, np.int64)
    count = count[count > 0]
    parts = -(-count // SEGMENT)
    text_of = np.repeat(np.arange(len(count)), parts)  # of each segment
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(np.cumsum(count) - count, parts) + nth * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(count, parts) - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")  # those still going are always the first
    at, length = first[order], size[order]
    going = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    # 1. through[s, i, j]: the best way through segment s that is at i before its first word and ends at j
    through = np.full((len(at), k, k), -np.inf)
    through[:, np.arange(k), np.arange(k)] = 0.0
    for t, m in enumerate(going.tolist()):
        old = through[:m]
        through[:m] = np.maximum(old, old.max(2, keepdims=True) - penalty) + words[at[:m] + t][:, None, :]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    through = through[back]
    # 2. values before each segment, all texts a segment a step
    begin = np.cumsum(parts) - parts
    by_size = np.argsort(-parts, kind="stable")
    begin, many = begin[by_size], parts[by_size]
    live = np.searchsorted(-many, -np.arange(int(many[0])), "left")
    entry = np.zeros((len(text_of), k))
    value = np.zeros((len(count), k))
    for t, m in enumerate(live.tolist()):
        entry[begin[:m] + t] = value[:m]
        value[:m] = (value[:m, :, None] + through[begin[:m] + t]).max(1)
    # 3. the choices inside each segment, then its way back from each last language
    choice = np.zeros((n, k), np.int8 if k < 128 else np.int16)
    now = entry[order]
    for t, m in enumerate(going.tolist()):
        old = now[:m]
        top = old.argmax(1)
        jump = old[np.arange(m), top][:, None] - penalty
        stay = old >= jump
        choice[at[:m] + t] = np.where(stay, np.arange(k), top[:, None])
        now[:m] = np.where(stay, old, jump) + words[at[:m] + t]
    reach = np.tile(np.arange(k), (len(at), 1))  # the language before a segment for each at its end
    for t in range(len(going) - 1, -1, -1):
        m = going[t]
        reach[:m] = np.take_along_axis(choice[at[:m] + t].astype(np.int64), reach[:m], 1)
    reach = reach[back]
    # 4. the language at the end of each segment, from the last one back
    end = np.zeros(len(text_of), np.int64)
    state = value.argmax(1)
    state = state.copy()
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        end[begin[:m] + t] = state[:m]
        state[:m] = reach[begin[:m] + t, state[:m]]
    path = np.zeros(n, np.int64)
    lang = end[order]
    for t in range(len(going) - 1, -1, -1):
        m = going[t]
        path[at[:m] + t] = lang[:m]
        lang[:m] = choice[at[:m] + t, lang[:m]]
    return path


class Model:
    def __init__(self, languages: list[str], logp: np.ndarray, uses: np.ndarray):
        self.languages, self.logp, self.uses = languages, logp, uses

    def word_scores(self, d: Distinct) -> np.ndarray:
        """Score of each distinct word in each language."""
        n, k = len(d.size), len(self.languages)
        total, grams = np.zeros((n, k)), np.zeros(n)
        for g, word, bucket in d.grams():
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                total[word[first]] += np.add.reduceat(self.logp[g][bucket], first, axis=0)
                grams += np.bincount(word, minlength=n)
        # a language stays if it uses the script of most of the word's letters, or if none does
        fits = self.uses[:, d.script].T
        fits = fits | ~fits.any(1, keepdims=True)
        # a word counts by its letters, so long words and their overlapping n-grams do not drown the rest
        words = np.where(grams[:, None] > 0, total / np.maximum(grams, 1)[:, None] * np.sqrt(np.minimum(d.size, 40))[:, None], 0.0)
        words = np.where(fits | (d.letters == 0)[:, None], words, words.min(1, keepdims=True) - 30.0)
        words[d.letters == 0] = 0.0
        return words.astype(np.float32)

    def label(self, column: pa.Array, with_spans: bool = False) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
        """Language and score of each text of a column, and its spans (first and last code point, language) if asked for."""
        k, n_texts = len(self.languages), len(column)
        spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n_texts)]
        best, score = ["und"] * n_texts, np.zeros(n_texts)
        if not k:
            return best, score, spans
        parts: list[tuple[np.ndarray, ...]] = []
        base = 0

        def close() -> None:
            nonlocal parts
            if parts:
                self._close(*(np.concatenate([p[i] for p in parts]) for i in range(5)), best, score, spans, with_spans)
            parts = []

        for block in word_blocks(column):
            base = base if block.follows else 0
            if not block.follows:
                close()
            if len(block.key):
                d = Distinct(block)
                offset = block.first[np.searchsorted(block.first, block.start, "right") - 1] - base
                parts.append((block.row, self.word_scores(d)[d.which], d.letters[d.which], block.start - offset, block.stop - offset))
            base += len(block.points) - 1
        close()
        return best, score, spans

    def _close(self, row: np.ndarray, words: np.ndarray, letters: np.ndarray, start: np.ndarray, stop: np.ndarray, best: list[str], score: np.ndarray, spans: list, with_spans: bool) -> None:
        """Labels the texts whose words these are."""
        k = len(self.languages)
        low = int(row[0])
        text, n = row - low, int(row[-1]) - low + 1
        path = best_path(words, np.bincount(text, minlength=n))
        held = np.bincount(text * k + path, letters, n * k).reshape(n, k)
        every, top = held.sum(1), held.argmax(1)
        gain = np.stack([np.bincount(text, words[:, j], n) for j in range(k)], 1)
        gap = gain[np.arange(n), top][:, None] - gain
        sure = 1 / np.exp(-np.clip(gap, -50, 50)).sum(1)
        for i in np.flatnonzero(every > 0).tolist():
            best[low + i] = self.languages[top[i]]
            score[low + i] = min(1.0, float(held[i, top[i]] / every[i] * sure[i]))
        if with_spans:
            first = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])]))
            last = np.append(first, len(path))[1:] - 1
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                if every[text[a]] > 0:
                    spans[int(row[a])].append((int(start[a]), int(stop[b]), self.languages[path[a]]))


#: Parts of the counts of one language, so that they are added up in several tasks.
PARTS = 16


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of n-gram buckets and of letters of scripts of each language, in parts."""
    counts: dict[str, np.ndarray] = {}
    kinds = len(scripts()[2])
    size = -(-(GRAMS * BUCKETS + kinds) // PARTS) * PARTS
    for x in batches:
        langs = np.array(x.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            c = counts.setdefault(lang, np.zeros(size, np.int64))
            for block in word_blocks(x.column(1).filter(pa.array(langs == lang))):
                d = Distinct(block)
                times = np.bincount(d.which, minlength=len(d.size))
                for n, word, bucket in d.grams():
                    c[n * BUCKETS : (n + 1) * BUCKETS] += np.bincount(bucket, times[word], BUCKETS).astype(np.int64)
                np.add.at(c, GRAMS * BUCKETS + d.pair_script, d.pair_n * times[d.pair_word])
    if counts:
        cuts = [(lang, k, v[k * (size // PARTS) : (k + 1) * (size // PARTS)].tobytes()) for lang, v in counts.items() for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts]), pa.array([c[1] for c in cuts], pa.int32()), pa.array([c[2] for c in cuts], pa.binary())], ["lang", "part", "counts"])


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [key[0]], "part": [key[1]], "counts": [sum(np.frombuffer(x, np.int64) for x in rows["counts"]).tobytes()]})


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from text and lang of rows that are not held out; null languages and texts and empty language names teach nothing."""
    small_batches(docs.sparkSession)
    chosen = docs.where("lang is not null and lang <> '' and lang <> 'und' and text is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "lang", "text")
    # the bounded sample: the ids are found first, without their texts
    ids = chosen.select("doc_id", F.xxhash64("doc_id").alias("k")).orderBy("k", "doc_id").limit(rows).select("doc_id").distinct()
    counted = chosen.join(F.broadcast(ids), "doc_id").select("lang", "text").mapInArrow(_count_batches, "lang string, part int, counts binary")
    kinds = len(scripts()[2])
    sums: dict[str, list] = {}
    for r in counted.groupBy("lang", "part").applyInPandas(_add, "lang string, part int, counts binary").collect():  # one array of fixed size a language
        sums.setdefault(r.lang, [None] * PARTS)[r.part] = np.frombuffer(bytes(r.counts), np.int64)
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((GRAMS, BUCKETS, 0)), np.zeros((0, kinds), bool))
    c = np.stack([np.concatenate(sums[x])[: GRAMS * BUCKETS + kinds] for x in languages], 1).astype(np.float64)
    grams = c[: GRAMS * BUCKETS].reshape(GRAMS, BUCKETS, -1) + 0.5
    letters = c[GRAMS * BUCKETS :].copy()
    letters[0] = 0
    uses = (letters >= 0.02 * np.maximum(letters.sum(0), 1)).T
    uses[:, 0] = True
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), uses)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """One row per row of docs: (id, held_out, lang_pred, score), and the spans if with_spans. Null texts and texts without a letter give `und`, 0.

    Without any language to learn from, all give `und`. Spans are (start, stop, lang) in code points. Other columns are not looked at.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            langs, scores, span = model.label(x.column(2), with_spans)
            spans = [[{"start": s, "stop": e, "lang": g} for s, e, g in p] for p in span]
            columns = [x.column(0), x.column(1), pa.array(langs, pa.string()), pa.array(scores)]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    kind = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<start: long, stop: long, lang: string>>" if with_spans else "")
    return rows.mapInArrow(batches, kind).withColumnRenamed("doc_id", id_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
