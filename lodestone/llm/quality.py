"""Operator 9, quality classifier: supervised subword embeddings.

A document's vector is the mean of learned vectors of its words, the 3- to 5-character n-grams of each word (with a mark before and after it), its pairs of
neighbouring words, and whether such two are equal, all hashed into BUCKETS rows. A softmax layer gives the probability of each label. Vectors and layer are
trained together by stochastic gradient descent in numpy, on at most TRAIN_ROWS labelled rows (the smallest hashes of their ids), whose features, bounded
by BUCKETS for each row, the executors count. For scoring, the layer is folded into the vectors, one number a bucket.

N-grams are hashed once for each distinct word of a block of texts, so the cost of a block is about that of finding its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordBlock, mix64, small_batches, table, trim, word_blocks

BUCKETS, DIM, EPOCHS, RATE, TRAIN_ROWS = 1 << 16, 8, 6, 0.5, 2500
GRAMS = (3, 4, 5)
#: How often each pair of neighbours counts as equal or not.
SAME_WEIGHT = 4
_MULT = mix64(np.arange(3000, 3016, dtype=np.uint64)) | np.uint64(1)
_SAME, _OTHER = 0, 1


def _bucket(h: np.ndarray) -> np.ndarray:
    """The row of each hash; the first two rows are those of equal and other neighbours."""
    return (mix64(h) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


class Features:
    """Buckets of a block: of each distinct word (flat, with how many each word has), of each pair of neighbours, and which of these are equal."""

    def __init__(self, block: WordBlock, before: np.ndarray):
        """before: the key of the word before a block that follows another of its row."""
        flat, at, size, self.which = block.distinct()
        code = flat.astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(size)), size + 2)
        stop = (at + size + 2)[word] if len(size) else np.zeros(0, np.int64)
        one = np.zeros(len(size), np.uint64)
        one[self.which] = block.key
        buckets, of = [_bucket(one ^ _MULT[9])], [np.arange(len(size))]
        for k in GRAMS:
            if len(code) >= k:
                places = np.flatnonzero(np.arange(len(code)) + k <= stop)
                h = np.full(len(places), k, np.uint64)
                for j in range(k):
                    h = h * _MULT[j] + code[places + j]
                buckets.append(_bucket(h))
                of.append(word[places])
        bucket, of_word = np.concatenate(buckets), np.concatenate(of)
        order = np.argsort(of_word, kind="stable")
        self.bucket, self.per_word = bucket[order], np.bincount(of_word, minlength=len(size))
        key, row = block.key, block.row
        if len(before) and len(key):
            key, row = np.concatenate([before, key]), np.concatenate([row[:1], row])
        near = np.flatnonzero(row[1:] == row[:-1]) if len(key) else np.zeros(0, np.int64)
        self.pair_row, self.equal = row[near], key[near] == key[near + 1] if len(key) else np.zeros(0, bool)
        self.pair = _bucket(key[near] * _MULT[10] + key[near + 1] * _MULT[11])


def blocks_of(column: pa.Array) -> Iterator[tuple[WordBlock, Features]]:
    before = np.zeros(0, np.uint64)
    for block in word_blocks(column):
        before = before if block.follows else before[:0]
        yield block, Features(block, before)
        before = block.key[-1:] if len(block.key) else before


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.float64)
    for _, f in blocks_of(pa.array([text], pa.string())):
        times = np.bincount(f.which, minlength=len(f.per_word))
        total += np.bincount(f.bucket, np.repeat(times, f.per_word), BUCKETS) + np.bincount(f.pair, minlength=BUCKETS)
        total[_SAME] += SAME_WEIGHT * int(f.equal.sum())
        total[_OTHER] += SAME_WEIGHT * int((~f.equal).sum())
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = [document_features(t) for t in x.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary())], ["label", "f", "n"])


class Model:
    """folded: the score of each bucket; bias: what is added to the mean."""

    def __init__(self, folded: np.ndarray, bias: float):
        self.folded, self.bias = folded, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text of a column; a text without words gets the prior."""
        total, count = np.zeros(len(column)), np.zeros(len(column))
        folded = self.folded.astype(np.float64)
        n = len(column)
        for block, f in blocks_of(column):
            if not len(block.key):
                continue
            first = np.cumsum(f.per_word) - f.per_word
            each = np.add.reduceat(folded[f.bucket], first)
            total += np.bincount(block.row, each[f.which], n) + np.bincount(f.pair_row, folded[f.pair] + SAME_WEIGHT * np.where(f.equal, folded[_SAME], folded[_OTHER]), n)
            count += np.bincount(block.row, f.per_word[f.which], n) + (1 + SAME_WEIGHT) * np.bincount(f.pair_row, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))


def gradients(vectors: np.ndarray, share: np.ndarray, layer: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the softmax loss of one document by its vectors, the layer and its bias."""
    hidden = (vectors * share).sum(0)
    z = layer @ hidden + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return share * (layer.T @ p), np.outer(p, hidden), p


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: (label 0 or 1, buckets, counts)."""
    rng = np.random.default_rng(seed)
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            rate = RATE * (1 - done / steps)
            done += 1
            label, f, n = rows[k]
            if not len(f):
                continue
            of_vectors, of_layer, of_bias = gradients(vectors[f], (n / n.sum())[:, None], layer, bias, label)
            layer -= rate * of_layer
            bias -= rate * 0.1 * of_bias
            vectors[f] -= rate * len(f) ** 0.5 * of_vectors
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Rows that no label is learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """(label, text) of at most `rows` labelled training rows: those whose ids have the smallest hashes. Of documents with one id the text of the smallest hash counts,
    so the bound holds however often an id comes."""
    chosen = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)  # bounded, so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    small_batches(docs.sparkSession)
    found = sample(docs, labels, label_col, rows).mapInArrow(_feature_batches, "label int, f binary, n binary").toArrow()
    views = [(label, np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.float32)) for label, f, n in zip(found["label"].to_pylist(), found["f"], found["n"], strict=True)]
    views.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()[:64], r[2].tobytes()[:64]))  # the order of the tasks does not matter
    model = fit(views)
    del views, found
    trim()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: (id, held_out, score, predicted). Null and wordless texts get the prior; other columns are not looked at."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            s = model.scores(x.column(2))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_col)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, with the columns that they have.

    Null, empty and wordless texts get the prior and stay or go by it; rows that come again stay or go together; an empty table stays empty; other columns, whatever
    their names, pass through.
    """
    of_labels = table(spark, sf_dir, "labels")
    model = train(docs, of_labels)
    columns, schema = docs.columns, docs.schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for x in it:
            yield x.filter(pa.array(model.scores(x.column(at)) >= 0.5))
        trim()

    return docs.mapInArrow(batches, schema)
