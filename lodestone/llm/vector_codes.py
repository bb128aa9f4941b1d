"""Operator 12, vector code compression: each vector as the indexes of its parts' nearest entries in small integer codebooks.

1. Components become integers, floor(scale * x). Vectors are cut into equal consecutive parts; each part's codebook starts as that part of the first vectors by id.
2. A round broadcasts the codebooks (parts x entries x width integers, whatever the number of vectors). Tasks take the squared distances of an Arrow batch to all
   entries by norm expansion, |x|^2 - 2xc + |c|^2, with integer matrix products, and the first smallest one. They hand on one sum per entry and limb, which a
   grouped shuffle adds up: at most parts x entries x limbs rows come to the driver, which divides them.
3. The last assignment gives codes and errors; label totals meet their vectors by a null-safe join.

All of it is exact: sums travel as limbs of 40 bits, and components too large for 64-bit products are compared as Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a limb: sums of 2^23 tasks' limbs stay in 64 bits.
LIMB = 40
#: Rows whose distances are held at once.
BLOCK = 1024


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where one is beyond 2^52; scale is a power of two, so the product is exact."""
    if not x.size or np.abs(x).max() < float(1 << 52) / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 1 << 52 else math.floor(v * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def small_limit(width: int) -> int:
    """Integers up to this size give distances of vectors of that width that 64 bits hold."""
    return math.isqrt((1 << 60) // max(width, 1))


def nearest(x: np.ndarray, book: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest row of book for each row of x, and the squared distance; exact for integers of any size."""
    large_x, large_c = (np.abs(x) > limit).any(1).astype(bool), (np.abs(book) > limit).any(1).astype(bool)
    best, error = np.zeros(len(x), np.int64), np.zeros(len(x), object if large_x.any() or large_c.all() else np.int64)
    for rows, cols, kind in ((~large_x, ~large_c, np.int64), (~large_x, large_c, object), (large_x, np.ones(len(book), bool), object)):
        at, names = np.flatnonzero(rows), np.flatnonzero(cols)
        if not len(at) or not len(names):
            continue
        a, c = x[at].astype(kind), book[names].astype(kind)
        distance = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
        first = distance.argmin(1)
        low = distance[np.arange(len(at)), first]
        if kind is object and rows is not large_x and not large_c.all():  # the small entries have been there: a nearer one, or an equal one before it, wins
            took = np.array([(d, int(k)) < (int(e), int(b)) for d, k, e, b in zip(low, names[first], error[at], best[at], strict=True)], bool)
            at, first, low = at[took], first[took], low[took]
        best[at], error[at] = names[first], low
    return best, error


def limbs_of(sums: np.ndarray) -> list[np.ndarray]:
    """Integers as limbs of LIMB bits, lowest first; the last one has the sign."""
    out, rest = [], sums
    while True:
        low, rest = rest & ((1 << LIMB) - 1), rest >> LIMB
        out.append(low.astype(np.int64))
        if not np.any(rest):
            return out
        if np.all((rest == 0) | (rest == -1)):
            return [*out, rest.astype(np.int64)]


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for x in batches:
        for a in range(0, x.num_rows, BLOCK):
            part = x.slice(a, BLOCK)
            values = np.asarray(part.column(part.num_columns - 1).flatten(), np.float64).reshape(part.num_rows, width)
            yield part, integers(values, scale)


class Codebooks:
    """books: for each part a matrix of entries; scale: of the integers."""

    def __init__(self, books: list[np.ndarray], scale: int = SCALE):
        self.books, self.scale = books, scale
        self.part = books[0].shape[1] if books else 0
        self.width = self.part * len(books)

    def sha256(self) -> str:
        """Of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(c)) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error) of rows of integers."""
        codes, error, limit = np.zeros((len(x), len(self.books)), np.uint8), 0, small_limit(self.width)
        for p, book in enumerate(self.books):
            codes[:, p], low = nearest(x[:, p * self.part : (p + 1) * self.part], book, limit)
            error = error + low
        return codes, error


def sound_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, and the length of their vectors, 0 if there are none."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    return rows.where(F.size("v") == width), width


def _sum_rows(shared, part: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        n = np.zeros((len(books.books), len(books.books[0])), np.int64)
        sums = [np.zeros(b.shape, np.int64) for b in books.books]
        for _, x in _blocks(batches, books.scale, books.width):
            codes, _error = books.assign(x)
            if x.dtype == object:
                sums = [s.astype(object) for s in sums]
            for p, s in enumerate(sums):
                np.add.at(s, codes[:, p], x[:, p * part : (p + 1) * part])
                n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
        for p, s in enumerate(sums):
            used = np.flatnonzero(n[p])
            for k, limb in enumerate(limbs_of(s[used])):
                if len(used):
                    count = n[p][used] if k == 0 else np.zeros(len(used), np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * part), pa.array(limb.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(np.full(len(used), k, np.int32)), pa.array(count), lists], ["part", "entry", "limb", "n", "s"])

    return rows


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after some rounds; None if no vector takes part. With fewer vectors than entries each is an entry."""
    if not 0 < entries <= 256 or scale < 1 or scale & (scale - 1):
        raise ValueError("entries must be 1 to 256, scale a power of two")
    small_batches(vectors.sparkSession)
    rows, width = sound_rows(vectors, id_col, vector_col, None, parts)
    if not width:
        return None
    part = width // parts
    start = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()
    if not start:
        start = rows.orderBy("v").limit(entries).select("v").collect()
    first = integers(np.array([r["v"] for r in start], np.float64).reshape(len(start), width), scale)
    books = Codebooks([first[:, p * part : (p + 1) * part] for p in range(parts)], scale)
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        sums = rows.select("v").mapInArrow(_sum_rows(shared, part), "part int, entry int, limb int, n long, s array<long>")
        totals = sums.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(part)]).alias("s")).collect()
        shared.destroy()
        whole: dict[tuple[int, int], list] = {}
        for r in totals:
            got = whole.setdefault((r["part"], r["entry"]), [0, [0] * part])
            got[0] += r["n"]
            got[1] = [a + (b << (LIMB * r["limb"])) for a, b in zip(got[1], r["s"], strict=True)]
        fresh = [[[int(c) for c in e] for e in b.tolist()] for b in books.books]
        for (p, e), (n, s) in whole.items():
            fresh[p][e] = [c // n for c in s]
        large = max(abs(c) for b in fresh for e in b for c in e) > small_limit(width)
        books = Codebooks([np.array(b, object if large else np.int64).reshape(len(start), part) for b in fresh], scale)
    return books


def _code_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for part, x in _blocks(batches, books.scale, books.width):
            codes, error = books.assign(x)
            fits = [int(e) if int(e) < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(fits, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, label, code, error) of the rows whose vector has the length of the codebooks and only finite components; null error: beyond 64 bits."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, _ = sound_rows(vectors, id_col, vector_col, label_col, len(books.books))
    rows = rows.where(F.size("v") == books.width)
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_code_rows(spark.sparkContext.broadcast(books)), f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(id, vector array<double>): the entries that a code names, divided by the scale; a null code gives a null vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = [None if c is None else np.concatenate([books.books[p][k] for p, k in enumerate(bytes.fromhex(c))]).astype(np.float64) / books.scale for c in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select(F.col(id_col).cast("long").alias("vec_id"), F.col(code_col).cast("string")).mapInArrow(rows, "vec_id long, vector array<double>")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector that takes part: (vec_id, code, error, label_error, codebooks_sha256).

    Left out: vectors that are null or empty, hold null or non-finite components, cannot be cut into equal parts, or have another length than the first by id
    (null ids last). Repeated rows are coded each, and may be entries each; rows of one id are ordered by their vectors. A null id is coded, and starts no
    codebook while others do. Null labels share one total. error and label_error are null where 64 bits do not hold them. An empty table gives no rows.
    Other columns are not looked at.
    """
    spark = vectors.sparkSession
    books = train(vectors, id_col, vector_col, parts, entries, rounds, scale)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(encode(vectors, books, id_col, vector_col, label_col))
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("error").alias("n"), F.count("*").alias("all"))
    fits = F.when((F.col("n") == F.col("all")) & (F.col("sum") < F.lit(str(1 << 63)).cast("decimal(38,0)")), F.col("sum").cast("long"))
    return coded.join(total.select("of", fits.alias("label_error")), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    near = """
assign{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT a.vec_id, a.p, a.x, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2]))) AS d
    FROM cuts a JOIN book{k} b ON a.p = b.p) GROUP BY vec_id, p
)"""
    move = """
sums{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM assign{k}) GROUP BY p, e, i),
means{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{k} GROUP BY p, e),
book{next} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)"""
    rounds = ",".join((near + "," + move).format(k=k, next=k + 1) for k in range(ROUNDS))
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cuts AS MATERIALIZED (
  SELECT vec_id, p, v[CAST(p * (len(v) // {PARTS}) + 1 AS BIGINT) : CAST((p + 1) * (len(v) // {PARTS}) AS BIGINT)] AS x FROM whole, range({PARTS}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cuts WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT {ENTRIES})
), {rounds},{near.format(k=ROUNDS)},
rows AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM assign{ROUNDS} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS d FROM (SELECT p, e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS c FROM book{ROUNDS})
)
SELECT r.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM rows r JOIN whole w ON w.vec_id = r.vec_id, digest
"""


ORACLE = _oracle()
