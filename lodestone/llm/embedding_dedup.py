"""Operator 3, embedding near-duplicates by sorted projection passes.

1. Equal vectors of a label form one class.
2. In each pass every class gets 64 random sign hashes, concatenated; classes are ordered by (pass, label, hashes) over the cluster and each is compared, by
   cosine in double precision, with the WINDOW next ones. The verified pairs of all passes are united into components.
3. Passes come in rounds of PASSES, with new hashes each, until a round unites nothing that was apart. So the number of passes follows from the data: sparse
   labels end after the second round, dense ones, in which a window is narrow, go on as long as that finds links.
4. In each component all links are counted exactly, in tiles of bounded size, so windows decide only which vectors are found connected.

A pair that agrees in the b leading bits it takes to narrow its label to WINDOW vectors is compared: at cosine 0.98 the chance is 0.936^b a pass. If a pair is
apart after a round in which its chance to be found was q, the next one finds it with q again, so the round that ends the search tells that what is still
apart is rare against what q would find. README has the recall measured against all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import components, cut, spanning, table

PASSES, WINDOW, TILE = 12, 32, 2048
#: Linked vectors that one group of small components holds, about.
GROUP = 4000


def _matrix(column: pa.Array) -> np.ndarray:
    """A binary column of doubles as a matrix; all rows have one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _hash_rows(passes: int, turn: int = 0):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for x in batches:
            node, label, width = (x.column(i).to_numpy() for i in range(3))
            vectors = x.column(3)
            for w in np.unique(width).tolist():
                pick = np.flatnonzero(width == w)
                part = vectors.take(pa.array(pick))
                m = np.asarray(part.flatten(), np.float64).reshape(len(pick), w)
                m = m / np.abs(m).max(1, keepdims=True)  # no overflow in squares
                data = pa.array([r.tobytes() for r in m], pa.binary())
                if w not in planes:
                    planes[w] = np.random.default_rng((20240229, turn)).standard_normal((passes, w, 64))
                for k in range(passes):
                    bits = np.packbits(m @ planes[w][k] > 0, axis=1).view(">u8").astype(np.uint64)[:, 0]
                    key = (bits ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), k, np.int32)), pa.array(label[pick]), pa.array(width[pick]), pa.array(key), pa.array(node[pick]), data], ["pass", "label", "width", "key", "node", "v"])

    return rows


def _window_rows(window: int, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in batches:
            t = pa.Table.from_batches([x])
            t = (pa.concat_tables([tail, t]) if tail is not None else t).combine_chunks()
            tail = t.slice(max(0, t.num_rows - window))
            kind = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("pass", "label", "width")], 1)
            node = t.column("node").to_numpy()
            cuts = np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
                if e - s < 2:
                    continue
                m = _matrix(t.column("v").slice(s, e - s).combine_chunks())
                n = np.sqrt(np.einsum("ij,ij->i", m, m))
                for k in range(1, min(window, e - s - 1) + 1):
                    hit = np.flatnonzero(np.einsum("ij,ij->i", m[:-k], m[k:]) >= least * (n[:-k] * n[k:]) * (1 - 1e-12))
                    if len(hit):
                        i, j = hit + s, hit + s + k
                        sure = np.array([_cosine(m[p], m[p + k]) >= least for p in hit.tolist()])
                        a, b = np.concatenate([a, node[i[sure]]]), np.concatenate([b, node[j[sure]]])
            if len(a) > 200_000:
                a, b = spanning(a, b)
        a, b = spanning(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))))


def _count_links(least: float):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby(["c", "i", "j"], sort=False):
            m = np.frombuffer(b"".join(g["v"]), np.float64).reshape(len(g), -1)
            n = np.sqrt(np.einsum("ij,ij->i", m, m))
            copies, tile = g["n"].to_numpy().astype(np.float64), g["tile"].to_numpy()
            cos = (m @ m.T) / np.outer(n, n)
            link = cos >= least
            np.fill_diagonal(link, False)
            if g["i"].iloc[0] != g["j"].iloc[0]:
                link &= tile[:, None] != tile[None, :]
            out.append(pd.DataFrame({"node": g["node"].to_numpy(), "links": (link @ copies).astype(np.int64)}))
        return pd.concat(out)

    return count


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98, passes: int = PASSES, window: int = WINDOW, rounds: int | None = None) -> DataFrame:
    """One row per row of vectors: (id, n_links, component_id, kept).

    Vectors are compared when their labels are equal and not null and their lengths are equal. Null, empty and zero vectors and those with null
    or non-finite components have no links, their own id as component and kept true. Repeated rows are linked with each other. A null id
    gives kept false where its component has another id, else component_id and kept null. Other columns are not looked at. rounds: of passes, if it is to
    be fixed; else they go on until one unites nothing.
    """
    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    classes, seed = None, 0
    while classes is None or classes.where("other <> again").take(1):  # two classes of one name: all get other names
        seed += 1
        rows = rows.withColumn("node", F.when(usable, F.xxhash64(F.lit(seed), "label", "v")))
        check = F.xxhash64(F.lit(-seed), "v", "label")
        classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"), F.min(check).alias("other"), F.max(check).alias("again"))
        classes = cut(classes)
    order = ["pass", "label", "width", "key", "node"]
    pairs, linked, united, turn = None, None, -1, 0
    while True:
        hashed = classes.select("node", "label", F.size("v").cast("long").alias("width"), "v").mapInArrow(_hash_rows(passes, turn), "pass int, label long, width long, key long, node long, v binary")
        found = hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_window_rows(window, cosine), "a long, b long")
        pairs = found if pairs is None else found.unionByName(linked.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        linked = components(pairs)
        turn += 1
        now = linked.where("id <> component_id").count()
        if turn == rounds or now == united or not now:
            break
        united = now
    linked = linked.withColumnRenamed("id", "node").withColumnRenamed("component_id", "c")
    groups = max(16, -(-linked.count() // GROUP))
    size = linked.groupBy("c").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    member = linked.join(size, "c").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    member = member.select("node", "c", "tile", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j"))
    tiles = member.join(classes.select("node", "n", _doubles("v").alias("v")), "node")
    links = tiles.groupBy(F.pmod(F.xxhash64("c"), F.lit(groups)).alias("k"), "i", "j").applyInPandas(_count_links(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    lowest = linked.join(classes.select("node", "least"), "node").groupBy("c").agg(F.min("least").alias("component_id"))
    facts = classes.select("node", "n", "least").join(links, "node", "left").join(linked.join(lowest, "c").select("node", "component_id"), "node", "left")
    facts = facts.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "node").join(facts, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    kept = F.when(F.col("vec_id").isNull() & F.col("component_id").isNotNull(), F.lit(False)).otherwise(F.col("vec_id") == F.col("component_id"))
    return out.withColumn("kept", kept).withColumnRenamed("vec_id", id_col)


@F.pandas_udf(BinaryType())
def _doubles(v: pd.Series) -> pd.Series:
    return v.map(lambda x: (np.asarray(x, np.float64) / np.abs(x).max()).tobytes())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN lowest l ON l.a = v.vec_id LEFT JOIN counted c ON c.a = v.vec_id
"""
