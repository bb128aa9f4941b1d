"""Vector search by cosine: exact, as expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty or zero ones, and null ones."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    n = norm(a) * norm(b)
    return F.coalesce(F.when(ok & (n > 0), dot(a, b) / n), F.lit(0.0))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the state vectors where mask is 1; zeros if nowhere."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.when(m == 1, s)), lambda s: s.isNotNull())
    width = F.coalesce(F.size(F.get(states, 0)), F.lit(0))
    zeros = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda acc, s: F.zip_with(acc, s, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept))).otherwise(zeros)


class VectorIndex:
    """(id, embedding, ...) rows. Queries are literals or few rows, so a search is one pass with a top-k."""

    def __init__(self, df: DataFrame, id_col: str = "id", vector_col: str = "embedding"):
        self.df, self.id_col, self.vector_col = df, id_col, vector_col

    def add(self, more: DataFrame) -> VectorIndex:
        return VectorIndex(self.df.unionByName(more, allowMissingColumns=True), self.id_col, self.vector_col)

    def clear(self) -> VectorIndex:
        return VectorIndex(self.df.limit(0), self.id_col, self.vector_col)

    def count(self) -> int:
        return self.df.count()

    def search(self, vector: list[float], k: int = 20) -> DataFrame:
        """The k nearest rows with their score, best first, ids breaking ties."""
        query = F.array(*[F.lit(float(x)) for x in vector]) if vector else F.array().cast("array<double>")
        return self.df.withColumn("score", cosine(F.col(self.vector_col), query)).orderBy(F.desc("score"), self.id_col).limit(k)
