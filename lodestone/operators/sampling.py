"""Samples of rows by position, by chance or at even steps. Without a key, rows stand in the order of the files that they are read from (see positions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import at_positions, ends, file_order, with_positions

STRATEGIES = ("head", "tail", "random", "smart")
#: Rows at even steps that are fetched by their places; more are filtered from a pass over all rows.
BY_PLACE = 1000


def strategy(name: str | None) -> str:
    """A strategy by name in any case; smart for what is unknown."""
    return name.lower() if name and name.lower() in STRATEGIES else "smart"


def head(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    if order_by or n <= 0:
        return df.orderBy(*order_by).limit(n) if order_by else df.limit(0)
    found = ends(df, n)
    return df.limit(n) if found is None else found


def tail(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The last n rows, in order: a top-k when there is a key, by position else."""
    if n <= 0:
        return df.limit(0)
    if order_by:
        return df.orderBy(*[F.col(c).desc_nulls_last() for c in order_by]).limit(n).orderBy(*order_by)
    found = ends(df, n, last=True)
    if found is not None:
        return found
    rows = with_positions(df)
    last = rows.agg(F.max("_pos")).first()[0]
    return rows.where(F.col("_pos") > (-1 if last is None else last - n)).orderBy("_pos").drop("_pos")


def random(df: DataFrame, n: int = 5, seed: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """n rows without replacement, in their own order."""
    if order_by:
        return df.withColumn("__r", F.rand(seed)).orderBy("__r", *order_by).limit(n).drop("__r").orderBy(*order_by)
    order = file_order(df)
    if order is not None:  # a top-k: no positions are needed to put n rows in order
        return order.rows.withColumn("__r", F.rand(seed)).orderBy("__r", *order.keys).limit(n).orderBy(*order.keys).select(*df.columns)
    return with_positions(df).withColumn("__r", F.rand(seed)).orderBy("__r", "_pos").limit(n).orderBy("_pos").drop("__r", "_pos")


def smart(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """Rows at even steps: 0, s, 2 s ... with s = max(1, rows div n), the first n of them; all rows if there are at most n; none for n = 0."""
    if n <= 0:
        return df.limit(0)
    total = df.count()
    step = max(1, total // n)
    if total > n and n <= BY_PLACE and (found := at_positions(df, range(0, n * step, step), order_by)) is not None:
        return found
    rows = with_positions(df, order_by)
    if total > n:
        rows = rows.where((F.col("_pos") % step == 0) & (F.col("_pos") < n * step))
    return rows.orderBy("_pos").drop("_pos")


def sample(df: DataFrame, how: str = "smart", n: int = 5, order_by: list[str] | None = None, seed: int | None = None) -> DataFrame:
    how = strategy(how)
    return random(df, n, seed, order_by) if how == "random" else {"head": head, "tail": tail, "smart": smart}[how](df, n, order_by)
