"""Numeric summaries of a column as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpointed

#: approx_percentile is off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Groups whose brackets are broadcast; rows of more are shuffled to them.
FEW_GROUPS = 100_000


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int) -> Column:
    """Halves away from zero, of the value times 10^digits; the sign stays, that of zero too, as in the ROUND of C++ engines (Spark's own makes 0.0 of -0.000001)."""
    x, scale = _c(c).cast("double"), 10.0**digits
    return F.when(F.abs(x) * scale < float("inf"), F.round(F.abs(x) * scale) / scale * F.signum(x)).otherwise(x)


def total(c: str | Column) -> Column:
    """Sum; 0 of no rows."""
    return F.coalesce(F.sum(_c(c).cast("double")), F.lit(0.0))


def mean(c: str | Column) -> Column:
    return F.avg(_c(c))


def variance(c: str | Column) -> Column:
    """Of a sample; null under two rows."""
    return F.var_samp(_c(c))


def std_dev(c: str | Column) -> Column:
    return F.stddev_samp(_c(c))


def _no_nan(c: str | Column) -> Column:
    return F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))


def minimum(c: str | Column) -> Column:
    """NaN is passed over; null of no rows."""
    return F.min(_no_nan(c))


def maximum(c: str | Column) -> Column:
    return F.max(_no_nan(c))


def percentile_rank(values: Column, p: float) -> Column:
    """Of an array: the sorted value at min(n * p div 100, n - 1). For groups of a table of any size there is group_percentile."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(F.floor(n * p / 100), n - 1).cast("int"))


def _at_ranks(df: DataFrame, keys: list[str], value: str, wanted: list[tuple[float, Callable[[Column, Column], Column]]]) -> DataFrame:
    """(keys, __n, __k, __x0, __x1, ...): rows of each group, those that are not null, and for each of wanted the value at a rank among the latter, exactly. wanted: about
    which share of them lies below, and the rank from 0 by __n and __k; a negative rank gives null.

    A sketch brackets each rank, the rows under the bracket are counted and the distinct values in it (about 4 / ACCURACY of the group) ranked, so no group is
    gathered. A bracket that misses its rank is found out and widened to the whole group.
    """
    v, n, k = F.col(f"`{value}`"), F.col("__n"), F.col("__k")
    shares = [min(1.0, max(0.0, s + d)) for s, _ in wanted for d in (-2 / ACCURACY, 2 / ACCURACY)]
    facts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count(v).alias("__k"), F.percentile_approx(v, shares, ACCURACY).alias("__b"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    facts = checkpointed(facts)
    ends = [F.struct(F.lit(i).alias("i"), rank(n, k).cast("long").alias("rank"), F.get("__b", F.lit(2 * i)).alias("a"), F.get("__b", F.lit(2 * i + 1)).alias("z")) for i, (_, rank) in enumerate(wanted)]
    named = [F.col(f"`{c}`").alias(f"__g{j}") for j, c in enumerate(keys)]
    todo = facts.select(*named, "__lo", "__hi", F.explode(F.array(*ends)).alias("__e")).where("__e.rank >= 0")
    at = [F.col(f"__g{j}").eqNullSafe(F.col(f"`{c}`")) for j, c in enumerate(keys)]
    few, found = facts.count() <= FEW_GROUPS, None
    for whole in (False, True):
        lo, hi = (F.col("__lo"), F.col("__hi")) if whole else (F.col("__e.a"), F.col("__e.z"))
        of = todo.select(*[f"__g{j}" for j in range(len(keys))], lo.alias("__a"), hi.alias("__z"), F.col("__e.i").alias("__i"), F.col("__e.rank").alias("__rank"))
        of = F.broadcast(of) if few else of  # else all rows of a group would meet in one task
        rows = df.where(v.isNotNull()).join(of, [*at, v <= F.col("__z")])
        where = F.when(v < F.col("__a"), F.lit(None)).otherwise(v)
        counts = rows.groupBy(*keys, "__i", where.alias("__v"), "__rank").agg(F.count("*").alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy(F.col("__v").asc_nulls_first()))
        hit = (F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")) & F.col("__v").isNotNull()
        some = checkpointed(counts.withColumn("__upto", upto).where(hit).select(*named, "__i", "__v"))
        found = some if found is None else found.unionByName(some)
        same = [F.col(f"t.__g{j}").eqNullSafe(F.col(f"s.__g{j}")) for j in range(len(keys))]
        todo = todo.alias("t").join(some.alias("s"), [*same, F.col("t.__e.i") == F.col("s.__i")], "left_anti")
        if whole or not todo.take(1):
            break
    flat = found.groupBy(*[f"__g{j}" for j in range(len(keys))]).agg(*[F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(f"__x{i}") for i in range(len(wanted))])
    return facts.join(flat, at, "left").select(*[F.col(f"`{c}`") for c in keys], "__n", "__k", *[f"__x{i}" for i in range(len(wanted))])


def group_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str = "value") -> DataFrame:
    """(keys, name): of each group the sorted value at min(n * p div 100, n - 1), exactly; nulls come first, as in a sorted array. No group is gathered."""
    rank = lambda n, k: F.least(F.floor(n * p / 100), n - 1) - (n - k)
    return _at_ranks(df, keys, value, [(p / 100, rank)]).select(*[F.col(f"`{c}`") for c in keys], F.col("__x0").alias(name))


def group_quantiles(df: DataFrame, keys: list[str], value: str, **wanted: tuple[str, float]) -> DataFrame:
    """(keys, a column each): of each group the quantile ("cont" or "disc", share) of the values that are not null, exactly, as quantile_cont and quantile_disc give it; null
    where there are none. No group is gathered."""
    ranks: list[tuple[float, Callable[[Column, Column], Column]]] = []
    out = []
    for name, (kind, p) in wanted.items():
        x = [F.col(f"__x{len(ranks) + j}") for j in (0, 1)]
        if kind == "disc":
            ranks.append((p, lambda n, k, p=p: F.when(k > 0, F.greatest(k - F.floor(k - k * p), F.lit(1)) - 1)))
            out.append(x[0].alias(name))
            continue
        ranks += [(p, lambda n, k, p=p: F.when(k > 0, F.floor((k - 1) * p))), (p, lambda n, k, p=p: F.when(k > 0, F.ceil((k - 1) * p)))]
        place = (F.col("__k") - 1) * p
        low, high = (c.cast("double") for c in x)
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))).alias(name))
    return _at_ranks(df, keys, value, ranks).select(*[F.col(f"`{c}`") for c in keys], *out)
