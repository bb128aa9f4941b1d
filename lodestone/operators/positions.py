"""Row positions. Spark rows have no order of their own: it is asked for by a key, or taken from the files that a table is read from.

A table read from files (columns picked, rows filtered, nothing joined or grouped) has the order of its files' paths and, inside a file, of its rows. Parquet tells
the number of a row in its file. Of other formats a task reads each block of a file from front to back, so rows are numbered as they come, and the first number of each
block is taken off. Offsets of files or blocks come from their counts, so nothing is sorted, stored or shuffled for a position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import checkpointed

#: Files or blocks whose offsets are broadcast; beyond, the join is Spark's to plan.
BROADCAST = 200_000
_OVER_FILES = ("Project", "Filter", "SubqueryAlias", "View")
_MARKS = ("__file", "__block", "__row")


@dataclass(frozen=True)
class FileOrder:
    """rows: a table with the marks __file, __block and __row, by which it is ordered; numbered: is __row the dense number of a row in its file?"""

    rows: DataFrame
    numbered: bool

    @property
    def keys(self) -> list[Column]:
        return [F.col(c) for c in _MARKS]

    def only(self, files: list[str]) -> FileOrder:
        """The rows of some files; the others are not read."""
        return FileOrder(self.rows.where(F.col("__file").isin(files)), self.numbered)


def file_order(df: DataFrame) -> FileOrder | None:
    """The order of the files of a table; None where it has none."""
    plan, filtered = df._jdf.queryExecution().analyzed(), False
    while plan.nodeName() in _OVER_FILES:
        filtered |= plan.nodeName() == "Filter"
        plan = plan.children().head()
    if plan.children().size() or any(m in df.columns for m in (*_MARKS, "_metadata")):
        return None
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    try:
        rows = df.select("*", at[0], F.lit(0).cast("bigint").alias("__block"), F.col("_metadata.row_index").alias("__row"))
        return FileOrder(rows, not filtered)
    except AnalysisException:
        pass  # no format that numbers its rows
    try:
        return FileOrder(df.select("*", *at, F.monotonically_increasing_id().alias("__row")), False)
    except AnalysisException:
        return None  # no files


def _counts(order: FileOrder) -> list[tuple[str, int, int, int]]:
    """(file, block, first number, rows) in order: as many as there are files, or blocks of them."""
    by = order.rows.groupBy("__file", "__block").agg(F.lit(0).cast("bigint").alias("first") if order.numbered else F.min("__row").alias("first"), F.count("*").alias("n"))
    return sorted(tuple(r) for r in by.collect())


def _placed(order: FileOrder, counts: list[tuple[str, int, int, int]], name: str) -> DataFrame:
    """The rows with their positions, and their marks."""
    base, offset = [], 0
    for file, block, first, n in counts:
        base.append((file, block, offset - first))
        offset += n
    spark = order.rows.sparkSession
    table = spark.createDataFrame(base, "__file string, __block bigint, __base bigint")
    joined = order.rows.join(F.broadcast(table) if len(base) <= BROADCAST else table, ["__file", "__block"])
    return joined.withColumn(name, F.col("__base") + F.col("__row")).drop("__base")


def with_positions(df: DataFrame, order_by: list[str] | None = None, name: str = "_pos") -> DataFrame:
    """df with a dense position from 0: in the order of order_by, else of its files, else as its partitions stand.

    Without files, and with a key, rows are checkpointed between the pass that counts the rows of each partition and the one that numbers them, so that both see the
    same partitions whatever executors are lost.
    """
    if name in df.columns:
        df = df.drop(name)
    order = None if order_by else file_order(df)
    if order is not None and order.numbered:
        return _placed(order, _counts(order), name).select(*df.columns, name)
    if order is not None:
        # numbers of the rows that are left: they are not dense in a file, so they are counted as they come
        marked = FileOrder(order.rows.drop("__block", "__row").select("*", F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")), False)
        return _placed(marked, _counts(marked), name).select(*df.columns, name)
    rows = df.orderBy(*order_by) if order_by else df
    rows = checkpointed(rows.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()))
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    offset, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, offset))
        offset += counts[part]
    if not offsets:
        return rows.select("*", F.lit(0).cast("bigint").alias(name)).drop("__part", "__in")
    base = F.element_at(F.create_map(*[x for p, o in offsets for x in (F.lit(p), F.lit(o).cast("bigint"))]), F.col("__part"))
    if len(offsets) > 500:
        table = df.sparkSession.createDataFrame(offsets, "__part int, __base bigint")
        rows = rows.join(F.broadcast(table), "__part")
        base = F.col("__base")
    inner = F.col("__in").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, base + inner).drop("__part", "__in", "__base")


def ends(df: DataFrame, n: int, last: bool = False) -> DataFrame | None:
    """The first or last n rows in the order of the files, of which no more are read than it takes; None without files."""
    order = file_order(df)
    if order is None:
        return None
    files = sorted(_names(df), reverse=last)
    keys = [k.desc() for k in order.keys] if last else order.keys
    found, upto, step = 0, 0, 1
    while found < n and upto < len(files):
        part = files[upto : upto + step]
        found += order.only(part).rows.limit(n - found).count()
        upto, step = upto + step, step * 2
    some = order.only(files[:upto]).rows.orderBy(*keys).limit(n)
    return (some.orderBy(*order.keys) if last else some).select(*df.columns)


def _names(df: DataFrame) -> list[str]:
    """Paths of the files as rows name them: those of the driver's listing, where that spells the first one alike, else they are asked of the rows."""
    listed = df.inputFiles()
    path = df.select(F.col("_metadata.file_path").alias("f"))
    if listed and path.where(F.col("f") == listed[0]).limit(1).count():
        return listed
    return [r["f"] for r in path.distinct().collect()]


def at_positions(df: DataFrame, wanted: range, order_by: list[str] | None = None) -> DataFrame | None:
    """The rows at some positions, in their order; only their files are read again. With a key, the key and the rows' marks are sorted, not the rows. None without files."""
    order = file_order(df)
    if order is None:
        return None
    if order_by is None:
        if not order.numbered:
            return None
        counts = _counts(order)
        spots, offset = [], 0
        for file, _, _, n in counts:
            begin = wanted[0] + max(0, -(-(offset - wanted[0]) // wanted.step)) * wanted.step
            spots += [(file, p - offset) for p in range(begin, min(offset + n, wanted[-1] + 1), wanted.step)]
            offset += n
    else:
        marks = order.rows.select(*[F.col(f"`{c}`") for c in order_by], *_MARKS).drop(*[c for c in order_by if c in _MARKS])
        if not order.numbered:
            return None
        placed = with_positions(marks, [*order_by, *_MARKS])
        spots = [(r["__file"], r["__row"]) for r in placed.where(F.col("_pos").isin(list(wanted))).select("__file", "__row", "_pos").orderBy("_pos").collect()]
    files: dict[str, list[int]] = {}
    for f, r in spots:
        files.setdefault(f, []).append(r)
    table = df.sparkSession.createDataFrame([(f, r, k) for k, (f, r) in enumerate(spots)], "__file string, __row bigint, __nth int")
    some = order.only(list(files)).rows.where(F.col("__row").isin(sorted({r for _, r in spots})))
    return some.join(F.broadcast(table), ["__file", "__row"]).orderBy("__nth").select(*df.columns)
