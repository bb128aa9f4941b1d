"""Incremental indexing: file events are debounced, filtered and applied as idempotent upserts to a folder that TextIndex.open reads.

A micro-batch costs what it changes: it writes a delta (what happened to which paths, the new texts and their postings) and adds its name to the pointer. After
COMPACT deltas they are merged with the generation below them; what no reader can name any more is deleted then. The batch that merges writes its texts and postings
into the new generation alone: its delta tells what happened.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.text_index import BUCKETS, CODEC, KEPT, NO_BASE, TextIndex, bucket, indexed, live, point, pointed, postings_of
from lodestone.sources.files import extension_of, tail_lines

EVENTS = "kind string, path string, to_path string, event_time timestamp"
#: What happened to a file; other kinds are passed over.
KINDS = ("created", "modified", "deleted", "renamed")


def event_kind(raw: Column) -> Column:
    """Names that systems use -> our kinds; null for accesses and the like."""
    low = F.lower(raw)
    return F.when(low.startswith("creat"), "created").when(low.startswith("modif"), "modified").when(low.startswith("remov") | low.startswith("delet"), "deleted").when(low.startswith("renam"), "renamed")


def debounce(events: DataFrame, gap: str = "500 milliseconds", delay: str | None = None) -> DataFrame:
    """The last event of each path in each burst, a burst ending after `gap` of quiet. The same plan for batches and streams.

    On streams the watermark waits `delay` (at least the gap), so a burst is given out once no earlier event can come.
    """
    rows = events.withWatermark("event_time", delay or gap) if events.isStreaming else events
    last = F.max_by(F.struct("kind", "to_path"), F.col("event_time"))
    out = rows.groupBy("path", F.session_window("event_time", gap).alias("w")).agg(last.alias("x"), F.max("event_time").alias("event_time"), F.count("*").alias("merged"))
    return out.select("x.kind", "path", "x.to_path", "event_time", "merged")


def event_filter(path: Column, ignore: list[str] | None = None, hidden: bool = False, include: list[str] | None = None) -> Column:
    """Paths to look at: no hidden names, none that matches a pattern. One * is any middle; without it a pattern matches anywhere. include: only these
    extensions, if there are any."""
    keep = F.lit(True) if hidden else ~F.substring_index(path, "/", -1).startswith(".")
    for p in ignore or []:
        if p.count("*") == 1:
            a, b = p.split("*")
            keep = keep & ~(path.startswith(a) & path.endswith(b) if a else path.endswith(b))
        else:
            keep = keep & ~path.contains(p)
    names = [x.lstrip(".").lower() for x in include or []]
    return keep & F.coalesce(extension_of(path).isin(names), F.lit(False)) if names else keep


def operations(events: DataFrame) -> DataFrame:
    """(path, op, event_time): a rename is a delete and a put."""
    renamed = F.col("kind") == "renamed"
    ops = F.when(renamed, F.array(F.struct(F.col("path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("to_path").alias("path"), F.lit("put").alias("op"))))
    ops = ops.otherwise(F.array(F.struct(F.col("path").alias("path"), F.when(F.col("kind") == "deleted", "delete").otherwise("put").alias("op"))))
    return events.where(F.col("kind").isin(*KINDS)).select(F.explode(ops).alias("o"), "event_time").select("o.path", "o.op", "event_time").where("path is not null")


def latest(ops: DataFrame) -> DataFrame:
    """One operation a path, the last; of equal times the delete."""
    return ops.groupBy("path").agg(F.max(F.struct("event_time", F.when(F.col("op") == "delete", 1).otherwise(0).alias("gone"))).alias("x")).select("path", F.when(F.col("x.gone") == 1, "delete").otherwise("put").alias("op"), "x.event_time")


def upsert(docs: DataFrame, ops: DataFrame, contents: DataFrame) -> DataFrame:
    """docs after ops; contents: (path, content) of what can be read now. A put of a file that is gone deletes it."""
    last = latest(ops)
    fresh = last.where("op = 'put'").select("path").join(contents, "path")
    return docs.join(last.select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


#: Deltas that a folder gathers before they are merged.
COMPACT = 16


class IncrementalIndex:
    """A folder of a text index that events change. A batch that comes again changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, read: Callable[[DataFrame], DataFrame], keep_log: int = 1000, compact: int = COMPACT):
        """read: paths (path) -> (path, content, ...) of those that exist."""
        self.spark, self.folder, self.read, self.keep_log, self.compact = spark, folder, read, keep_log, compact
        self.stats = {"created": 0, "modified": 0, "deleted": 0, "renamed": 0, "errors": 0, "pending": 0, "last_update": None}

    def _names(self) -> list[str]:
        """The generation and the deltas that the last pointer lists; nothing before the first batch."""
        return pointed(self.spark, self.folder)[1]

    def index(self) -> TextIndex | None:
        return TextIndex.open(self.spark, self.folder) if self._names() else None

    def docs(self) -> DataFrame | None:
        found = self.index()
        return None if found is None else found.docs.select("path", "content", "file_type")

    def batch_done(self) -> int:
        numbers = [int(m[1]) for n in self._names() if (m := re.match(r"(?:gen|delta)-b(\d+)-", n))]
        return max(numbers, default=-1)

    def apply(self, events: DataFrame, batch_id: int) -> bool:
        """False if the batch had been applied."""
        if batch_id <= self.batch_done():
            return False
        spark, name = self.spark, f"delta-b{batch_id}-{uuid.uuid4().hex}"
        number, names = pointed(spark, self.folder)
        at = f"{self.folder}/{name}"
        self.stats["pending"] = 1
        events.write.parquet(f"{at}/events")
        events = spark.read.schema(events.schema).parquet(f"{at}/events")
        latest(operations(events)).write.parquet(f"{at}/ops")
        ops = spark.read.parquet(f"{at}/ops")
        puts = ops.where("op = 'put'").select("path")
        names = names or [NO_BASE]
        if len(names) >= self.compact:
            read = self._merge(batch_id, number, names, name, indexed(self.read(puts)), puts)
        else:
            read = self._delta(number, names, name, indexed(self.read(puts)), ops)
        for r in events.groupBy("kind").count().collect():
            if r["kind"] in self.stats:
                self.stats[r["kind"]] += r["count"]
        self.stats["errors"] += puts.count() - read
        self.stats["pending"], self.stats["last_update"] = 0, datetime.now()
        return True

    def _delta(self, number: int, names: list[str], name: str, fresh: DataFrame, ops: DataFrame) -> int:
        """fresh and their postings beside what is there; the number of documents that could be read."""
        spark, at = self.spark, f"{self.folder}/{name}"
        fresh.write.parquet(f"{at}/docs", compression=CODEC)
        fresh = spark.read.parquet(f"{at}/docs")
        old = self.index()
        buckets = BUCKETS if old is None else old.buckets
        postings_of(fresh, keep=KEPT).withColumn("bucket", bucket(buckets=buckets)).write.parquet(f"{at}/postings", compression=CODEC)
        docs, words = read, _ = fresh.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        more = spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count("*").alias("df"))
        if old is not None:  # only what the batch changes is looked up
            gone = old.docs.join(ops.select(F.col("path").alias("changed")), F.col("path") == F.col("changed"), "left_semi").select("doc_id", "content", "length")
            n, length = gone.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            docs, words = docs + old.stats[0] - n, words + round(old.stats[0] * old.stats[1]) - length
            if n:  # their terms leave the counts
                more = more.unionByName(postings_of(gone).groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        more.write.parquet(f"{at}/terms", compression=CODEC)
        spark.createDataFrame([(docs, words / docs if docs else 0.0, buckets)], "docs bigint, average double, buckets int").write.parquet(f"{at}/stats")
        point(spark, self.folder, " ".join([*names, name]), number)
        return read

    def _merge(self, batch_id: int, number: int, names: list[str], delta: str, fresh: DataFrame, puts: DataFrame) -> int:
        """One generation of all deltas and fresh; its postings come from its texts, as joining texts moves less than joining postings. The number of documents that
        could be read. Folders older than those that were current until now are deleted."""
        spark, name = self.spark, f"gen-b{batch_id}-{uuid.uuid4().hex}"
        self.log([*names, delta]).limit(self.keep_log).write.parquet(f"{self.folder}/{name}/log")
        TextIndex(live(spark, self.folder, [*names, delta], "docs", fresh)).save(self.folder, name, number)
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(folder):
            n = f.getPath().getName()
            if f.isDirectory() and re.match(r"(gen|delta)-", n) and n not in (*names, delta, name):
                fs.delete(f.getPath(), True)
        return spark.read.parquet(f"{self.folder}/{name}/docs").join(puts, "path", "left_semi").count()

    def log(self, names: list[str] | None = None) -> DataFrame:
        """(op, path, event_time), newest first: at most keep_log of them outlive a merge. names: instead of those that the last pointer lists."""
        parts = []
        for n in self._names() if names is None else names:
            if n.startswith("gen-"):
                parts.append(self.spark.read.parquet(f"{self.folder}/{n}/log"))
            elif n != NO_BASE:
                parts.append(self.spark.read.parquet(f"{self.folder}/{n}/ops").select("op", "path", "event_time"))
        return reduce(DataFrame.unionByName, parts).orderBy(F.desc("event_time"), "path").limit(self.keep_log)

    def recent(self, n: int = 10) -> DataFrame:
        """Newest operations first."""
        return self.log().limit(n)

    def run(self, events: DataFrame, checkpoint: str, gap: str = "500 milliseconds", delay: str | None = None, ignore: list[str] | None = None, include: list[str] | None = None, **trigger) -> StreamingQuery:
        """Starts the stream: debounce, filter, upsert; every micro-batch commits."""
        clean = debounce(events.where(event_filter(F.col("path"), ignore, include=include)), gap, delay)
        return clean.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.apply(df.drop("merged"), i)).trigger(**(trigger or {"processingTime": "100 milliseconds"})).start()


class StreamRegistry:
    """Running streams by name: status, last progress, logs, stop."""

    def __init__(self, folder: str | None = None) -> None:
        """folder: where each stream has a log file, <name>.log."""
        self.streams: dict[str, StreamingQuery] = {}
        self.folder = folder

    def add(self, name: str, query: StreamingQuery) -> None:
        self.streams[name] = query
        self.write(name, f"started {query.id}")

    def write(self, name: str, line: str) -> None:
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)
            with open(os.path.join(self.folder, f"{name}.log"), "a", encoding="utf-8") as f:
                f.write(f"{datetime.now().isoformat(timespec='seconds')} {line}\n")

    def logs(self, name: str, n: int = 50) -> list[str]:
        """The last n lines of a stream's log."""
        at = os.path.join(self.folder or "", f"{name}.log")
        return tail_lines(at, n) if self.folder and os.path.exists(at) else []

    def status(self) -> list[dict]:
        return [{"name": n, "active": q.isActive, "message": q.status["message"], "progress": q.lastProgress} for n, q in self.streams.items()]

    def stop(self, name: str) -> bool:
        q = self.streams.pop(name, None)
        if q is not None:
            q.stop()
            self.write(name, "stopped")
        return q is not None
