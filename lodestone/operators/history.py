"""Search history: records, statistics, recommendations."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import HistoryFailed

SCHEMA = "id bigint, query string, path string, file_type string, search_type string, results bigint, ms bigint, timestamp timestamp"
KEPT = 1000
#: Extensions that a query may name.
NAMED = ["rs", "js", "ts", "py", "go", "java", "toml", "json", "yaml", "yml", "md", "log", "csv", "sql"]


def modal(c: Column) -> Column:
    """Most frequent value, the smallest of equals; null of none."""
    return F.mode(c, deterministic=True)


def statistics(h: DataFrame, query: str) -> DataFrame:
    """One row about entries whose query contains this one, in any case; none without such entries."""
    hit = h.where(F.contains(F.lower("query"), F.lit(query.lower())))
    out = hit.agg(F.count("*").alias("count"), F.avg("results").alias("mean_results"), F.avg("ms").alias("mean_ms"), modal(F.col("path")).alias("path"), modal(F.col("search_type")).alias("search_type"))
    return out.where("count > 0")


def frequencies(h: DataFrame, k: int = 10) -> DataFrame:
    q = F.lower("query")
    return h.where(q != "").groupBy(q.alias("query")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(k)


def co_occurrence(h: DataFrame) -> DataFrame:
    return h.where("file_type is not null").groupBy("path", "file_type").agg(F.count("*").alias("count"))


def recent(h: DataFrame, n: int = 20) -> DataFrame:
    return h.orderBy(F.desc("id")).limit(n)


def _advice(df: DataFrame, kind: str, value: str, confidence: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(value).alias("value"), confidence.cast("double").alias("confidence"))


def recommend_queries(h: DataFrame, query: str) -> DataFrame:
    """Of the ten most frequent queries those that contain this one or are in it; without such, the most frequent one if it was asked three times."""
    q = query.lower()
    top = frequencies(h, 10)
    sure = F.least(F.col("count") / 10, F.lit(1.0))
    near = top.where((F.col("query") != q) & (F.contains("query", F.lit(q)) | F.contains(F.lit(q), F.col("query"))))
    first = top.orderBy(F.desc("count"), "query").limit(1).where(F.col("count") >= 3)
    lonely = first.join(near.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti")
    return _advice(near, "query", "query", sure).unionByName(_advice(lonely, "query", "query", sure * 0.7))


def recommend_types(h: DataFrame, query: str) -> DataFrame:
    """Where a query names extensions, the usual types of the paths that are other ones; if there are none, the most frequent type of all, if it came three times."""
    named = [x for x in NAMED if x in query.lower()]
    typed = h.where("file_type is not null")
    other = reduce(lambda a, b: a | b, [F.col("t") != x for x in named], F.lit(False))
    by_path = typed.groupBy("path").agg(modal(F.col("file_type")).alias("t")).where(other).select("t").distinct()
    every = typed.groupBy("file_type").count().where("count >= 3").orderBy(F.desc("count"), "file_type").limit(1)
    lonely = every.join(by_path.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti")
    return _advice(by_path, "file_type", "t", F.lit(0.6)).unionByName(_advice(lonely, "file_type", "file_type", F.lit(0.5)))


def recommend_paths(h: DataFrame) -> DataFrame:
    """The most frequent path of the last 20 entries, if it is there three times."""
    places = recent(h, 20).groupBy("path").count().where("count >= 3 and path <> '' and path <> '.'").orderBy(F.desc("count"), "path").limit(1)
    return _advice(places, "path", "path", F.lit(0.7))


def recommend_search_types(h: DataFrame) -> DataFrame:
    kinds = h.groupBy("search_type").count().where("count >= 2 and search_type is not null").orderBy(F.desc("count"), "search_type").limit(1)
    return _advice(kinds, "search_type", "search_type", F.lit(0.6))


def recommend(h: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(kind, value, confidence): queries, file types, paths and search types that fit, the surest first."""
    out = reduce(DataFrame.unionByName, [recommend_queries(h, query), recommend_types(h, query), recommend_paths(h), recommend_search_types(h)])
    return out.groupBy("kind", "value").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "kind", "value").limit(k)


class Recommender:
    """Recommendations from a history, kept per query until something is recorded."""

    def __init__(self, history: History, spark: SparkSession):
        self.history, self.spark = history, spark
        self.kept: dict[tuple[str, int], list[dict]] = {}

    def of(self, query: str, k: int = 5) -> list[dict]:
        key = (query.lower(), k)
        if self.kept_for != self.history.version:
            self.kept, self.kept_for = {}, self.history.version
        if key not in self.kept:
            self.kept[key] = [r.asDict() for r in recommend(self.history.frame(self.spark), query, k).collect()]
        return self.kept[key]

    kept_for = -1


def time_ago(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 60, F.concat(s, F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("min ago"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d ago")))


@dataclass
class Entry:
    query: str
    path: str = "."
    file_type: str | None = None
    search_type: str = "standard"
    results: int = 0
    ms: int = 0
    id: int = 0
    timestamp: str = ""


def _write(path: str, value: object) -> None:
    """In place of the file, as a whole."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
    os.replace(tmp, path)


class History:
    """A JSON file of at most KEPT entries; a damaged file is an error."""

    def __init__(self, path: str):
        self.path, self.version = path, 0
        try:
            with open(path, encoding="utf-8") as f:
                self.entries = [Entry(**e) for e in json.load(f)]
        except FileNotFoundError:
            self.entries = []
        except (ValueError, TypeError) as e:
            raise HistoryFailed(f"damaged: {path}: {e}") from e
        self.next = max((e.id for e in self.entries), default=0) + 1

    def record(self, entry: Entry) -> int:
        entry.id, entry.timestamp = self.next, entry.timestamp or datetime.now(UTC).isoformat()
        self.next += 1
        self.version += 1
        self.entries = [*self.entries, entry][-KEPT:]
        _write(self.path, [asdict(e) for e in self.entries])
        return entry.id

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.id, e.query, e.path, e.file_type, e.search_type, e.results, e.ms, datetime.fromisoformat(e.timestamp)) for e in self.entries]
        return spark.createDataFrame(rows, SCHEMA)

    def clear(self) -> None:
        self.entries = []
        self.version += 1
        if os.path.exists(self.path):
            os.remove(self.path)

    def __len__(self) -> int:
        return len(self.entries)


class SessionContext:
    """Operations of one session, kept as JSON; a damaged file begins a new session."""

    def __init__(self, path: str, cap: int = 1000):
        self.path, self.cap = path, cap
        self.variables: dict[str, str] = {}
        self.operations: list[dict] = []
        try:
            data = json.load(open(path, encoding="utf-8"))
            self.operations, self.variables = data["operations"], data["variables"]
        except (OSError, ValueError, KeyError, TypeError):
            pass

    def add(self, kind: str, target: str, detail: str = "") -> None:
        self.operations = [*self.operations, {"kind": kind, "target": target, "detail": detail, "at": datetime.now(UTC).isoformat()}][-self.cap :]
        self._save()

    def set(self, key: str, value: str) -> None:
        self.variables[key] = value
        self._save()

    def get(self, short: bool = False) -> list[dict]:
        return self.operations[-3:] if short else self.operations

    def inject(self, text: str) -> str:
        """text with the last five operations before it, newest first."""
        lines = [f"- {o['kind']} {o['target']} {o['detail'][:60]}".rstrip() for o in reversed(self.operations[-5:])]
        return "\n".join([*lines, text]) if lines else text

    def export(self) -> str:
        return json.dumps({"operations": self.operations, "variables": self.variables}, ensure_ascii=False)

    def clear(self) -> None:
        self.operations, self.variables = [], {}
        self._save()

    def _save(self) -> None:
        _write(self.path, {"operations": self.operations, "variables": self.variables})


#: Tokens a byte or character, dollars a million tokens, yuan a dollar.
TOKENS_EACH, DOLLARS, YUAN = 0.5, 0.15, 7.2


def savings(source_bytes: Column, output_chars: Column) -> dict[str, Column]:
    """Tokens before and after, those saved, and what they cost in dollars and yuan, of columns."""
    before, after = F.floor(source_bytes * TOKENS_EACH), F.floor(output_chars * TOKENS_EACH)
    saved = F.greatest(F.lit(0).cast("bigint"), before - after)
    return {"before": before, "after": after, "saved": saved, "usd": saved * DOLLARS / 1e6, "cny": saved * DOLLARS / 1e6 * YUAN}


def token_savings(source_bytes: int, output_chars: int) -> dict:
    """The same of two numbers."""
    before, after = int(source_bytes * TOKENS_EACH), int(output_chars * TOKENS_EACH)
    saved = max(0, before - after)
    return {"before": before, "after": after, "saved": saved, "usd": saved * DOLLARS / 1e6, "cny": saved * DOLLARS / 1e6 * YUAN}
