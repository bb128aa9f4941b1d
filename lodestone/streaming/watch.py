"""A streaming source of file events: what was created, modified or deleted under a folder since the last look.

spark.readStream.format("file_events").option("path", folder).option("state", folder of its own): options hidden, ignore, links, depth as for files, and
batch_size, the events of one micro-batch at most. A look lists the folder and compares it with the listing before; both the listing and the events
of each look are kept in the state folder under its number, so a batch that is asked for again after a failure is the same.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestone.sources.files import walk
from lodestone.streaming.incremental import EVENTS


def changes(before: dict[str, list], now: dict[str, list]) -> list[tuple[str, str]]:
    """(kind, path) by path; a listing is path -> [time of change, size]."""
    out = [("created", p) for p in now.keys() - before.keys()] + [("deleted", p) for p in before.keys() - now.keys()]
    out += [("modified", p) for p in now.keys() & before.keys() if now[p] != before[p]]
    return sorted(out, key=lambda x: (x[1], x[0]))


def listing(root: str, **options) -> dict[str, list]:
    return {path: [modified.timestamp(), size] for path, size, modified, is_dir in walk(root, **options) if not is_dir}


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema):
        return WatchReader(self.options)


class WatchReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root, self.state = options["path"], options["state"]
        self.settings = {"hidden": flag("hidden", False), "ignore": flag("ignore", True), "links": flag("links", False)}
        self.settings["depth"] = int(options["depth"]) if options.get("depth") else None
        self.size = int(options.get("batch_size", 10_000))
        os.makedirs(self.state, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"look": 0}

    def _file(self, kind: str, look: int) -> str:
        return os.path.join(self.state, f"{kind}-{look}.json")

    def _load(self, kind: str, look: int):
        if look == 0 and kind == "listing":
            return {}
        with open(self._file(kind, look), encoding="utf-8") as f:
            return json.load(f)

    def _save(self, kind: str, look: int, value: object) -> None:
        new = self._file(kind, look) + ".new"
        with open(new, "w", encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(new, self._file(kind, look))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        look = start["look"]
        if os.path.exists(self._file("events", look + 1)):  # asked for again
            return self.readBetweenOffsets(start, {"look": look + 1}), {"look": look + 1}
        before, now = self._load("listing", look), listing(self.root, **self.settings)
        found = changes(before, now)
        if not found:
            return iter([]), start
        # what does not fit in this batch is found by the next look
        found = found[: self.size]
        seen = dict(before)
        for kind, path in found:
            if kind == "deleted":
                del seen[path]
            else:
                seen[path] = now[path]
        self._save("listing", look + 1, seen)
        self._save("events", look + 1, [[kind, path, datetime.now(UTC).timestamp()] for kind, path in found])
        return self.readBetweenOffsets(start, {"look": look + 1}), {"look": look + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        looks = range(start["look"] + 1, end["look"] + 1)
        # an iterator of a list, as Spark copies it
        return iter([(kind, path, None, datetime.fromtimestamp(at, UTC)) for look in looks for kind, path, at in self._load("events", look)])

    def commit(self, end: dict) -> None:
        """Looks before the last one that is done are not asked for again."""
        for look in range(end["look"] - 2, 0, -1):
            if not os.path.exists(self._file("events", look)):
                break
            for kind in ("listing", "events"):
                os.remove(self._file(kind, look))


def watch(spark: SparkSession, root: str, state: str, **options) -> DataFrame:
    """The stream of events of a folder."""
    spark.dataSource.register(WatchSource)
    return spark.readStream.format("file_events").options(path=root, state=state, **{k: str(v) for k, v in options.items() if v is not None}).load()
