"""Files as rows: a batch data source with ignore rules, and predicates on size, time and type."""

from __future__ import annotations

import fnmatch
import functools
import os
import re
import stat as stat_
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.errors import FilterSyntax

SCHEMA = "path string, size bigint, modified timestamp, is_dir boolean"
#: With the option errors=true: what could not be read is a row with its reason.
SCHEMA_ERRORS = SCHEMA + ", error string"
#: Names of type groups and their extensions.
TYPES = {
    "csv": ["csv", "tsv"],
    "json": ["json", "jsonl", "ndjson"],
    "log": ["log", "logs"],
    "code": ["rs", "py", "js", "ts", "go", "java", "c", "cpp", "h", "hpp", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh"],
    "text": ["txt", "md", "rst", "text"],
    "parquet": ["parquet", "pq"],
}
_UNITS = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
OWN_IGNORE = ".lodestoneignore"


def parse_size(text: str) -> int:
    """Bytes of 12, 1.5KB, 2 mb ..."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(b|kb|mb|gb)?\s*", text, re.I)
    if not m:
        raise FilterSyntax(f"not a size: {text}")
    return int(float(m[1]) * _UNITS[(m[2] or "").lower()])


def size_filter(text: str, size: Column | str = "size") -> Column:
    """gt:, lt:, eq:, a-b (both included), >, <, =, or a size that is meant exactly."""
    c = F.col(size) if isinstance(size, str) else size
    s = text.strip()
    for mark, op in (("gt:", ">"), ("lt:", "<"), ("eq:", "=")):
        if s.lower().startswith(mark):
            s = op + s[len(mark) :]
            break
    if "-" in s and s[0] not in "<>=":
        a, b = s.split("-", 1)
        return c.between(parse_size(a), parse_size(b))
    n = parse_size(s[1:] if s[:1] in "<>=" else s)
    return c > n if s[:1] == ">" else c < n if s[:1] == "<" else c == n


def time_filter(text: str, modified: Column | str = "modified", now: datetime | None = None) -> Column:
    """-7d: within; +30d: before; 2024-01-01: since midnight UTC. The present is taken once; rows without a time do not match."""
    c = F.col(modified) if isinstance(modified, str) else modified
    now = now or datetime.now(UTC)
    s = text.strip()
    if m := re.fullmatch(r"([+-])(\d+)d", s):
        edge = F.lit(now - timedelta(days=int(m[2])))
        hit = c >= edge if m[1] == "-" else c < edge
    else:
        try:
            hit = c >= F.lit(datetime.strptime(s, "%Y-%m-%d").replace(tzinfo=UTC))
        except ValueError:
            raise FilterSyntax(f"not a time: {text}") from None
    return F.coalesce(hit, F.lit(False))


def extensions(text: str) -> list[str]:
    """Of a group by name, or of a list of extensions."""
    s = text.strip().lower()
    return TYPES[s] if s in TYPES else [x.strip().lstrip(".") for x in s.split(",") if x.strip().lstrip(".")]


def extension_of(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), F.lit(""))


def type_filter(text: str, path: Column | str = "path") -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(extension_of(c).isin(extensions(text)), F.lit(False))


def path_contains(text: str, path: Column | str = "path") -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.contains(F.lower(c), F.lit(text.lower()))


class Ignore:
    """Rules of ignore files: later rules win, ! takes back, a slash at the end means folders, one inside anchors the rule."""

    def __init__(self, lines: list[str], base: str):
        self.rules = []
        for raw in lines:
            s = raw.rstrip("\n")
            if not s.strip() or s.startswith("#"):
                continue
            s = s.strip()
            back, s = s.startswith("!"), s.lstrip("!")
            folder, s = s.endswith("/"), s.rstrip("/")
            anchored = "/" in s
            self.rules.append((back, folder, anchored, s.lstrip("/"), base))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        out = None
        for back, folder, anchored, pattern, base in self.rules:
            if folder and not is_dir:
                continue
            rel = os.path.relpath(path, base)
            if rel.startswith(".."):
                continue
            hit = _glob(rel, pattern) if anchored else fnmatch.fnmatchcase(os.path.basename(path), pattern)
            if hit:
                out = not back
        return out


def _glob(path: str, pattern: str) -> bool:
    p = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.fullmatch(p, path) is not None


def _rules(folder: str, names: tuple[str, ...] = (".gitignore", ".ignore", OWN_IGNORE)) -> list[Ignore]:
    out = []
    for n in names:
        if os.path.isfile(f := os.path.join(folder, n)):
            with open(f, encoding="utf-8", errors="replace") as lines:
                out.append(Ignore(lines.readlines(), folder))
    return out


def outer_rules(root: str, env: dict[str, str] | None = None) -> list[Ignore]:
    """Rules that hold from outside: the user's global ignore file, then the repository's own exclude file."""
    env = dict(os.environ) if env is None else env
    config = env.get("XDG_CONFIG_HOME") or os.path.join(env.get("HOME", os.path.expanduser("~")), ".config")
    out = []
    for f in (os.path.join(config, "git", "ignore"), os.path.join(root, ".git", "info", "exclude")):
        if os.path.isfile(f):
            with open(f, encoding="utf-8", errors="replace") as lines:
                out.append(Ignore(lines.readlines(), root))
    return out


def walk(root: str, hidden: bool = False, ignore: bool = True, depth: int | None = None, links: bool = False, errors: bool = False, above: list[Ignore] | None = None) -> Iterator[tuple]:
    """(path, size, modified, is_dir) of what is under root, rules of .gitignore, .ignore, our own file and those above honoured.

    errors: each row ends in a reason, null for what was read; folders and files that cannot be looked at are rows of their own. Else they are left out.
    """
    end = (None,) if errors else ()

    def failed(path: str, is_dir: bool, e: OSError) -> Iterator[tuple]:
        if errors:
            yield path, None, None, is_dir, f"{type(e).__name__}: {e.strerror}"

    def rows(folder: str, level: int, rules: list[Ignore]) -> Iterator[tuple]:
        try:
            names = sorted(os.scandir(folder), key=lambda e: e.name)
            rules = rules + _rules(folder) if ignore else rules
        except OSError as x:
            yield from failed(folder, True, x)
            return
        for e in names:
            if not hidden and e.name.startswith("."):
                continue
            try:
                is_dir, s = e.is_dir(follow_symlinks=links), e.stat(follow_symlinks=links)
            except OSError as x:
                yield from failed(e.path, False, x)
                continue
            if not links and stat_.S_ISLNK(s.st_mode):
                continue
            verdicts = [v for r in rules if (v := r.verdict(e.path, is_dir)) is not None]
            if verdicts and verdicts[-1]:
                continue
            yield e.path, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), is_dir, *end
            if is_dir and (depth is None or level < depth):
                yield from rows(e.path, level + 1, rules)

    if os.path.isfile(root):
        s = os.stat(root)
        yield root, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), False, *end
    else:
        yield from rows(root, 1, above if above is not None else outer_rules(root) if ignore else [])


class _Part(InputPartition):
    def __init__(self, path: str, upper: tuple[str, ...], depth: int | None):
        super().__init__(path)
        self.path, self.upper, self.depth = path, upper, depth


class FileSource(DataSource):
    """spark.read.format("files").option("path", folder): options hidden, ignore, depth, links, errors, tasks.

    Folders are opened on the driver, level by level, until there are about `tasks` of them; each is then a partition. So one deep folder is many.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA_ERRORS if str(self.options.get("errors", "false")).lower() == "true" else SCHEMA

    def reader(self, schema):
        return FileReader(self.options)


class FileReader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root = options["path"]
        self.settings = {"hidden": flag("hidden", False), "ignore": flag("ignore", True), "links": flag("links", False)}
        self.errors = flag("errors", False)
        self.depth = int(options["depth"]) if options.get("depth") else None
        self.tasks = int(options.get("tasks", 64))

    def _above(self, upper: tuple[str, ...]) -> list[Ignore]:
        """Rules of the folders over one, from the outermost on."""
        return outer_rules(self.root) + [r for f in upper for r in _rules(f)] if self.settings["ignore"] else []

    def partitions(self):
        """Opened folders give their own entries (depth 1), the others all that is under them."""
        parts, level, at = [], [(self.root, ())], 1
        if os.path.isfile(self.root):
            return [_Part(self.root, (), 1)]
        while level and len(level) < self.tasks and (self.depth is None or at < self.depth):
            below = []
            for folder, upper in level:
                parts.append(_Part(folder, upper, 1))
                below += [(r[0], (*upper, folder)) for r in walk(folder, depth=1, above=self._above(upper), **self.settings) if r[3]]
            level, at = below, at + 1
        return parts + [_Part(f, upper, None if self.depth is None else self.depth - at + 1) for f, upper in level]

    def read(self, partition):
        yield from walk(partition.path, depth=partition.depth, errors=self.errors, above=self._above(partition.upper), **self.settings)


def scan(spark: SparkSession, root: str, size: str | None = None, mtime: str | None = None, kind: str | None = None, **options) -> DataFrame:
    """Files under root that match all given filters; folders too if no filter is given."""
    spark.dataSource.register(FileSource)
    df = spark.read.format("files").options(path=root, **{k: str(v) for k, v in options.items() if v is not None}).load()
    # what could not be read matches no filter, and is told all the same
    given = [f for f in (size and size_filter(size), mtime and time_filter(mtime), kind and type_filter(kind)) if f is not None]
    wanted = functools.reduce(lambda a, b: a & b, given, ~F.col("is_dir")) if given else F.lit(True)
    return df.where(F.coalesce(wanted, F.lit(False)) | F.col("error").isNotNull() if "error" in df.columns else wanted)


def scan_stats(df: DataFrame) -> DataFrame:
    """(files, folders, total_size, errors) of a scan; the size of folders counts too. Errors are told by scans with errors=True."""
    bad = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    one = lambda c: F.count(F.when(c, 1))
    return df.agg(one(~F.col("is_dir") & ~bad).alias("files"), one(F.col("is_dir") & ~bad).alias("folders"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), one(bad).alias("errors"))


def read_contents(files: DataFrame, max_bytes: int = 100 << 20) -> DataFrame:
    """files with their text: none for folders, files over max_bytes and those with a NUL byte in the first 8000; bad UTF-8 is replaced."""

    def rows(it):
        import pandas as pd

        for x in it:
            out = []
            for path, size, is_dir in zip(x["path"], x["size"], x["is_dir"], strict=True):
                data = None
                if not is_dir and size <= max_bytes:
                    try:
                        with open(path, "rb") as f:
                            data = f.read()
                    except OSError:
                        data = None
                out.append(None if data is None or b"\0" in data[:8000] else data.decode("utf-8", "replace"))
            yield x.assign(content=pd.Series(out, index=x.index, dtype=object))

    return files.mapInPandas(rows, SCHEMA + ", content string")


def tail_lines(path: str, n: int = 50, block: int = 1 << 16) -> list[str]:
    """The last n lines of a file, read from its end in blocks."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        data = b""
        while at > 0 and data.count(b"\n") <= n:
            step = min(block, at)
            at -= step
            f.seek(at)
            data = f.read(step) + data
    return data.decode("utf-8", "replace").splitlines()[-n:] if n > 0 else []
