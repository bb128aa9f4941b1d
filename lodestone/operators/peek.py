"""Short views of files: kind, outline, preview, compressed code, as expressions over (path, size, content)."""

from __future__ import annotations

from functools import reduce

import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.files import extension_of

#: Extensions of each kind; all others are binary.
KINDS = {
    "code": ["rs", "py", "js", "ts", "go", "c", "cpp", "h", "hpp", "java", "cs", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "fish"],
    "config": ["toml", "yaml", "yml", "json", "ini", "xml", "conf", "config", "env", "properties"],
    "text": ["md", "txt", "rst", "text", "adoc", "org"],
}
#: Names that a peek passes over wherever they stand in a path.
IGNORED = [".git", "node_modules", "target", "__pycache__", "venv"]
#: How the lines of an outline begin, by extension.
OUTLINE = {
    "rs": ["pub fn ", "fn ", "pub struct ", "struct ", "pub impl ", "impl ", "pub mod ", "mod ", "pub trait ", "trait ", "pub enum ", "enum "],
    "py": ["def ", "class ", "async def "],
    "js": ["function ", "class ", "const ", "export ", "async function "],
    "ts": ["function ", "class ", "const ", "export ", "async function "],
}
#: Where the signature on such a line ends.
ENDS = {"rs": "{", "py": ":", "js": "{", "ts": "{"}
#: How the lines of a Rust file begin that a compressed view keeps.
KEPT = {"rs": ["fn ", "struct ", "impl ", "mod ", "pub ", "use ", "trait ", "enum ", "type ", "const ", "let ", "return ", "}"]}
COMMENT = r"^\s*(?://|#|\*|/\*)"
BIG, COUNTED = 512 << 10, 1 << 20


def kind_of(path: Column) -> Column:
    ext = extension_of(path)
    out = F.lit("binary")
    for k, names in KINDS.items():
        out = F.when(ext.isin(names), k).otherwise(out)
    return out


def lines_of(text: Column) -> Column:
    """Lines; a line end at the end begins no other."""
    return F.when(F.length(text) > 0, F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n", -1)).otherwise(F.array().cast("array<string>"))


def line_count(text: Column) -> Column:
    return F.size(lines_of(text)).cast("bigint")


def outline(ext: Column, text: Column) -> Column:
    """Up to eight signatures that declare something; of other languages the first five lines that are no comments; in 150 characters. `[empty]` if there are none."""
    lines = F.transform(lines_of(text), lambda x: F.trim(x))
    out = F.slice(F.filter(lines, lambda x: (x != "") & ~x.rlike(COMMENT)), 1, 5)
    for k, begins in OUTLINE.items():
        out = F.when(ext == k, _signatures(lines, begins, ENDS[k])).otherwise(out)
    return F.when(F.size(out) == 0, "[empty]").otherwise(F.substring(F.array_join(out, "; "), 1, 150))


def _declares(line: Column, begins: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.ltrim(line).startswith(b) for b in begins])


def _signatures(lines: Column, begins: list[str], end: str) -> Column:
    return F.transform(F.slice(F.filter(lines, lambda x: _declares(x, begins)), 1, 8), lambda x: F.rtrim(F.substring_index(x, end, 1)))


def summary(path: Column, size: Column, text: Column) -> Column:
    kind = kind_of(path)
    head = F.substring(F.array_join(F.slice(lines_of(text), 1, 3), " | "), 1, 120)
    return F.when(kind == "binary", "[binary]").when(size > BIG, "[large]").when(kind == "code", outline(extension_of(path), text)).otherwise(head)


def preview(text: Column) -> Column:
    """25 lines whole; of more the first 15 and the last 10."""
    lines = lines_of(text)
    cut = F.concat(F.slice(lines, 1, 15), F.array(F.lit("... [truncated] ...")), F.slice(lines, -10, 10))
    return F.array_join(F.when(F.size(lines) <= 25, lines).otherwise(cut), "\n")


def compress(ext: Column, text: Column) -> Column:
    """Without blank lines and comments; of Rust files the lines that give the structure only."""
    kept = F.filter(lines_of(text), lambda x: (F.trim(x) != "") & ~x.rlike(COMMENT))
    return F.array_join(F.when(ext == "rs", F.filter(kept, lambda x: _declares(x, KEPT["rs"]))).otherwise(kept), "\n")


def peek(files: DataFrame) -> DataFrame:
    """(path, size, kind, lines, summary) of files with content."""
    p, t = F.col("path"), F.coalesce(F.col("content"), F.lit(""))
    counted = (kind_of(p) != "binary") & (F.col("size") < COUNTED)
    return files.where(~F.col("is_dir")).select("path", "size", kind_of(p).alias("kind"), F.when(counted, line_count(t)).alias("lines"), summary(p, F.col("size"), t).alias("summary"))


def totals(peeked: DataFrame) -> DataFrame:
    return peeked.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("lines").alias("lines"))


def markdown(peeked: DataFrame, limit: int = 1000) -> str:
    rows = peeked.orderBy("path").limit(limit).collect()
    return "\n".join(["| path | kind | lines | summary |", "| --- | --- | --- | --- |"] + [f"| {r.path} | {r.kind} | {'' if r.lines is None else r.lines} | {r.summary.replace('|', chr(92) + '|')} |" for r in rows])


def tree(peeked: DataFrame, limit: int = 1000) -> str:
    out, last = [], None
    for r in peeked.orderBy("path").limit(limit).collect():
        folder, _, name = r.path.rpartition("/")
        if folder != last:
            out.append(folder + "/")
            last = folder
        out.append(f"  {name}  {r.summary}")
    return "\n".join(out)


def wanted(path: Column, exclude: list[str] | None = None, include: list[str] | None = None) -> Column:
    """Paths that a peek shows: none that contains an ignored token; of the extensions asked for (*.py, .py and py are one), if any."""
    keep = F.lit(True)
    for token in [*IGNORED, *[x for x in exclude or [] if x]]:
        keep = keep & ~path.contains(token)
    names = [x.removeprefix("*").lstrip(".").lower() for x in include or [] if x]
    return keep & F.coalesce(extension_of(path).isin(names), F.lit(False)) if names else keep


def find_file(paths: DataFrame, name: str) -> DataFrame:
    """The first file, by depth and path, whose path is or ends in this name."""
    hit = (F.col("path") == name) | F.col("path").endswith("/" + name.lstrip("/"))
    depth = F.size(F.split("path", "/"))
    return paths.where(~F.col("is_dir") & hit).orderBy(F.col("path") != name, depth, "path").limit(1)


class PeekCache:
    """Views of folders by path and the folder's time of change, kept for `seconds` in this process."""

    def __init__(self, seconds: float = 300.0, clock=time.monotonic):
        self.seconds, self.clock = seconds, clock
        self.kept: dict[tuple[str, int], tuple[float, object]] = {}

    def get(self, folder: str, make):
        key = (folder, os.stat(folder).st_mtime_ns)
        now = self.clock()
        self.kept = {k: v for k, v in self.kept.items() if now - v[0] <= self.seconds}
        if key not in self.kept:
            self.kept[key] = (now, make())
        return self.kept[key][1]
