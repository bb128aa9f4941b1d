"""Sinks: csv, JSON Lines, parquet, Arrow; standard output; previews and text tables."""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import ExportError
from lodestone.session import share_code
from lodestone.sources.arrow_sink import ArrowSink
from lodestone.sources.readers import extension, read_any

FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "arrow": "arrow", "ipc": "arrow"}


@dataclass(frozen=True)
class ExportOptions:
    format: str | None = None
    header: bool = True
    separator: str = ","
    compression: str = "none"
    single: bool = False
    mode: str = "errorifexists"


def format_of(path: str, given: str | None = None) -> str:
    """The given format, else that of the extension."""
    kind = FORMATS.get((given or extension(path)).lower())
    if kind is None or (given and given.lower() not in ("csv", "json", "parquet", "arrow")):
        raise ExportError(f"unknown export format: {given or path}")
    return kind


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested values: they become JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def export(df: DataFrame, path: str, options: ExportOptions | None = None) -> int:
    """Writes df and returns the bytes written. A folder of parts that all tasks write, or one file if options.single."""
    o = options or ExportOptions()
    kind = format_of(path, o.format)
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if kind == "arrow" and o.mode == "errorifexists" and not o.single and fs.exists(target):
        raise ExportError(f"exists: {path}")
    to = f"{path}.tmp-{uuid.uuid4().hex}" if o.single else path
    rows = df.coalesce(1) if o.single else df
    writer = (_flat(rows) if kind == "csv" else rows).write.mode("errorifexists" if o.single else o.mode)
    if kind == "csv":
        writer.options(header=o.header, sep=o.separator, escape='"').csv(to)
    elif kind == "json":
        writer.options(ignoreNullFields=False).json(to)
    elif kind == "arrow":
        share_code(spark)
        for session in (spark, SparkSession.getActiveSession() or spark):  # Spark looks sources up in the active one, which may be an engine's
            session.dataSource.register(ArrowSink)
        rows.write.format(ArrowSink.name()).mode("overwrite" if o.mode == "overwrite" else "append").option("path", to).save()
    else:
        writer.option("compression", {"none": "uncompressed"}.get(o.compression, o.compression)).parquet(to)
    if not o.single:
        return int(fs.getContentSummary(target).getLength())
    parts = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(to)) if s.getPath().getName().startswith("part-")]
    if fs.exists(target):
        if o.mode != "overwrite":
            fs.delete(jvm.org.apache.hadoop.fs.Path(to), True)
            raise ExportError(f"exists: {path}")
        fs.delete(target, True)
    if parts:
        fs.rename(parts[0], target)
    else:
        fs.create(target).close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(to), True)
    return int(fs.getFileStatus(target).getLen())


def convert(spark: SparkSession, source: str, target: str, options: ExportOptions | None = None) -> int:
    return export(read_any(spark, source), target, options)


def plain(value: object) -> object:
    """A cell for JSON: times as ISO 8601, rows as objects."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, bytes | bytearray):
        return bytes(value).decode("utf-8", "replace")
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def json_objects(df: DataFrame) -> DataFrame:
    """(json): each row as an object, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def lines(df: DataFrame, kind: str = "csv", header: bool = True, separator: str = ",") -> Iterator[str]:
    """Rows as lines of csv (quoted where needed) or JSON, without gathering them."""
    if kind not in ("csv", "json"):
        raise ExportError(f"standard output takes csv and json, not {kind}")

    def line(cells: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=separator, lineterminator="").writerow(cells)
        return out.getvalue()

    if kind == "csv" and header:
        yield line(df.columns)
    for r in df.toLocalIterator():
        if kind == "json":
            yield json.dumps({c: plain(v) for c, v in zip(df.columns, r, strict=True)}, ensure_ascii=False)
        else:
            yield line(["" if v is None else json.dumps(plain(v)) if isinstance(v, list | dict | Row) else plain(v) for v in r])


def to_stdout(df: DataFrame, kind: str = "csv", **options) -> None:
    for x in lines(df, kind, **options):
        sys.stdout.write(x + "\n")


def render(df: DataFrame, rows: int = 100, width: int = 50) -> str:
    """A text table of the first rows: floats with two digits, long strings cut by characters."""
    found = df.limit(rows + 1).collect()

    def cell(v: object) -> str:
        if v is None:
            return "null"
        s = f"{v:.2f}" if isinstance(v, float) else json.dumps(plain(v), ensure_ascii=False) if isinstance(v, list | dict | Row) else str(plain(v))
        return s if len(s) <= width else s[: width - 3] + "..."

    table = [df.columns] + [[cell(v) for v in r] for r in found[:rows]]
    size = [max(len(r[k]) for r in table) for k in range(len(df.columns))]
    out = [" | ".join(c.ljust(n) for c, n in zip(r, size, strict=True)).rstrip() for r in table]
    out.insert(1, "-+-".join("-" * n for n in size))
    if len(found) > rows:
        out.append(f"... first {rows} rows")
    return "\n".join(out)


def preview(df: DataFrame, rows: int = 10) -> dict:
    return {"rows": df.count(), "columns": len(df.columns), "head": df.limit(rows).collect()}


def preview_json(text: str, rows: int = 10) -> list[list[str]]:
    """A JSON document as a small table: objects by the keys of the first, scalars one each, an object's first 20 fields."""
    value = json.loads(text)
    if isinstance(value, list):
        if value and isinstance(value[0], dict):
            keys = list(value[0])
            return [keys] + [[json.dumps(x.get(k), ensure_ascii=False) if isinstance(x, dict) else "" for k in keys] for x in value[:rows]]
        return [[json.dumps(x, ensure_ascii=False)] for x in value[:rows]]
    if isinstance(value, dict):
        return [[k, json.dumps(v, ensure_ascii=False)] for k, v in list(value.items())[:20]]
    return [[json.dumps(value, ensure_ascii=False)]]
