"""The library's jobs as functions with plain results, for the command line and for tool servers."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.engine import Engine
from lodestone.errors import Invalid
from lodestone.operators import export, peek, profiling, sampling
from lodestone.operators.text_index import TextIndex, leaves, line_column, parse, snippet
from lodestone.operators.vectors import VectorIndex
from lodestone.sources import files
from lodestone.sources.readers import read_any


def _rows(df: DataFrame) -> list[dict]:
    return [{c: export.plain(v) for c, v in zip(df.columns, r, strict=True)} for r in df.collect()]


def find_files(spark: SparkSession, root: str, contains: str | None = None, size: str | None = None, mtime: str | None = None, kind: str | None = None, limit: int | None = None, **options) -> list[dict]:
    """Files whose path contains a text, in the order of their paths."""
    df = files.scan(spark, root, size, mtime, kind, **options)
    if contains:
        df = df.where(files.path_contains(contains))
    return _rows(df.where(~F.col("is_dir")).orderBy("path").limit(limit or Config().limits.found_files))


def index_files(spark: SparkSession, root: str, folder: str, **options) -> dict:
    """Indexes the texts under root; (added, skipped)."""
    found = files.read_contents(files.scan(spark, root, **options).where(~F.col("is_dir")), Config().search.max_bytes)
    index = TextIndex.build(found.withColumn("modified", F.unix_seconds("modified")))
    index.save(folder)
    total = found.count()
    return {"files": total, "added": index.doc_count(), "skipped": total - index.doc_count()}


def contents_of(paths: DataFrame) -> DataFrame:
    """(path, content) of the paths that can be read now."""

    def rows(it):
        for x in it:
            stat = [os.stat(p).st_size if os.path.isfile(p) else -1 for p in x["path"]]
            yield x.assign(size=stat, is_dir=[s < 0 for s in stat], modified=pd.NaT)[["path", "size", "modified", "is_dir"]]

    return files.read_contents(paths.mapInPandas(rows, files.SCHEMA)).where("content is not null").select("path", "content")


def search_index(spark: SparkSession, folder: str, query: str, kind: str | None = None, limit: int | None = None, offset: int = 0) -> list[dict]:
    """Hits with line, column and a snippet, after the first `offset`."""
    index = TextIndex.open(spark, folder)
    node = parse(query)
    words = sorted({w for x in leaves(node) for w in x.words}) if node else []
    line, column = line_column(F.col("content"), words)
    types = files.extensions(kind) if kind else []
    hits = index.search(query, limit or Config().limits.search_hits, types[0] if len(types) == 1 else None, offset)
    hits = hits.where(F.col("file_type").isin(types)) if len(types) > 1 else hits
    return _rows(hits.select("path", "score", line.alias("line"), column.alias("column"), snippet(F.col("content"), words).alias("snippet")).orderBy(F.desc("score"), "path"))


def semantic_texts(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """(path, content): valid UTF-8 up to 1 MiB that is not blank, the first files by path."""
    texts = files.read_contents(files.scan(spark, root, size="<1048577"), 1 << 20).where("content is not null and trim(content) <> '' and not contains(content, '�')")
    return texts.orderBy("path").limit(most or Config().search.semantic_files).select("path", "content")


def semantic_search(spark: SparkSession, root: str, query: str, encode: Callable[[list[str]], list[list[float]]] | None = None, limit: int | None = None) -> list[dict]:
    """Nearest texts by an encoder, as operators.encoder makes one from model files (a hashing one without); the order is that of the scores."""
    cfg = Config().search
    encode = encode or hashing_encoder()
    texts = semantic_texts(spark, root)

    def batches(it):
        for x in it:
            yield x[["path"]].assign(embedding=encode(x["content"].tolist()))

    vectors = texts.mapInPandas(batches, "path string, embedding array<double>")
    return _rows(VectorIndex(vectors, "path").search(encode([query])[0], limit or cfg.semantic_limit).select("path", "score"))


def hashing_encoder(width: int = 384) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors of hashed words: a stand-in where no model file is at hand."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % width] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return encode


def get_schema(spark: SparkSession, path: str) -> dict:
    df = read_any(spark, path)
    rows = _rows(profiling.schema_summary(df))
    return {"rows": rows[0]["rows"] if rows else df.count(), "columns": [{k: v for k, v in r.items() if k != "rows"} for r in rows], "with_missing": sum(r["nullable"] for r in rows), "duplicates": profiling.duplicate_rows(df).first()[0]}


def query_data(spark: SparkSession, path: str, sql: str, limit: int | None = None) -> list[dict]:
    engine = Engine(spark)
    engine.open(path)
    return _rows(engine.sql(sql, limit or Config().limits.query_rows))


def sample_data(spark: SparkSession, path: str, n: int | None = None, how: str = "smart", seed: int | None = None) -> list[dict]:
    return _rows(sampling.sample(read_any(spark, path), how, Config().limits.sample_rows if n is None else n, seed=seed))


def quality_check(spark: SparkSession, path: str) -> dict:
    df = read_any(spark, path)
    return {
        "rows": df.count(),
        "missing": _rows(profiling.missing_values(df)),
        "duplicates": profiling.duplicate_rows(df).first()[0],
        "outliers": _rows(profiling.outlier_summary(df, first=5)),
        "suggestions": _rows(profiling.suggestions(df)),
    }


def get_config(key: str | None = None) -> object:
    config = Config.load()
    return config.get(key) if key else json.loads(json.dumps(config, default=lambda x: x.__dict__))


_PEEKS = peek.PeekCache()


def peek_folder(spark: SparkSession, root: str, depth: int = 5, style: str = "json", exclude: list[str] | None = None, include: list[str] | None = None) -> str:
    """The view of a folder, kept for some minutes while the folder does not change."""
    key = f"{depth} {style} {exclude} {include}"
    made = _PEEKS.get(root, dict)
    if key not in made:
        made[key] = _peek_folder(spark, root, depth, style, exclude, include)
    return made[key]


def peek_file(spark: SparkSession, root: str, name: str) -> dict | None:
    """The view of one file: of that path, else the first under root that has this name."""
    hit = files.read_contents(peek.find_file(files.scan(spark, root, depth=5), name))
    rows = hit.select("path", "size", peek.kind_of(F.col("path")).alias("kind"), peek.preview(F.coalesce("content", F.lit(""))).alias("preview"))
    return next(iter(_rows(rows)), None)


def _peek_folder(spark: SparkSession, root: str, depth: int, style: str, exclude: list[str] | None, include: list[str] | None) -> str:
    inside = F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))
    found = files.scan(spark, root, depth=depth).where(peek.wanted(inside, exclude, include))
    view = peek.peek(files.read_contents(found))
    return peek.markdown(view) if style == "md" else peek.tree(view) if style == "tree" else json.dumps(_rows(view.orderBy("path")), ensure_ascii=False)


#: What a tool server offers: name -> (function, what it does).
TOOLS: dict[str, tuple[Callable, str]] = {
    "find_files": (find_files, "files by path, size, time and type"),
    "search_index": (search_index, "full-text search in an index folder"),
    "get_schema": (get_schema, "columns, types, missing values and duplicates of a csv or parquet file"),
    "query_data": (query_data, "SQL over a file, called by its stem or `this`"),
    "sample_data": (sample_data, "head, tail, random or evenly spaced rows"),
    "quality_check": (quality_check, "missing values, duplicates, outliers, suggestions"),
    "get_config": (get_config, "settings"),
}


def describe_tools() -> list[dict]:
    """The tools as JSON descriptions."""
    import inspect

    out = []
    for name, (f, text) in TOOLS.items():
        params = {k: {"type": "integer" if k in ("n", "limit", "seed") else "string"} for k, p in inspect.signature(f).parameters.items() if k != "spark" and p.kind != p.VAR_KEYWORD}
        needed = [k for k, p in inspect.signature(f).parameters.items() if k in params and p.default is p.empty]
        out.append({"name": name, "description": text, "parameters": {"type": "object", "properties": params, "required": needed}})
    return out


def init_text(kind: str, name: str = "lodestone") -> str:
    """How an agent is told of the tools: mcp, openai or openapi as JSON, langchain as code, gpt and claude as a prompt."""
    found = describe_tools()
    if kind == "mcp":
        return json.dumps({"tool": name, "commands": {t["name"]: t["description"] for t in found}, "errors": {"retry": ["IndexFailed", "TimedOut"], "fatal": ["NotFound", "UnsupportedFormat", "QueryError", "NotPermitted"]}, "formats": ["csv", "parquet"]}, indent=2)
    if kind == "openai":
        return json.dumps([{"type": "function", "function": t} for t in found], indent=2)
    if kind == "openapi":
        paths = {f"/{t['name']}": {"post": {"operationId": t["name"], "summary": t["description"], "requestBody": {"content": {"application/json": {"schema": t["parameters"]}}}, "responses": {"200": {"description": "the result"}}}} for t in found}
        return json.dumps({"openapi": "3.0.0", "info": {"title": name, "version": "1"}, "paths": paths}, indent=2)
    if kind == "langchain":
        made = "\n".join(f"    StructuredTool.from_function(lambda f=tools.{t['name']}, **given: f(spark, **given), name={t['name']!r}, description={t['description']!r})," for t in found)
        return f"from langchain_core.tools import StructuredTool\nfrom {name} import tools\nfrom {name}.session import get_session\n\nspark = get_session()\nTOOLS = [\n{made}\n]\n"
    if kind in ("gpt", "claude"):
        lines = [f"- {t['name']}({', '.join(t['parameters']['properties'])}): {t['description']}" for t in found]
        head = "You can look into files with these tools. Ask for the schema before you write SQL; in SQL the file is called `this`. Sample before you read."
        return "\n".join([f"<tools>\n{head}" if kind == "claude" else head, *lines, *(["</tools>"] if kind == "claude" else [])])
    raise Invalid(f"no such form: {kind}", "mcp, openai, openapi, langchain, gpt, claude")
