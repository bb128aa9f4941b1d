"""Readers of files by their extension."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import NotFound, UnsupportedFormat

#: A pattern that no date has: strings that look like times stay strings.
_NEVER = "'no such time'"


@dataclass(frozen=True)
class CsvOptions:
    header: bool = True
    separator: str = ","
    skip_rows: int = 0
    mode: str = "FAILFAST"
    sample: float = 1.0


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a path, in whatever store it names?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None, schema: str | None = None) -> DataFrame:
    """CSV with inferred numbers and booleans; integers are bigint, times stay strings. Options hold for files of any size."""
    o = options or CsvOptions()
    if not exists(spark, path):
        raise NotFound(f"no such file: {path}")
    reader = spark.read.options(header=o.header, sep=o.separator, mode=o.mode, enforceSchema=False, samplingRatio=o.sample, timestampFormat=_NEVER, dateFormat=_NEVER, timestampNTZFormat=_NEVER, prefersDate=False)
    if o.skip_rows:
        return _skipped(spark, path, o, schema)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if schema:
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`") for f in df.schema])


def _skipped(spark: SparkSession, path: str, o: CsvOptions, schema: str | None) -> DataFrame:
    """Without the first lines of each file (they must be in its first block), then the header if there is one. Nothing is sorted; kinds of columns are
    inferred in one more pass over the fields."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    drop = o.skip_rows + (1 if o.header else 0)
    # numbers go up by one inside a block; of a file's first block the lowest is that of its first line
    first = lines.where("block = 0").groupBy("f").agg(F.min("n").alias("n0"))
    numbered = lines.join(F.broadcast(first), "f").withColumn("k", F.when(F.col("block") == 0, F.col("n") - F.col("n0")))
    names = [r.value for r in numbered.where(F.col("k") == o.skip_rows).orderBy("f").limit(1).select("value").collect()]
    width = len(next(csv.reader(names, delimiter=o.separator))) if names else 0
    columns = next(csv.reader(names, delimiter=o.separator)) if names and o.header else [f"_c{k}" for k in range(width)]
    if not columns:
        return spark.createDataFrame([], schema or "value string")
    body = numbered.where((F.col("k") >= drop) | F.col("k").isNull()).select("value")
    text = ", ".join(f"`{c}` string" for c in columns)
    rows = body.select(F.from_csv("value", text, {"sep": o.separator, "mode": o.mode}).alias("x")).select("x.*")
    if schema:
        kinds = T.StructType.fromDDL(schema)
        return rows.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(columns, kinds, strict=True)])
    return _inferred(rows)


def _inferred(rows: DataFrame) -> DataFrame:
    """Columns of strings as bigint, double or boolean where every value reads as one."""
    aggs = []
    for k, c in enumerate(rows.columns):
        v = F.col(f"`{c}`")
        for name, kind in (("i", "bigint"), ("d", "double"), ("b", "boolean")):
            aggs.append(F.count(F.when(v.isNotNull() & v.try_cast(kind).isNull(), 1)).alias(f"{name}{k}"))
        aggs.append(F.count(v).alias(f"n{k}"))
    bad = rows.agg(*aggs).first()
    kinds = [next((t for n, t in (("i", "bigint"), ("d", "double"), ("b", "boolean")) if bad[f"n{k}"] and not bad[f"{n}{k}"]), "string") for k in range(len(rows.columns))]
    return rows.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(rows.columns, kinds, strict=True)])


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (one, or all *.arrow of a folder), each read by a task."""
    import glob

    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    paths = sorted(glob.glob(f"{path}/*.arrow")) if os.path.isdir(path) else [path]
    if not paths or not os.path.exists(paths[0]):
        raise NotFound(f"no such file: {path}")
    with pa.OSFile(paths[0]) as f:
        schema = from_arrow_schema(pa.ipc.open_file(f).schema)

    def rows(it):
        for x in it:
            for p in x.column(0).to_pylist():
                with pa.memory_map(p) as f:
                    r = pa.ipc.open_file(f)
                    for k in range(r.num_record_batches):
                        yield r.get_batch(k)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(rows, schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise NotFound(f"no such file: {path}")
    return spark.read.parquet(path)


def extension(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def read_any(spark: SparkSession, path: str, strict: bool = True, options: CsvOptions | None = None) -> DataFrame:
    """csv and parquet; json, jsonl and orc too unless strict."""
    kind = extension(path)
    if kind == "csv":
        return read_csv(spark, path, options)
    if kind == "parquet":
        return read_parquet(spark, path)
    if not strict and kind in ("json", "jsonl", "ndjson", "orc"):
        return spark.read.orc(path) if kind == "orc" else spark.read.option("multiLine", kind == "json").json(path)
    raise UnsupportedFormat(f"unsupported format: {kind or path}")
