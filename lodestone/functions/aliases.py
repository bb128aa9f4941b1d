"""SQL function names that Spark does not know, as temporary SQL functions: they stay inside Catalyst, without Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_DEG = "DEGREES({}(x))"
#: name -> (parameters, return type, body)
ALIASES: dict[str, tuple[str, str, str]] = {
    "starts_with": ("s STRING, x STRING", "BOOLEAN", "startswith(s, x)"),
    "ends_with": ("s STRING, x STRING", "BOOLEAN", "endswith(s, x)"),
    "strpos": ("s STRING, x STRING", "INT", "instr(s, x)"),
    "acosd": ("x DOUBLE", "DOUBLE", _DEG.format("ACOS")),
    "asind": ("x DOUBLE", "DOUBLE", _DEG.format("ASIN")),
    "atand": ("x DOUBLE", "DOUBLE", _DEG.format("ATAN")),
    "atan2d": ("y DOUBLE, x DOUBLE", "DOUBLE", "DEGREES(ATAN2(y, x))"),
    "cosd": ("x DOUBLE", "DOUBLE", "COS(RADIANS(x))"),
    "sind": ("x DOUBLE", "DOUBLE", "SIN(RADIANS(x))"),
    "tand": ("x DOUBLE", "DOUBLE", "TAN(RADIANS(x))"),
    "cotd": ("x DOUBLE", "DOUBLE", "COT(RADIANS(x))"),
    "bit_not": ("x BIGINT", "BIGINT", "~x"),
    "array_sum": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(filter(a, x -> x IS NOT NULL), 0D, (s, x) -> s + x)"),
    "array_mean": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(filter(a, x -> x IS NOT NULL), 0D, (s, x) -> s + x) / nullif(size(filter(a, x -> x IS NOT NULL)), 0)"),
    "strftime": ("t TIMESTAMP, f STRING", "STRING", "date_format(t, {f})"),
    "strptime": ("s STRING, f STRING", "TIMESTAMP", "try_to_timestamp(s, {f})"),
}
#: Strftime directives and the date pattern letters that mean the same.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%z": "xx", "%f": "SSSSSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss"}


def _pattern_sql() -> str:
    out = "f"
    for a, b in DIRECTIVES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _normalize(texts: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize(f or "NFC", t) for t, f in zip(texts, form, strict=True)])


#: name -> (function of columns in batches, return type): what Catalyst has no expression for.
PYTHON = {"normalize": (_normalize, "string")}


def used(sql: str) -> list[str]:
    """Aliases that a query may call."""
    return [name for name in [*ALIASES, *PYTHON] if re.search(rf"\b{name}\s*\(", sql, re.I)]


def register(session: SparkSession, names: list[str] | None = None) -> list[str]:
    """Creates the aliases (all, or some) in a session; names that Spark has are left alone."""
    names = [*ALIASES, *PYTHON] if names is None else names
    for name in names:
        if name in PYTHON:
            session.udf.register(name, F.pandas_udf(*PYTHON[name]))
            continue
        params, kind, body = ALIASES[name]
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body.replace('{f}', _pattern_sql())}")
    return names
