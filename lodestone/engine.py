"""SQL over registered tables, in a session of its own."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import QueryError
from lodestone.functions import aliases
from lodestone.plans.dialect import rewrite, typo_hint
from lodestone.session import shared_folder
from lodestone.sources.readers import CsvOptions, read_any, read_arrow, read_csv, read_parquet


def table_name(path: str) -> str:
    """The stem of a file, or `this`."""
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[0] or name or "this"


class Engine:
    """Tables by name; a table from a file is also called `this` (the last one registered). Queries are lazy DataFrames."""

    def __init__(self, spark: SparkSession):
        self.session = spark.newSession()
        for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
            if (v := spark.conf.get(k, None)) is not None:
                self.session.conf.set(k, v)
        self.functions: set[str] = set()
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, source: str | DataFrame, options: CsvOptions | None = None) -> DataFrame:
        """A table from a file or a frame; an earlier one by the name is replaced."""
        df = read_any(self.session, source, options=options) if isinstance(source, str) else self._own(source)
        self.tables[name] = df
        df.createOrReplaceTempView(f"`{name}`" if not re.fullmatch(r"\w+", name) else name)
        return df

    def _own(self, df: DataFrame) -> DataFrame:
        """The same logical plan under this engine's session."""
        if df.sparkSession is self.session:
            return df
        rows = self.session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, df._jdf.logicalPlan())
        return DataFrame(rows, self.session)

    def open(self, path: str, options: CsvOptions | None = None) -> DataFrame:
        """Registers a file under its stem and as `this`."""
        df = self.register(table_name(path), path, options)
        return self.register("this", df)

    def sql(self, query: str, limit: int | None = None) -> DataFrame:
        """The result of a query; limit goes into the plan. CREATE TABLE ... AS, DROP TABLE, TRUNCATE TABLE, SHOW TABLES and EXPLAIN act on this engine's tables."""
        self._define(query)
        try:
            df = self._statement(query)
            df = self._select(query) if df is None else df
        except (ParseException, AnalysisException) as e:
            raise self._refused(query, e) from e
        return df if limit is None else df.limit(limit)

    def _statement(self, query: str) -> DataFrame | None:
        """What a statement on tables gives; None for queries."""
        text = query.strip().rstrip(";")
        if m := re.fullmatch(r"CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(\w+)\s+AS\s+(.+)", text, re.I | re.S):
            if m[2] in self.tables and not m[1]:
                raise QueryError(f"there is a table {m[2]}")
            self.register(m[2], self._kept(self._select(m[3])))
            return self._told(m[2])
        if m := re.fullmatch(r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(\w+)", text, re.I):
            if self.tables.pop(m[2], None) is None and not m[1]:
                raise QueryError(f"no table {m[2]}")
            self.session.catalog.dropTempView(m[2])
            return self._told(m[2])
        if m := re.fullmatch(r"TRUNCATE\s+TABLE\s+(\w+)", text, re.I):
            if m[1] not in self.tables:
                raise QueryError(f"no table {m[1]}")
            self.register(m[1], self.tables[m[1]].limit(0))
            return self._told(m[1])
        if m := re.fullmatch(r"EXPLAIN\s+(?:(FORMATTED|EXTENDED|COST|CODEGEN)\s+)?(?=SELECT|WITH|\()(.+)", text, re.I | re.S):
            return self.session.createDataFrame([(self.explain(m[2], (m[1] or "formatted").lower()),)], "plan string")
        if re.fullmatch(r"SHOW\s+TABLES", text, re.I):
            return self.session.createDataFrame([(x,) for x in self.names()], "name string")
        return None

    def _kept(self, df: DataFrame) -> DataFrame:
        """The rows as they are now, as a table in the shared folder: later changes of the sources do not show."""
        path = f"{shared_folder(self.session, 'tables')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.session.read.schema(df.schema).parquet(path)

    def _told(self, name: str) -> DataFrame:
        return self.session.createDataFrame([(name,)], "name string")

    def _select(self, query: str) -> DataFrame:
        return self.session.sql(self._text(query))

    def _text(self, query: str) -> str:
        """The query as Spark reads it."""
        return rewrite(query, self._columns, self._table)

    def _columns(self, query: str) -> list[str]:
        """Columns of a query, by Spark's analyser; nothing runs."""
        return self.session.sql(query).columns

    def _table(self, kind: str, paths: list[str], options: dict[str, str]) -> str:
        """A view of files that a query names, with the options of their reader."""
        frames = [self._file(kind, p, options) for p in paths]
        df = frames[0]
        for x in frames[1:]:
            df = df.unionByName(x, allowMissingColumns=True)
        name = "__files_" + hashlib.md5(repr((kind, paths, sorted(options.items()))).encode()).hexdigest()[:16]
        df.createOrReplaceTempView(name)
        return name

    def _file(self, kind: str, path: str, options: dict[str, str]) -> DataFrame:
        known = {"csv": {"header", "has_header", "sep", "delim", "separator", "skip", "skip_rows"}, "json": {"multiline"}}.get(kind, set())
        if unknown := options.keys() - known:
            raise QueryError(f"read_{kind} has no option {min(unknown)}")
        yes = lambda *names: next((options[n].strip().lower() in ("true", "1") for n in names if n in options), None)
        if kind == "csv":
            header, sep = yes("header", "has_header"), next((options[n] for n in ("sep", "delim", "separator") if n in options), ",")
            skip = next((options[n] for n in ("skip", "skip_rows") if n in options), "0")
            if not skip.isdigit():
                raise QueryError(f"no number of rows to skip: {skip}")
            return read_csv(self.session, path, CsvOptions(header=header is not False, separator=sep, skip_rows=int(skip)))
        if kind == "json":
            return self.session.read.option("multiLine", bool(yes("multiline"))).json(path)
        return read_parquet(self.session, path) if kind == "parquet" else read_arrow(self.session, path)

    def _define(self, query: str) -> None:
        """Function aliases are created when a query first calls them."""
        new = [x for x in aliases.used(query) if x not in self.functions]
        self.functions.update(aliases.register(self.session, new))

    def explain(self, query: str, mode: str = "formatted") -> str:
        self._define(query)
        try:
            plan = self._select(query)._jdf.queryExecution()
        except (ParseException, AnalysisException) as e:
            raise self._refused(query, e) from e
        return plan.explainString(self.session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    @staticmethod
    def _refused(query: str, e: Exception) -> QueryError:
        hint = typo_hint(query)
        return QueryError(next((x.strip() for x in str(e).splitlines() if x.strip()), type(e).__name__), hint[0] if hint else None)

    def names(self) -> list[str]:
        return sorted(self.tables)
