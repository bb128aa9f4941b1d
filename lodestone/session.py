"""Session factory: adaptive execution on, UTC, sizes that follow the cores unless the caller sets them."""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import ConfigError


def get_session(master: str | None = None, app: str = "lodestone", **conf: str) -> SparkSession:
    cores = os.cpu_count() or 8
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the one that spark.checkpoint.dir names, which all executors see. Where that is unset a folder of this machine serves, which is
    right for local sessions only: a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("a cluster needs spark.checkpoint.dir", "name a folder that all executors see")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, partition by partition: they survive the loss of executors, and stay in their partitions."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes in fewer partitions than there are (one file of one row group is one task, however heavy its rows are)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lodestone-")


def share_code(spark: SparkSession) -> None:
    """Lets Python workers find this package where the session began in another folder; a cluster is given the package by spark.submit.pyFiles as usual."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
