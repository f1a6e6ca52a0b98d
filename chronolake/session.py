"""Session defaults, table loading and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName("chronolake")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares (``spark.checkpoint.dir``); a local one is set only where none is."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "chronolake-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage is cut and survives lost executors. What was
    written goes when the program ends, or with ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes all that ``materialize`` has written; frames that read it can't be read any more."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer pieces than there are; a large scan stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
