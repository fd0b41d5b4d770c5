"""Tables between the steps of an operator, in the folder that all executors share.

The folder is the one that the session names in spark.checkpoint.dir. Only where that is unset and Spark runs in one
process, as in tests, a temporary folder is made and set; on a cluster it must be set.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def root(spark: SparkSession) -> str:
    """The shared folder, also set as Spark's own checkpoint folder if it is not yet."""
    folder = spark.conf.get(CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gatelight-")
        spark.conf.set(CONF, folder)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Paths written in the open scopes, innermost last. Each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def last_stays(spark: SparkSession):
    """When the block ends, all tables that were written in it go but the last."""
    made: list[str] = []
    outer = _scopes.get()
    token = _scopes.set((*outer, made))
    try:
        yield
    finally:
        _scopes.reset(token)
        drop(spark, *made[:-1])
        if outer:
            outer[-1].extend(made[-1:])


@contextmanager
def all_go(spark: SparkSession):
    """When the block ends, all tables that were written in it go: for a result that the block itself stores."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        drop(spark, *made)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet and read again, and their path. This ends the lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
