"""Names, modules and batches for Python workers; tables between steps are those of gatelight.sources.shared, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import gatelight
from gatelight.sources.shared import CONF, drop, last_stays, new_path, root, written

__all__ = ["CONF", "bounded_batches", "drop", "last_stays", "new_path", "root", "ship", "unused", "written"]


def unused(name: str, df: DataFrame) -> str:
    """A column name that the frame doesn't have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's modules to all Python workers, once for each application, whatever path they start with."""
    context, home = spark.sparkContext, os.path.dirname(gatelight.__file__)
    if context.applicationId in _shipped or not os.path.isdir(home):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="gatelight-"), "gatelight_modules.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("gatelight", os.path.relpath(full, home)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


#: Bytes of an Arrow batch that goes to a Python worker: rows may be long, so their number says little.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Make ready for Python workers: ship the modules, and bound the bytes of Arrow batches unless the session does."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, str(2**31 - 1), str(2**63 - 1), "2147483647b"):
        spark.conf.set(name, str(BATCH_BYTES))
