"""A folder for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from kvstrata.sources.manifest import Files

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted when the driver's process ends.

    Only a session on one machine may run without that setting; its folder is temporary.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kvstrata-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/kvstrata/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            Files(spark).delete(path)
        except Exception:  # the session has ended
            return
