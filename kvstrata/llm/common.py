"""Shared pieces: the scratch folder, table reading, and the places of tokenizer files."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name under ``sf_dir``, dealt out anew if its scan has fewer tasks than there are cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()  # of a plain scan, which this does not run
    return df.repartition(cores) if tasks < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine may run without that setting; it then gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kvstrata-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it again, which cuts its lineage.

    The files outlive executors; they go when the driver's process ends or by ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kvstrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    again = spark.read.schema(df.schema).parquet(path)
    again._kvstrata_path = path
    return again


def release(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables; no later plan may read it."""
    for df in tables:
        path = getattr(df, "_kvstrata_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, if that folder exists there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH"))))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even where ``body`` uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
