"""Session helpers: table loading, shared scratch tables, worker environment."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of the batches that Python workers get, so that long texts do not come by the thousand. A task holds some batches
#: on either side, outside Spark's heap.
BATCH_BYTES = 2 << 20
#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scratch tables written and not removed, one list for each open scope of this thread (or task of its context).
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table of that name below a data folder (any path that Spark can open)."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table just read, dealt anew if it comes in fewer splits than the cluster has cores.

    Files that cannot be split would leave cores idle in work that is heavy for each row; tables of many
    splits are returned as they are. Only for scans: counting the splits of other plans may run them.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share, from spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the application's id; two calls never give the same one."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, for the end of a session or of a batch of queries whose results have
    been read or written. Frames that read scratch tables are void from then on."""
    remove(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation. Returns the
    reread frame and its path, for remove(). The shuffle files of the plan go when the table is written; else they stay
    until the driver collects garbage, and those of many steps pile up.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for scope in _scopes.get()[-1:]:
        scope.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system layer, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for scope in _scopes.get():
        if path in scope:
            scope.remove(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end every scratch table written within by this thread, but for the paths put into the yielded list.

    Frames that read the removed tables are void then, so what a caller gets back must read kept ones only; these belong to the
    scope around, if there is one. After an exception nothing is kept.
    """
    own: list[str] = []
    keep: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    failed = True
    try:
        yield keep
        failed = False
    finally:
        _scopes.reset(token)
        for path in list(own):
            if failed or path not in keep:
                remove(spark, path)
            elif _scopes.get():
                _scopes.get()[-1].append(path)


def expose_package(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver found it by sys.path alone, and get batches of at
    most BATCH_BYTES, unless the session has a bound of its own. Both settings of the session stay for good."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == "67108864b":
        spark.conf.set(bound, str(BATCH_BYTES))
