"""Driver loops over DataFrames: iterate to a fix-point with the lineage cut by written tables and checkpoints."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}
#: Removes an execution's shuffle files as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Who writes now, and the setting from before the first of them.
_LOCK, _WRITING = threading.Lock(), {"n": 0, "before": None}


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made meanwhile leave no shuffle files behind. What is written once needs none again."""
    with _LOCK:
        if not _WRITING["n"]:
            _WRITING["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITING["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING["n"] -= 1
            if not _WRITING["n"]:
                spark.conf.unset(CLEANUP) if _WRITING["before"] is None else spark.conf.set(CLEANUP, _WRITING["before"])


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own.

    Only a local session without either gets a temporary folder; a cluster without one fails.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tables-")
    return _LOCAL[app]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet to the shared folder.

    The plan restarts at the files, whose size Spark knows: a join broadcasts them only where they
    are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark, path = df.sparkSession, f"{shared_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def mark(df: DataFrame) -> DataFrame:
    """The state of one round, checkpointed to the shared folder: less to set up than a table."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    with _tidy(spark):
        done = df.select("*").checkpoint()  # a frame keeps the setting that it was made under
    rows = done._jdf.queryExecution().logical().rdd()
    # A checkpoint keeps the size that its plan was estimated at, and joins multiply sizes: in a loop
    # the estimate doubles its digits every round, until planning takes all time and memory. The same
    # rows as a new frame have the default size instead.
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)
    file = rows.getCheckpointFile()
    if file.isDefined():
        out._cut_path = file.get()
    return out


def forget(df: DataFrame | None) -> None:
    """Remove the files of a cut or mark that no plan needs any more."""
    if path := getattr(df, "_cut_path", None):
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str) -> DataFrame:
    """Apply ``step`` until no row has the flag ``changed``, however many rounds that takes.

    ``step`` maps the state to the next one with that boolean column; it has to come to rest, as
    values that only fall to a bound do. Every round's state is written; the one before goes.
    """
    made = None
    while True:
        new = mark(step(state))
        done = new.where(changed).isEmpty()
        forget(made)
        made, state = new, new.drop(changed)
        if done:
            return state
