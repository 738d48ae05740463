"""What the operators share: table reading, Arrow text mapping, stable hashes, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: they bound what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable by Python workers and bound their batches by rows and bytes.

    Of the session's settings only those of Arrow batches change, and only to smaller ones.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` or the context's; local sessions without one get a temporary folder.

    A cluster without one fails: executors could not read what the driver's machine holds.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder
    if not (folder := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables beside the checkpoints."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder in ``spark.checkpoint.dir``, which all executors share."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def checkpoint_round(df: DataFrame) -> DataFrame:
    """The same for the state of a loop's round."""
    done, spark = checkpoint(df), df.sparkSession
    # A checkpoint keeps the size that its plan was estimated at, and joins multiply sizes: in a loop
    # the estimate doubles its digits every round, until planning takes all time and memory. The same
    # rows as a new frame have the default size instead.
    rows = done._jdf.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


#: Ids and bytes of ids that a broadcast may hold; beyond that the join shuffles.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 16 << 20


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` with (or, by ``left_anti``, without) the distinct keys ``ids``.

    The keys are counted and measured first: only a bounded number of bytes is broadcast, so wide
    rows need no shuffle where few keys are wanted; else both sides are shuffled. ``ids`` should be
    checkpointed.
    """
    n, size = ids.limit(BROADCAST_IDS + 1).agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")) + 8)).first()
    few = n <= BROADCAST_IDS and (size or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(ids) if few else ids, key, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (inputs may bring clashing columns)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_row_per_key(df: DataFrame, key: str, least: Sequence[str]) -> DataFrame:
    """Of rows that repeat a key the one of least ``least``, so samples do not depend on the order of tasks."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*least)).alias("_row"))
    return first.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def hash_order(*cols: str | Column, seed: int = 0) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), *cols)


def sound(text: bytes) -> bytes:
    """The text as UTF-8: each byte that is not becomes U+FFFD, as a decoder that replaces would."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def slices(sizes: Sequence[int], most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Neighbouring rows of at most ``most`` bytes together, a larger one alone."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if len(sizes) > start else out


def map_texts(
    df: DataFrame, keys: Sequence[str], text: str, worker: Callable[[], Callable], fields: pa.Schema, also: Sequence[str] = ()
) -> DataFrame:
    """``keys`` and the columns ``fields`` that a worker makes of each batch's texts.

    ``worker()`` runs once per task and returns a function from a list of UTF-8 texts (and one
    list for each column of ``also``) to one list or array per field. Null texts count as empty,
    bytes that are not UTF-8 as U+FFFD each. A batch is worked on in slices of BATCH_BYTES, so a
    worker holds one slice or one longer text at a time. ``fields`` may not clash with ``keys``.
    """
    keep = list(keys)
    names = [f"_k{i}" for i in range(len(keep))]  # whatever the input's columns are called
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], *[F.col(k).alias(f"_a{i}") for i, k in enumerate(also)], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_t"))

    def run(batches):
        work = worker()
        for whole in batches:
            for lo, hi in slices(pa.compute.binary_length(whole.column("_t")).to_pylist()):
                b = whole.slice(lo, hi - lo)
                made = work([sound(t) for t in b.column("_t").to_pylist()], *[b.column(f"_a{i}").to_pylist() for i in range(len(also))])
                arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(made, fields)]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], *arrays], [*names, *[f"_f{i}" for i in range(len(fields))]])
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import from_arrow_schema

    made = from_arrow_schema(fields)
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)], *[T.StructField(f"_f{i}", f.dataType) for i, f in enumerate(made)]])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], *[F.col(f"_f{i}").alias(f.name) for i, f in enumerate(made)])


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser, on uint64 (wraps)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
