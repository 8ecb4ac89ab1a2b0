"""Shared pieces of the training-data operators: table reads, checkpoints, folds, bounded collects."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes that may be handed from the driver to every task (models, benchmark blocks).
BROADCAST_BYTES = 32 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def text_of(col: Column | str) -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


def unit_hash(id_col: str, seed: int = 42) -> Column:
    """A repeatable number in [0, 1) for each id: picks bounded samples without a sort."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def shared_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one that the session names, or else one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        local = sc.master.startswith("local[") or sc.master == "local"
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="tidemark-") if local else shared))


def checkpoint_dir(spark: SparkSession) -> str:
    """A new folder's path inside the checkpoint folder."""
    shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tidemark-{uuid.uuid4().hex}"


def settle() -> None:
    """Gives memory that a task no longer needs back to the system: Spark keeps its Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows, and bytes, of an Arrow batch of whole texts between Spark and its Python workers.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def short_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold at most BATCH_ROWS rows and end once they have BATCH_BYTES.

    A batch stands several times over in memory on its way: as vectors and as a message on Spark's side, in the worker, and again on its
    way back. Spark's side keeps what it once took, so with 10,000 whole rows a batch an executor's memory grows with each wide step."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a size in other units is somebody's choice
            spark.conf.set(key, str(most))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a working folder of this run that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Seconds between two looks for shuffles that nothing refers to, and when the last one was.
SWEEP, _SWEPT = 3.0, [0.0]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that all executors share, and go on from those files.

    Spark drops a shuffle's files once the driver's garbage collector has found that nothing refers to it. Operators of many short
    rounds fill the disks long before the driver needs memory, so it is asked to look, every few seconds at most."""
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    if time.monotonic() - _SWEPT[0] > SWEEP:
        settle()  # what fits on the driver have left, too
        df.sparkSession._jvm.System.gc()
        _SWEPT[0] = time.monotonic()
    return done


#: Bytes that a row of a few narrow columns takes in a broadcast table.
ROW_BYTES = 64


def small(keys: DataFrame) -> DataFrame:
    """Narrow keys to join by: broadcast if they are few enough (counted, against BROADCAST_BYTES), shuffled otherwise.

    The rows they are joined with, whole texts among them, stay where they are in the first case."""
    return F.broadcast(keys) if keys.count() * ROW_BYTES <= BROADCAST_BYTES else keys


def salted_join(left: DataFrame, right: DataFrame, met: Column, by: list[str], salts: int = 16) -> DataFrame:
    """An inner join for a left side with hot keys: the rows of one are dealt out by a hash of the columns by, and each
    narrow row of right meets all of them. met: the condition."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    spread = right.withColumn("_other_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(spread, met & (F.col("_salt") == F.col("_other_salt"))).drop("_salt", "_other_salt")
