"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that end a word: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"

_OWNED: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once per row.

    A column named inside a lambda may be inlined by the optimizer and then be
    computed for each element; a lambda's own variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; if that is unset, one in the warehouse, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_leafline"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    This cuts the lineage: later stages recover from the written files, and not
    by a new run of all that came before. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _OWNED:  # registered after the session, so it runs before the session's own end
        atexit.unregister(discard)
        atexit.register(discard)
    _OWNED[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*paths: str) -> None:
    """Deletes tables written by :func:`materialize`."""
    for path in paths or list(_OWNED):
        spark = _OWNED.pop(path, None)
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session has ended; the cluster's own clean-up of the folder takes over
            pass


def settle(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``build`` as a written table; the tables that it wrote on its way are deleted."""
    before = set(_OWNED)
    out = materialize(build(), name)
    if gone := set(_OWNED) - before - {out.written_to}:
        discard(*gone)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 16 MB, so that long texts don't pile up in a Python worker.

    Also lets local Python workers find this package wherever the driver was started.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files give under a quarter of that, as one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() < cores else df


def tidy(run: Callable) -> Callable:
    """``run`` over Arrow batches; what it leaves unused goes back to the system when a task ends, as workers live on and executors have a limit."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add, in any case of letters."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])
