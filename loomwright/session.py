"""Session helpers that every layer shares: table access, shipped code, shared scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: Bytes of a batch that a Python worker is sent.
BATCH_BYTES, SLICE_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, bytes_a_core: int = 32 << 20, bytes_a_task: int = 16 << 20) -> DataFrame:
    """df over all cores where it is too small to have a split for each (one row group is read by one
    task), and in tasks of about bytes_a_task by the planner's size where the splits are larger: texts
    cost far more to work on than to deal anew, and large tasks leave cores idle. Rows are dealt by
    the hash of the first column, the key. An input in small splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * bytes_a_core:
        return df.repartition(cores)
    n = -(-size // bytes_a_task)
    return df if df._jdf.rdd().getNumPartitions() >= n else df.repartition(n, df.columns[0])


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the few Python operators."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "loomwright.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and the next stage needs it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with the package shipped to the executors, in batches of SLICE_BYTES or so: a
    worker's memory does not follow the size of its task."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set(BATCH_BYTES, SLICE_BYTES)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session names it in spark.checkpoint.dir;
    where it is unset on one machine (tests) a temporary folder is set, on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_SCRATCH: list[list[str]] = []  # of the open scratch() blocks, the paths written in each


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor
    costs only the tasks that were running on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwright_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; one that is gone already is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    remove(df.sparkSession, df._loomwright_path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that materialize() wrote inside the block when it ends; what is returned
    from them must have been written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)
