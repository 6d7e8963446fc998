"""What every operator needs from the session: shipped code and shared tables.

``ship`` sends this package to the executors and bounds Arrow batches by their bytes;
``stage`` cuts lineage by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``; ``scratched`` deletes what an operator staged and its result
doesn't read.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast at most, eight bytes each.
BROADCAST_IDS = 1_000_000

#: Bounds of an Arrow batch on its way to Python. Spark's own, 10,000 rows and 64 MB, are held several times over by an executor and its workers.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1m")}

_SHIPPED: set[str] = set()
_SCRATCH: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Make ``chunkwright`` importable in the executors, once per application; bound batches where the session keeps Spark's defaults."""
    for name, (default, bound) in BATCH_BOUNDS.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, bound)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chunkwright-code-")
    target = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, str(path.relative_to(top.parent)))
    context.addPyFile(target)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _SHIPPED.add(context.applicationId)


def release() -> None:
    """Give back to the system what this worker process has allocated and no longer uses; workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, with ``release`` at its end."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is named, one process can do with a temporary one; a cluster can't."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="chunkwright-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The copy outlives any executor, so nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for scope in _SCRATCH[-1:]:
        scope.append(path)
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one scan, whose partitions pack small files."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(t._staged_at for t in tables))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside go when the block ends, but for those given to the function it yields; so do finished steps' shuffle files."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    _SCRATCH.append(paths)
    try:
        yield keep
    finally:
        _SCRATCH.pop()
        for path in paths:
            if path not in kept:
                discard(spark, path)
        for scope in _SCRATCH[-1:]:
            scope.extend(path for path in paths if path in kept)
        gc.collect()
        spark._jvm.System.gc()


def scratched(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of the tables that a call stages, only those stay that its result reads."""

    @functools.wraps(operator)
    def run(*args, **options):
        spark = args[0].sparkSession if isinstance(args[0], DataFrame) else args[0]
        paths: list[str] = []
        _SCRATCH.append(paths)
        kept: list[str] = []
        try:
            out = operator(*args, **options)
            read = {os.path.dirname(file).rpartition("/")[2] for file in out.inputFiles()}
            kept = [path for path in paths if path.rpartition("/")[2] in read]
        finally:
            _SCRATCH.pop()
            for path in paths:
                if path not in kept:
                    discard(spark, path)
        for scope in _SCRATCH[-1:]:
            scope.extend(kept)
        return out

    return run


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and the shuffle files of finished steps."""
    for df in tables:
        discard(df.sparkSession, df._staged_at)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()  # Spark removes a shuffle's files once its plan is collected


def few(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """Ids, staged, and marked for broadcast if by count they are few enough; else Spark shuffles both sides."""
    ids = stage(ids, "ids")
    return F.broadcast(ids) if ids.count() <= bound else ids


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
