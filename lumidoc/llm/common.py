"""Shared plumbing of the corpus operators: shared storage, Arrow batch limits, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import shipped

#: Rows and bytes that one Arrow batch may carry into a Python worker; bounds the worker's memory.
ARROW_ROWS = "500"
ARROW_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); unset, a local session gets one of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lumidoc-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, fewer: int = 1) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. Survives lost executors.

    fewer: for tables that are small beside what they come from, how many times fewer files than shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumidoc/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if fewer > 1:
        df = df.coalesce(max(2, shuffle_width(spark) // fewer))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts do not gather in one batch; send the package along."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker gives the memory it no longer needs back to the system.

    Workers are used again by later tasks and stages; what the allocators of Arrow and the C library keep would add up
    beside the executor's heap.
    """

    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return out


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose values in column hold about `most` bytes together; one value is never cut."""
    for batch in batches:
        sizes = [len(v) if v is not None else 0 for v in batch.column(column).cast(pa.large_binary()).to_pylist()]
        begin = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
