"""Shared helpers of the training-data operators: inputs, shared scratch space, Arrow workers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: words are maximal runs of anything else.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local session without one has one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    sc = spark.sparkContext
    if (have := sc._jsc.sc().getCheckpointDir()).isDefined():
        return have.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(own := "file://" + tempfile.mkdtemp(prefix="loomfield-"))
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables written by ``keep`` and not deleted yet, with their owner, by application.
_KEPT: dict[str, list[tuple[str, str]]] = {}
_OWNER: ContextVar[str] = ContextVar("owner", default="")


@contextlib.contextmanager
def owner(name: str) -> Iterator[None]:
    """Tables kept inside belong to ``name``, so that ``release`` leaves all others alone."""
    token = _OWNER.set(name)
    try:
        yield
    finally:
        _OWNER.reset(token)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, has true sizes.

    Spark decides on broadcasting the reread table from the size of its files.  ``release`` deletes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append((path, _OWNER.get()))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (ids, hashes, counts) that may be sent to all executors: some megabytes.
FEW_ROWS = 200_000


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df``, a kept narrow table, marked for a broadcast if it has few rows; joins shuffle it else."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession, name: str, *still: DataFrame) -> None:
    """Delete the tables that ``keep`` has written for the owner ``name``, but for those that ``still`` reads.

    For use once results that are computed from them have been written.
    """
    _forget(spark, lambda path, by, names: by == name and path.rsplit("/", 1)[-1] not in names, *still)


def drop(df: DataFrame) -> None:
    """Delete one table that ``keep`` has written, when what is computed from it has been written as well."""
    _forget(df.sparkSession, lambda path, by, names: path.rsplit("/", 1)[-1] in names, df)


def _forget(spark: SparkSession, gone: Callable[[str, str, set[str]], bool], *read: DataFrame) -> None:
    folders = {part for df in read for f in df.inputFiles() for part in f.split("/")[:-1]}
    mine = _KEPT.get(spark.sparkContext.applicationId, [])
    for path, by in [x for x in mine if gone(*x, folders)]:
        delete(spark, path)
        mine.remove((path, by))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, so that inputs may bring any extra columns."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a worker that waits for its next task gives free memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Bytes of text that a kernel has as Python objects at once.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, at: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of at most so many bytes in column ``at``, of one row at least.

    Batches grow with the input up to Spark's ten thousand rows; what is made of a slice doesn't.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        yield batch.slice(k, end - k)
        k = end


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()

