"""Shared folder, hold-out rule and Arrow text access used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20

#: Rows that a batch between the JVM and Python holds while a table is written: texts may be long.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_current: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine serves a
    session that is this machine alone (tests); on a cluster it is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="paperweir-")
    return _own_dirs[app]


class Scratch:
    """Tables of one call in the shared folder. release() deletes these and no others; until then any executor can reread them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back: the lineage ends, and its shuffle files go at once, not when garbage is collected."""
        path = f"{shared_dir(self.spark)}/paperweir-{uuid.uuid4().hex}"
        conf = self.spark.conf
        was = {_CLEANUP: conf.get(_CLEANUP, "false"), _BATCH: conf.get(_BATCH, "10000")}
        conf.set(_CLEANUP, "true")
        conf.set(_BATCH, str(min(BATCH_ROWS, int(was[_BATCH])) if int(was[_BATCH]) > 0 else BATCH_ROWS))
        try:
            df.write.parquet(path)
        finally:
            for k, v in was.items():
                conf.set(k, v)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """For callers whose results are stored elsewhere, or that read these tables no more."""
        while self.paths:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What operators cut() inside the block belongs to the Scratch it gives. It stays when the block ends, as results are lazy:
    the caller releases it once they are stored."""
    own = Scratch(spark)
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Scratch.cut() for the scratch() block around the call; without one the table stays until the shared folder is emptied."""
    return (_current.get() or Scratch(df.sparkSession)).cut(df)


_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def trim() -> None:
    """Gives free memory back to the system. A Python worker lives on after its task, and what it keeps counts against the next."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, with trim() after each and at the end."""
    for batch in batches:
        yield batch
        del batch
        trim()


def held_out(doc_id: str | Column) -> Column:
    """Rows whose crc32 of the id's text leaves 2 on division by 4 are never learned from. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def map_text(df: DataFrame, text: str, make: Callable[[], Callable], fields: list[T.StructField], most: int = STEP_BYTES) -> DataFrame:
    """df with columns added by make()(bytes, offsets) -> list of Arrow arrays, one value per row. Streams batch by batch.

    Added columns that df already has are replaced."""
    new = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    hold = text in new
    df = df.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{text}`").alias("__text")] if hold else []))
    source, n = "__text" if hold else text, len(kept)
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in trimmed(batches):
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(source)))
            for lo, hi in steps(offsets, most):
                o = offsets[lo : hi + 1]
                added = apply(data[o[0] : o[-1]], o - o[0])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + added, names=names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from its values end to end and the number per row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)
