"""What the operators of this subpackage share: tables, shared storage, id filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and all run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not found:
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidesmith-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def rows_by_batch(batches: Iterable[pa.RecordBatch], most_bytes: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a piece holds about `most_bytes` of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = offsets(batch.column(column))[0]
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or sizes[i + 1] - sizes[start] > most_bytes:
                yield batch.slice(start, i - start)
                start = i


def by_arrow(df: DataFrame, run, results: list[T.StructField]) -> DataFrame:
    """mapInArrow for columns of any name, such as a.b or one with a backtick, which mapInArrow itself does not take."""
    names = df.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(pa.RecordBatch.from_arrays(x.columns, names=names) for x in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=places)

    places = [f"c{i}" for i in range(len(results))]
    kinds = T.StructType([T.StructField(p, f.dataType) for p, f in zip(places, results, strict=True)])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(slim(whole), kinds).toDF(*(f.name for f in results))


def slim(run):
    """A batch function that hands free memory back to the system when its task ends: workers live on and would keep it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def offsets(texts: pa.Array):
    """(byte offsets, bytes) of a string column as numpy arrays; null counts as empty."""
    import numpy as np

    a = texts.cast(pa.large_binary())
    _, off, data = a.buffers()
    at = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return at, (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))
