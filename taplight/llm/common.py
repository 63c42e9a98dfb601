"""What the training-data operators share: the cluster's shared folder, tables written there, and text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch carries to a Python worker, whichever ends it first; one text alone may be longer.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset in local mode (tests), below a temporary folder that becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="taplight-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table in a shared folder, read again: lineage ends there and lost executors cost nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared table, or a folder of them, that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that this session sends to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier (long) and the whole text, whatever other columns there are."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))


def free_name(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` doesn't use, whatever its case."""
    return stem + "_" * (1 + max([len(c) for c in docs.columns], default=0))


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8, as it lies in the batch."""
    values = batch.column(column)
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of a text or binary column: what is made of them may be many times as large."""
    for batch in batches:
        ends = np.cumsum(np.array(pc.binary_length(batch.column(column)), np.int64))
        firsts = np.flatnonzero(np.diff(ends // size, prepend=-1)).tolist()
        for a, b in pairwise([*firsts, batch.num_rows]):
            yield batch.slice(a, b - a)


_tables: dict[str, Callable[[], None]] = {}


def holds_tables(owner: str, clear: Callable[[], None]) -> None:
    """Called by what keeps tables in a worker process, before it uses them: the tables of all others are let go.

    Workers live on from stage to stage; without this a pipeline would keep every operator's tables in each of them.
    What is let go is also given back to the system.
    """
    others = [o for o in _tables if o != owner]
    for other in others:
        _tables.pop(other)()
    _tables[owner] = clear
    if others:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
