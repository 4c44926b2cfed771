"""What the corpus operators share: the shared folder, tables cut from their lineage, words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
DEFAULT_SHARED_DIR = "file:///tmp/checkpoints"

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same ones.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE_SQL = r"[\x20\x09-\x0D]+"


TRIM_SECONDS = 1.0
#: Bytes of an Arrow batch: whole texts lie in it on both sides, the JVM's and the Python worker's.
BATCH_BYTES = 8 << 20
#: Rows that the Parquet reader takes at once.
READ_ROWS = 1024
#: New objects after which Python looks for garbage in cycles; batches make many objects and no cycles.
GC_OBJECTS = 100_000

_settled: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths that were made for tables and not deleted again.
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's spark.checkpoint.dir; on one machine it needn't be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or DEFAULT_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """If what runs inside fails, delete the tables that it has written: nothing will read them."""
    before = len(_paths)
    try:
        yield
    except Exception:
        for path in _paths[before:]:
            drop_path(spark, path)
        raise


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut in the lineage that lost executors can't undo."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _settled[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete settled tables that no later result reads: all that came of them is settled itself."""
    for df in frames:
        path = _settled.pop(df, None)
        if path:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    if path in _paths:
        _paths.remove(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@functools.cache
def _libc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Return memory that the allocators keep for later.

    Python workers live on from task to task and stage to stage beside a JVM that counts on the rest of the memory.
    """
    pa.default_memory_pool().release_unused()
    trim = _libc_trim()
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, with memory given back between batches, and at the end."""

    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(GC_OBJECTS)
        last = time.monotonic()
        for batch in run(batches):
            yield batch
            if time.monotonic() - last > TRIM_SECONDS:
                give_back()
                last = time.monotonic()
        give_back()

    return run_lean


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound what a batch of whole texts takes in the JVM and in Python workers, for the session, unless it is bounded closer already.

    The settings hold when a result is run, which may be after the call that made it.
    """
    settings = spark._jsparkSession.sessionState().conf()
    known = spark._jvm.org.apache.spark.sql.internal.SQLConf
    for entry, most in ((known.ARROW_EXECUTION_MAX_BYTES_PER_BATCH(), size), (known.PARQUET_VECTORIZED_READER_BATCH_SIZE(), READ_ROWS)):
        if settings.getConf(entry) > most:
            spark.conf.set(entry.key(), str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length, null counted as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet, so that tables with any columns can pass through."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
