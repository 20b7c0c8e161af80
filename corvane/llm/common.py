"""Helpers that the operators of this subpackage share: work folders that every executor sees, and Arrow rows."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Work folders of this driver that are still there, with what removes them.
_FOLDERS: dict[str, Callable[[], None]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (a single machine, as in tests) a folder of this process is made and the
    session keeps it, so that later calls agree. On a cluster the absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one; it goes when the driver ends, or with ``remove_folder`` or ``settle``."""
    uri = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    conf = spark._jsc.hadoopConfiguration()
    _FOLDERS[uri] = lambda: path.getFileSystem(conf).delete(path, True)
    return uri


def remove_folder(uri: str) -> None:
    if remove := _FOLDERS.pop(uri, None):
        remove()


@atexit.register
def _remove_all() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        for uri in list(_FOLDERS):
            remove_folder(uri)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: the plan above no longer recomputes what is below, and
    a lost executor costs nothing but its own tasks."""
    spark = df.sparkSession
    path = work_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """``make()``, written; the work folders that it left behind, which nothing reads any more, go."""
    before = set(_FOLDERS)
    made = make()
    between = set(_FOLDERS) - before
    out = materialise(made, tag)
    for uri in between:
        remove_folder(uri)
    return out


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives its free memory back: it waits for its next task beside tasks of others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return task


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; works for file:, hdfs:, s3: and others that Arrow opens."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else "file://" + uri)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Texts go to Python workers in batches of this many bytes at most; each is held several times over, in the JVM and in Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bound, unless it asks for smaller batches."""
    held = spark.conf.get(_BATCH)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; whatever else a table has is left out."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 16 << 20, max_rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup a task's rows to tables of bounded bytes. A row larger than the bound is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        at = 0
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        for i, n in enumerate(sizes):
            if rows and (size + n > max_bytes or rows >= max_rows):
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, rows, at = [], 0, 0, i
            size += n
            rows += 1
        if len(sizes) > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
