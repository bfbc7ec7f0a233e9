"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _scratch() -> str:
    """A local folder for sessions without spark.checkpoint.dir; it goes when the program ends."""
    root = tempfile.mkdtemp(prefix="pixelloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors see.

    Only where that setting is absent (local tests) a temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _scratch()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Intermediate tables of this program that are still there.
_made: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back. The table stays until clear() or the end of the program.

    What was shuffled for it goes at once, as nothing reads that again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _made[path] = spark
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of intermediate tables that nothing reads any more."""
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        for made in [m for m in _made if path.rpartition(":")[2].lstrip("/") == m.rpartition(":")[2].lstrip("/")]:
            _delete(made)


def _delete(path: str) -> None:
    spark = _made.pop(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def made() -> set[str]:
    """The folders of the intermediate tables that are still there."""
    return set(_made)


def clear(keep: set[str] = frozenset()) -> None:
    """Deletes the intermediate tables but those to keep; results that were not written yet can't be read afterwards."""
    for path in set(_made) - keep:
        _delete(path)


@atexit.register
def _clear_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        clear()


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like this one that is not taken; case plays no part."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns the operators need, so that clashing extra columns play no part; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_groups(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about `limit` UTF-8 bytes each; one longer text is a range of its own."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts.cast(pa.binary())).to_pylist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives freed memory back to the system after each task: the worker stays for later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return task


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int = 200_000, shift: int = 0) -> Iterator[pa.Table]:
    """Tables of at least so many rows that never cut a run of equal keys (without their lowest `shift` bits); rows must come sorted by the key."""
    held: list[pa.Table] = []
    rows, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rows >= at_least:
            k = t.column(key).to_numpy() >> shift
            if k[0] != last or k[-1] != last:  # else the whole batch goes on with the open run
                cut = 0 if k[0] != last else int(np.searchsorted(k, last, side="right"))
                if cut:
                    held.append(t.slice(0, cut))
                yield pa.concat_tables(held).combine_chunks()
                held, rows, t = [], 0, t.slice(cut)
        held.append(t)
        rows += t.num_rows
        last = t.column(key)[-1].as_py() >> shift
    if held:
        yield pa.concat_tables(held).combine_chunks()
