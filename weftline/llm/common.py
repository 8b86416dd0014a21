"""Tables that cut lineage, and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Without spark.checkpoint.dir a local session gets a folder of its own; on a
    cluster that would be out of the executors' reach, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: later jobs start from the files,
    which outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        home = shared_dir(spark).rstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/weftline-" in folder and home.removeprefix("file:").lstrip("/") in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """left.join(right, on, how) for a `right` with one row for each key: a key that very many rows of `left` hold
    meets them where they are. More than `most` rows, and more than a thousandth of them all, make a key hot; so at
    most 1,000 rows are broadcast. Both sides are read more than once: written tables. Null keys find nothing."""
    if (n := left.count()) <= most:
        return left.join(right, on, how)
    hot = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > max(most, n // 1000)).select(on)
    hot = written(hot, "hot")
    if hot.isEmpty():
        return left.join(right, on, how)
    of_hot = right.join(F.broadcast(hot), on, "left_semi")
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return rest.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(of_hot), on, how))


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of a finished query go at once, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def pieces(texts: list[bytes | None], at_most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `at_most` bytes together (one row at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > at_most:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


def text_pieces(column: pa.Array, at_most: int = 1_500_000) -> Iterator[tuple[int, list[bytes | None]]]:
    """First row and texts of pieces of a binary column that hold about `at_most` bytes: no more leave the batch at once."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 100_000]), at_most, "right")))
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop


_HOLDERS: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Before a worker fills a memory of its own, the others in the process are cleared: workers serve one
    operator after the other, and their memories together would not fit. What the operator before has freed goes
    back to the system: the C library keeps it, and small objects can't use it."""
    if list(_HOLDERS) != [name]:
        for other, drop in _HOLDERS.items():
            if other != name:
                drop()
        _HOLDERS.clear()
        _HOLDERS[name] = clear
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)
