"""Sinks: ordered lines, one file for each record or round, snapshots, results in memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.sources.files import cycled

_WRITERS = ThreadPoolExecutor(4)


def write_lines(df: DataFrame, path: str, column: str = "value", order: Sequence[str] = ()) -> int:
    """Records one per line, in `order` over all part files (range partitions, sorted within); returns how many."""
    seen = Observation()
    out = (df.orderBy(*order) if order else df).select(F.col(column).cast("string").alias("value"))
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("lineSep", "\n").text(path)
    return seen.get["n"]


def write_cycled(df: DataFrame, paths: Sequence[str], run: int, **kw) -> int:
    return write_lines(df, cycled(paths, run), **kw)


def _save(spark, path: str, payload) -> None:
    """One file, on whatever storage its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(payload.encode() if isinstance(payload, str) else payload or b""))
    out.close()


def write_split(df: DataFrame, paths: Sequence[str], index: str = "seq", payload: str = "payload") -> None:
    """Record i, verbatim, into paths[i mod n]; the last record of a path wins. At least two paths.

    What is left is a record for each path, which the driver writes one by one.
    """
    if len(paths) < 2:
        raise ValueError("split records need at least two paths")
    n = len(paths)
    last = df.groupBy(F.pmod(F.col(index), F.lit(n)).cast("int").alias("place")).agg(F.max_by(payload, index).alias("payload"))
    for r in last.toLocalIterator():
        _save(df.sparkSession, paths[r.place], r.payload)


def snapshot(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`df` written to folder/name before anything downstream starts, and read back."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def snapshot_later(df: DataFrame, folder: str, name: str) -> Callable[[], DataFrame]:
    """The snapshot is written while the caller goes on; what is returned waits for it and reads it."""
    done = _WRITERS.submit(snapshot, df, folder, name)
    return done.result


def split_lines(lines: DataFrame, n: int, prefix: str, order: str = "seq") -> list[str]:
    """`lines` (order, value) in n contiguous parts of about equal bytes, at prefix.0 to prefix.(n-1): a part ends with the line
    that brings it to ceil(total / n) bytes. There are always n parts, some of them empty if the lines are few."""
    from weftline.sources.files import _placed

    if n < 1:
        raise ValueError("a file is split in one part at least")
    placed = _placed(lines, order).persist()
    ends = placed.select(order, (F.col("before") + F.octet_length("value") + 1).alias("end"))
    share = -(-(placed.agg(F.max("total")).first()[0] or 0) // n)
    cuts, start = [], 0
    for _ in range(n - 1):  # a part's end depends on the one before; each is a minimum over the cached column
        end = ends.where(F.col("end") >= start + max(1, share)).agg(F.min("end")).first()[0]
        if end is None:
            break
        cuts.append(end)
        start = end
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("before"))) if cuts else F.lit(0)
    paths = [f"{prefix}.{i}" for i in range(n)]
    for i, path in enumerate(paths):
        write_lines(placed.where(part == i), path, order=(order,))
    placed.unpersist()
    return paths


def watch(df: DataFrame, path: str, order: str = "seq", origin: str = "origin", payload: str = "payload") -> None:
    """A readable dump: `[  i][src=o] record` for each record in order, those without a place in it last; ties stay open.

    Records are sorted in ranges and kept on the executors' disks until they are written. Of each range only its count and first id
    go to the driver, so no window spans the whole table. A record or origin that is null takes a number and leaves an empty line.
    """
    text = F.concat(F.lit("][src="), F.col(origin).cast("string"), F.lit("] "), F.col(payload).cast("string"))
    rows = df.orderBy(F.col(order).asc_nulls_last()).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), text.alias("text")).persist(StorageLevel.DISK_ONLY)
    # ids grow by one within a range: less its first id, and with all records in front of it, they are the numbers
    found = {r.part: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first_id")).collect()}
    shifts, front = [0] * (max(found, default=0) + 1), 0
    for part, r in sorted(found.items()):
        shifts[part] = front - r.first_id
        front += r.n
    i = F.col("at") + F.get(F.array(*[F.lit(x) for x in shifts]), F.col("part"))
    line = F.concat(F.lit("["), F.when(i < 1000, F.lpad(i.cast("string"), 3, " ")).otherwise(i.cast("string")), F.col("text"))
    write_lines(rows.select(line.alias("value")), path)  # a file for each range, in their order
    rows.unpersist()


def pgm(df: DataFrame, payload: str = "pixels") -> DataFrame:
    """(image_id, payload): P5 files of gray images with columns w, h and binary pixels."""
    head = F.encode(F.concat(F.lit("P5\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n")), "utf-8")
    return df.select("image_id", F.concat(head, F.col(payload)).alias("payload"))
