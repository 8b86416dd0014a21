"""Shared state: counters, compare-and-swap, conflicting writes and their resolution, two-phase barriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def totals(deltas: DataFrame, name: str = "name", delta: str = "delta") -> DataFrame:
    """(name, total): partial sums are added at the owner."""
    return deltas.groupBy(name).agg(F.sum(delta).alias("total"))


def _in_ranges(rows: DataFrame, name: str, order: str, total: Column, running: Column, down: bool = False) -> DataFrame:
    """`rows` with _before: the sum of `total` over a name's ranges of `order` in front of a row's own (behind it, if `down`) and
    of `running` over the rows in front of it within the range. A name of very many rows is spread over as many tasks as
    there are ranges; only its ranges' sums meet."""
    from weftline.operators.routing import ranges

    by = F.desc if down else F.asc
    placed = rows.withColumn("_range", ranges(rows, order))
    sums = placed.groupBy(name, "_range").agg(total.alias("_sum"))
    front = sums.select(F.col(name).alias("_name"), F.col("_range").alias("_of"), (F.sum("_sum").over(W.partitionBy(name).orderBy(by("_range"))) - F.col("_sum")).alias("_front"))
    inside = W.partitionBy(name, "_range").orderBy(by(order)).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(running.over(inside), F.lit(0)))
    joined = own.join(front, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("_before", F.col("_front") + F.col("_own")).drop("_name", "_of", "_front", "_own", "_range")


def fetch_add(deltas: DataFrame, name: str = "name", delta: str = "delta", order: str = "seq") -> DataFrame:
    """`deltas` with the value that each addition found (`old_value`), in `order` within a name; ties in any order."""
    return _in_ranges(deltas, name, order, F.coalesce(F.sum(delta), F.lit(0)), F.sum(delta)).withColumnRenamed("_before", "old_value")


def compare_and_swap(attempts: DataFrame, initial: int = 0, name: str = "name", order: str = "seq") -> DataFrame:
    """(name, final, swaps): attempts (compare, swap) folded in `order`; each swaps if the value equals compare.

    A name's attempts are folded in one task, as the value after each depends on the one before.
    """
    listed = attempts.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(order, "compare", "swap"))).alias("a"))
    step = lambda acc, x: F.when(acc["v"] == x["compare"], F.struct(x["swap"].alias("v"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    start = F.struct(F.lit(initial).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("n"))
    return listed.withColumn("r", F.aggregate("a", start, step)).select(name, F.col("r.v").alias("final"), F.col("r.n").alias("swaps"))


def newest_first(writes: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """All writes of a name, numbered from the newest."""
    return _in_ranges(writes, name, seq, F.count("*"), F.count(F.lit(1)), down=True).withColumn("age", (F.col("_before") + 1).cast("int")).drop("_before")


POLICIES = ("max_id", "min_id", "last_write", "largest", "majority")


def resolve(writes: DataFrame, policy: str, name: str = "name") -> DataFrame:
    """(name, writer_id, payload): the write that wins among (writer_id, seq, payload) of each name.

    max_id, min_id: by writer_id. last_write: the newest. largest: most bytes, then writer_id. majority: the
    most frequent payload, ties by payload ascending; its newest writer is named.
    """
    if policy == "majority":
        votes = writes.groupBy(name, "payload").agg(F.count("*").alias("n"), F.max_by("writer_id", "seq").alias("writer_id"))
        best = F.min_by(F.struct("writer_id", "payload"), F.struct((-F.col("n")).alias("n"), "payload"))
        return votes.groupBy(name).agg(best.alias("w")).select(name, "w.writer_id", "w.payload")
    by: dict[str, Column] = {
        "max_id": F.struct("writer_id", "seq"),
        "min_id": F.struct((-F.col("writer_id")).alias("writer_id"), "seq"),
        "last_write": F.struct("seq"),
        "largest": F.struct(F.octet_length("payload").alias("bytes"), F.col("writer_id").alias("id"), "seq"),
    }
    if policy not in by:
        raise ValueError(f"unknown policy {policy!r}: one of {', '.join(POLICIES)}")
    return writes.groupBy(name).agg(F.max_by(F.struct("writer_id", "payload"), by[policy]).alias("w")).select(name, "w.writer_id", "w.payload")


def two_phase(records: DataFrame, group: str, value: str) -> DataFrame:
    """Phase one sums within groups; phase two, after all of them, sets each sum against the whole.

    The exchange between the two aggregations is the barrier.
    """
    one = records.groupBy(group).agg(F.sum(value).alias("phase1"))
    whole = one.agg(F.sum("phase1").alias("total"), F.count("*").alias("parties"))
    return one.join(F.broadcast(whole)).select(group, "phase1", "total", "parties")  # one row


def byte_range(payload: Column, offset: int, length: int) -> Column:
    return F.substring(payload, offset + 1, length)


def overwrite(payload: Column, offset: int, data: str) -> Column:
    """Bytes in place; never longer than before."""
    return F.substring(F.overlay(payload, F.lit(data), F.lit(offset + 1)), F.lit(1), F.octet_length(payload))


def seek(start: str, position: Column, size: Column, move: int) -> Column:
    """The place after a seek from start, current or end; null outside 0..size."""
    at = {"start": F.lit(0), "current": position, "end": size}[start] + F.lit(move)
    return F.when((at >= 0) & (at <= size), at)
