"""Routing of whole branches and of single records, and slicing of byte ranges.

A branch is a DataFrame of records (origin, seq, payload). Where order matters it is a column:
(branch_ord, seq) is the order in which a reader of several branches sees the records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bridge(branch: DataFrame) -> DataFrame:
    """The downstream dataset is the upstream one."""
    return branch


def aggregate(branches: Sequence[DataFrame]) -> DataFrame:
    """All branches one after the other: nothing is merged or dropped; branch_ord keeps their order."""
    if not branches:
        raise ValueError("nothing to aggregate")
    numbered = [b.withColumn("branch_ord", F.lit(i)) for i, b in enumerate(branches)]
    out = numbered[0]
    for b in numbered[1:]:
        out = out.unionByName(b)
    return out


def modulo(origin: Column, slots: int) -> Column:
    """A branch goes to the slot numbered like its id, modulo the slots."""
    return F.pmod(origin, F.lit(slots)).cast("int")


def round_robin(branch_ord: Column, slots: int) -> Column:
    """The i-th listed branch goes to slot i modulo the slots."""
    return F.pmod(branch_ord, F.lit(slots)).cast("int")


def fixed_map(origin: Column, mapping: Mapping[int, int], default: int, slots: int) -> Column:
    """The slot that `mapping` names for a branch, else `default`; null (dropped) where that is out of range."""
    found = F.lit(default)
    if mapping:
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        found = F.coalesce(table[origin.cast("int")], F.lit(default))
    return F.when((found >= 0) & (found < slots), found)


def shuffle(records: DataFrame, dest: Column) -> DataFrame:
    """`records` with their slot; those without one are dropped."""
    return records.withColumn("dest", dest).where("dest is not null")


def broadcast(records: DataFrame, slots: int) -> DataFrame:
    """Every slot gets every record."""
    return records.withColumn("dest", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


def fan_out(records: DataFrame, slots: Sequence[int]) -> DataFrame:
    """The same record into each listed slot."""
    return records.withColumn("dest", F.explode(F.array(*[F.lit(s) for s in slots])))


def branch_on(records: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Records that meet a condition, and the rest (an unknown outcome is no)."""
    yes = F.coalesce(condition, F.lit(False))
    return records.where(yes), records.where(~yes)


def scatter(records: DataFrame, slots: int, seq: str = "seq") -> DataFrame:
    """Record number `seq` goes to slot seq modulo the slots."""
    return records.withColumn("dest", F.pmod(F.col(seq), F.lit(slots)).cast("int"))


def by_key(records: DataFrame, slots: int, key: str = "key") -> DataFrame:
    return records.withColumn("dest", F.pmod(F.coalesce(F.col(key).try_cast("bigint"), F.lit(0)), F.lit(slots)).cast("int"))


def read_next(records: DataFrame, cursors: DataFrame | None, most: int, slot: str = "origin", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The next `most` unread records of each slot, and the cursors (slot, last) after them. `cursors` None: nothing was read yet;
    a slot without new records keeps its cursor."""
    unread = records
    if cursors is not None:
        unread = records.join(cursors.select(slot, "last"), slot, "left").where(F.col("last").isNull() | (F.col(seq) > F.col("last"))).drop("last")
    got = unread.withColumn("_k", F.row_number().over(W.partitionBy(slot).orderBy(seq))).where(F.col("_k") <= most).drop("_k")
    after = got.groupBy(slot).agg(F.max(seq).alias("last"))
    if cursors is not None:
        after = cursors.select(slot, "last").unionByName(after).groupBy(slot).agg(F.max("last").alias("last"))
    return got, after


def slot_counts(routed: DataFrame) -> DataFrame:
    """(dest, n) records in each slot that has some."""
    return routed.groupBy("dest").agg(F.count("*").alias("n"))


def ranges(records: DataFrame, order: str) -> Column:
    """The range of `order` a row lies in, of four for each of the shuffle's partitions: cut by approximate percentiles, numbered
    from 0. Ranges of one value each are as long as that value is frequent."""
    n = max(2, min(10_000, 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(records.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)


def running_bytes(records: DataFrame, size: Column, order: str) -> DataFrame:
    """`records` with before (bytes of all records in front, in the total order `order`) and total.

    Sums are taken in ranges of `order` first; only the ranges' sums (a few for each partition) meet in one
    task, so no window spans the whole table.
    """
    placed = records.withColumn("_size", size).withColumn("_bucket", ranges(records, order))
    sums = placed.groupBy("_bucket").agg(F.sum("_size").alias("_sum"))
    upto = sums.select("_bucket", (F.sum("_sum").over(W.orderBy("_bucket")) - F.col("_sum")).alias("_front"), F.sum("_sum").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return own.join(upto, "_bucket").withColumn("before", F.col("_front") + F.col("_own")).drop("_bucket", "_front", "_own", "_size")


def split_contiguous(records: DataFrame, workers: int, payload: str = "payload", order: str = "seq") -> DataFrame:
    """`records` with their worker: contiguous segments of about equal bytes (payload and 8 each).

    A segment ends with the record at which the running bytes reach its share; one record ends one segment
    at most. The closed form below needs every record to be no larger than a share; where one is larger,
    the sizes alone are folded in order.
    """
    size = F.octet_length(payload).cast("bigint") + 8
    placed = running_bytes(records.withColumn("_bytes", size), F.col("_bytes"), order)
    most = records.agg(F.max(size), F.sum(size)).first()
    if most[0] is None:
        return records.withColumn("worker", F.lit(0))
    if most[0] <= most[1] // workers:
        exact = F.expr(f"size(filter(sequence(1, {max(1, workers - 1)}), w -> w < {workers} and before >= (w * total) div {workers}))")
        return placed.withColumn("worker", exact).drop("before", "total", "_bytes")
    # feedback: the cut after a record moves the next target on by one only. A record that reaches a target in its closed form
    # is one of at most `workers`, and behind a large record every one may end a segment: those few are looked at in order.
    total = most[1]
    targets = F.expr(f"size(filter(sequence(1, {max(1, workers - 1)}), w -> before < (w * total) div {workers} and before + _bytes >= (w * total) div {workers}))")
    ends = placed.select(F.col(order).alias("o"), "before", "_bytes", "total").withColumn("hits", targets)
    crossing = ends.where("hits > 0").orderBy("o").collect()  # workers - 1 at most
    cuts, w = [], 0
    for i, r in enumerate(crossing):
        until = crossing[i + 1].o if i + 1 < len(crossing) else None
        due = sum(r.before + r._bytes >= (k * total) // workers for k in range(1, workers))  # targets reached by here
        cuts.append(r.o)
        w += 1
        if w < due:  # the records after this one end a segment each, until the targets are made up for
            between = ends.where(F.col("o") > r.o)
            between = between if until is None else between.where(F.col("o") < until)
            for x in between.orderBy("o").limit(due - w).select("o").collect():
                cuts.append(x.o)
                w += 1
    worker = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    return placed.withColumn("worker", worker).drop("before", "total", "_bytes")


def equal_slices(length: Column, n: int) -> Column:
    """array<struct<idx, off, len>>: min(n, length) ranges; the first length % n are one longer."""
    parts = F.least(F.lit(n).cast("bigint"), length)
    return F.when(length <= 0, F.array().cast("array<struct<idx:bigint,off:bigint,len:bigint>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.greatest(parts - 1, F.lit(0))),
            lambda i: F.struct(
                i.alias("idx"),
                (i * F.floor(length / parts) + F.least(i, length % parts)).cast("bigint").alias("off"),
                (F.floor(length / parts) + F.when(i < length % parts, 1).otherwise(0)).cast("bigint").alias("len"),
            ),
        )
    )


def fixed_slices(length: Column, most: int) -> Column:
    """Ranges of `most` bytes; the last may be shorter."""
    last = F.floor((length - 1) / most).cast("bigint")
    return F.when(length <= 0, F.array().cast("array<struct<idx:bigint,off:bigint,len:bigint>>")).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("idx"), (i * most).alias("off"), F.least(F.lit(most).cast("bigint"), length - i * most).alias("len")))
    )


def line_slices(text: Column, n: int) -> Column:
    """n byte targets moved to just after the next line end; equal ones become one. Offsets count bytes."""
    length = F.octet_length(text).cast("bigint")
    ends = F.transform(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x).cast("bigint")), lambda x: x.isNotNull()), lambda x: x + 1)
    sums = F.aggregate(ends, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all")), lambda acc: acc["all"])
    starts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>"), lambda i: F.least(length, F.coalesce(F.array_min(F.filter(sums, lambda e: e > F.floor(i * length / n))), length)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), starts, F.array(length))))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1))), lambda i: F.struct((i - 1).cast("bigint").alias("idx"), F.element_at(cuts, i).alias("off"), (F.element_at(cuts, F.least(i + 1, F.size(cuts))) - F.element_at(cuts, i)).alias("len")))
