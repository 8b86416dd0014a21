"""Merging of partial results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.routing import aggregate


def add_up(parts: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """(key, total) over all partial results."""
    return aggregate([p.select(key, value) for p in parts]).groupBy(key).agg(F.sum(value).alias("total"))


def word_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """(word, n) of partial word counts."""
    return add_up(parts, "word", "n").withColumnRenamed("total", "n")


def top(parts: Sequence[DataFrame], key: str, value: str, k: int) -> DataFrame:
    """The k largest totals; ties by key ascending."""
    return add_up(parts, key, value).orderBy(F.desc("total"), key).limit(k)


def counters(parts: Sequence[DataFrame]) -> DataFrame:
    """(key, value, first_seen) of text counters (key, value, seq): numbers are added, of others the last
    written stays; first_seen orders keys as they first came, over branches and seq."""
    number = F.col("value").try_cast("bigint")
    place = F.col("branch_ord").cast("bigint") * (1 << 40) + F.col("seq")
    rows = aggregate(parts).select("key", "value", number.alias("number"), place.alias("place"))
    out = rows.groupBy("key").agg(F.sum("number").alias("total"), F.max_by("value", "place").alias("last"), F.count_if(F.col("number").isNull()).alias("texts"), F.min("place").alias("first_seen"))
    return out.select("key", F.when(F.col("texts") > 0, F.col("last")).otherwise(F.col("total").cast("string")).alias("value"), "first_seen")


def key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, n) of lines `key: n`, `key=n` or `key n`; the last separator counts, other lines are left out."""
    m = r"^(.*?)\s*[:=\s]\s*(-?\d+)\s*$"
    return lines.where(F.col(column).rlike(m)).select(F.regexp_extract(column, m, 1).alias("key"), F.regexp_extract(column, m, 2).cast("bigint").alias("n"))


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Everything, in the order of the arguments (branch_ord)."""
    return aggregate(parts)


REDUCERS: dict[str, Callable] = {
    "wordcount": lambda parts: word_counts(parts),
    "counters": counters,
    "sum": lambda parts: add_up(parts, "key", "n"),
    "concat": concat,
}


def reducer(name: str) -> Callable[[Sequence[DataFrame]], DataFrame]:
    """A reducer by name; `topk:K` takes the K largest of (key, n)."""
    if name.startswith("topk:"):
        k = int(name[5:])
        return lambda parts: top(parts, "key", "n", k)
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {name!r}: one of {', '.join(REDUCERS)}, topk:K")
    return REDUCERS[name]
