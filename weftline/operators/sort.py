"""Range partitioning and sorting of keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = 10


def owner(key: Column, ranges: int) -> Column:
    """The range a key belongs to, from its first byte in 33..96; grows with the key."""
    first = F.greatest(F.lit(33), F.least(F.lit(96), F.ascii(F.substring(key, 1, 1))))
    return F.least(F.lit(ranges - 1), F.floor((first - 33) * ranges / 64).cast("int"))


def key_sum(key: Column) -> Column:
    """Sum of the key's first ten bytes."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length(key))), F.lit(0).cast("bigint"), lambda acc, i: acc + F.ascii(F.substr(key, i, F.lit(1))))


def key_hex(key: Column) -> Column:
    return F.lower(F.hex(F.substring(key, 1, KEY)))


def sorted_records(records: DataFrame, key: str = "key", ties: tuple[str, ...] = ()) -> DataFrame:
    """Globally ordered: range partitions by sampled keys, each sorted. Ties by the columns in `ties`."""
    return records.orderBy(key, *ties)


def range_summary(records: DataFrame, ranges: int, key: str = "key") -> DataFrame:
    """(range_id, records, keysum, first_key, last_key) for each range that has records."""
    k = F.col(key)
    return records.groupBy(owner(k, ranges).alias("range_id")).agg(F.count("*").alias("records"), F.sum(key_sum(k)).alias("keysum"), F.min(key_hex(k)).alias("first_key"), F.max(key_hex(k)).alias("last_key"))


def finalize(summary: DataFrame) -> DataFrame:
    """Totals over ranges, and whether they follow one another without overlap."""
    spans = F.transform(F.array_sort(F.collect_list(F.struct("range_id", "first_key", "last_key"))), lambda s: F.struct(s["first_key"].alias("a"), s["last_key"].alias("b")))
    out = summary.agg(F.count("*").alias("ranges"), F.sum("records").alias("records"), F.sum("keysum").alias("keysum"), spans.alias("s"))
    apart = F.forall(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: (i >= F.size("s")) | (F.element_at("s", i)["b"] <= F.element_at("s", F.least(i + 1, F.size("s")))["a"]))
    return out.select("ranges", "records", "keysum", apart.alias("in_order"))
