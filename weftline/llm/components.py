"""Connected components by alternating stars, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import dropped, written

HUB = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) for each node of at least one edge; component is the least node it reaches.

    Edges are undirected; loops, repeats and null ends are ignored; no edges give no rows. Each round
    hangs every node below the least of its neighbours, first the larger ones (large star), then the
    smaller ones (small star), so paths shrink by a constant factor and the edges never grow in number.
    A round's edges are written to the shared folder. Minima are aggregated before the shuffle, and
    the edges of a hub (more than HUB, and than a thousandth of them all) learn the hub's minimum where they
    are, so a node with very many neighbours fills no task.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(ends.distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        before, hub = now, max(HUB, mark[0] // 1000)
        many = mark[0] > HUB
        larger = written(_large(now, hub), "stars") if many else _large(now, None)
        now = written(_small(larger, hub if many else None), "edges")
        dropped(before, *([larger] if many else []))
        if (after := _mark(now)) == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: every edge hangs a node below its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.bit_xor(F.xxhash64("v", "u"))).first())


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """`edges` (u, v) with `m` of `least` (u, m, n). Nodes with n > `hub` are at most 2,000."""
    if hub is not None:
        hubs = written(least.where(F.col("n") > hub).select("u", "m"), "hubs")
        if not hubs.isEmpty():
            few = F.broadcast(hubs)
            rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
            return rest.union(edges.join(few, "u").select(rest.columns))
    return edges.join(least.select("u", "m"), "u")


def _large(edges: DataFrame, hub: int | None) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hung = _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _small(edges: DataFrame, hub: int | None) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = _with_least(edges, least, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
