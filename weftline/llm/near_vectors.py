"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every vector is projected on m random directions. Sorted along one direction, two vectors collide if
each lies in the window of half-width w around the other; pairs that collide often enough are verified by
their cosine. In the middle of a direction every window holds a good part of all vectors and says
nothing, so a vector stands only in the lists of the T directions (with sign) it reaches farthest along:
T rows for each vector, however many there are. m grows with the square root of the number of vectors and
with T, so a list's length grows with the root alone.

Learned vectors have a mean, along which all of them lie far out: projections are taken of what is left of the
unit vectors without it. That leaves distances as they are, but angles grow: T and the count a pair must pass are
calibrated, for a given recall, on simulated pairs at exactly the threshold's distance whose length is that of
the shortest vectors left. Cosines are verified on the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import dropped, spread_join, tidy, written
from weftline.llm.components import components


#: directions whose projections are held at once
BLOCK = 1 << 14
#: entries of one list and cell beyond which it is split, and a share of all entries above which it may be
CELL, SHARE = 20_000, 1000


@lru_cache(8)
def directions(dim: int, block: int, size: int, seed: int = 5) -> np.ndarray:
    """Random unit vectors number block * BLOCK and on, as columns."""
    a = np.random.default_rng([seed, dim, block]).normal(size=(dim, size)).astype(np.float32)
    return a / np.linalg.norm(a, axis=0)


def window(dim: int, cosine: float) -> float:
    """Two and a half deviations of how far vectors at `cosine` differ along a direction."""
    return 2.5 * float(np.sqrt(2 * (1 - cosine) / dim)) + 1e-6


def farthest(x: np.ndarray, m: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the T lists it stands in (direction * 2 + sign) and how far along it lies; BLOCK directions at a time."""
    x, t = x.astype(np.float32), min(t, m)
    lists = far = None
    for k in range(-(-m // BLOCK)):
        p = x @ directions(x.shape[1], k, min(BLOCK, m - k * BLOCK))
        some = min(t, p.shape[1])
        top = np.argpartition(-np.abs(p), some - 1, axis=1)[:, :some]
        q = np.take_along_axis(p, top, 1)
        own = (top + k * BLOCK) * 2 + (q < 0)
        if lists is None:
            lists, far = own, np.abs(q)
            continue
        lists, far = np.concatenate([lists, own], 1), np.concatenate([far, np.abs(q)], 1)
        best = np.argpartition(-far, t - 1, axis=1)[:, :t]
        lists, far = np.take_along_axis(lists, best, 1), np.take_along_axis(far, best, 1)
    return lists, far


def width(n: int, t: int) -> int:
    """Directions for n vectors that stand in t lists each: lists of about 0.75 root n."""
    return 1 << max(6, int(np.ceil(np.log2(16 * np.sqrt(n) * t / 12))))


@lru_cache(64)
def calibrate(dim: int, n: int, cosine: float, recall: float, left: float = 1.0, pairs: int = 2000, seed: int = 9) -> tuple[int, int, int]:
    """(m, T, count): the least T of 12, 18, 27... whose simulated pairs collide three times or more with probability
    `recall` (in all of the directions at last), and the largest count that still has it. The pairs are `left` long and as
    far apart as unit vectors at `cosine`."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(pairs, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    r = rng.normal(size=(pairs, dim))
    r -= (r * u).sum(1)[:, None] * u
    r /= np.maximum(np.linalg.norm(r, axis=1), 1e-12)[:, None]
    c = max(-1.0, 1 - (1 - cosine) / left**2)
    v = left * (c * u + np.sqrt(1 - c**2) * r)
    u, w, t = left * u, window(dim, cosine), 12
    while True:
        m = width(n, t)
        t = min(t, m)
        (lu, pu), (lv, pv) = farthest(u, m, t), farthest(v, m, t)
        counts = np.zeros(pairs, int)
        for i in range(pairs):
            _, a, b = np.intersect1d(lu[i], lv[i], return_indices=True)
            counts[i] = (np.abs(pu[i][a] - pv[i][b]) <= w).sum()
        passing = int(np.quantile(counts, 1 - recall, method="lower"))
        if passing >= 3 or t >= min(m, 512):
            return m, t, max(1, passing)
        t += t // 2


def near(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Links are pairs with a cosine of at least `cosine`, computed in doubles; none below it. Vectors that are
    null, empty, zero, or hold null or non-finite numbers link with nothing; vectors of different lengths don't
    either. Equal vectors are one class and link with each other. component_id is the least vec_id reachable
    by links, itself included (unknown ids aside); kept: it is the vector's own. Rows that repeat an id count
    each; other columns are ignored; an empty table gives no rows.
    """
    with tidy(vectors.sparkSession):
        return _near(vectors, cosine, recall, vec_id, embedding)


def _middle(classes: DataFrame, dim: int, n: int) -> tuple[np.ndarray, float]:
    """The mean of the n unit vectors of `dim` numbers, and how long what is left of them is without it: all but one in
    fifty are longer. Vectors without a marked mean are left alone."""
    own = classes.where(F.size("v") == dim).select("v")

    def units(b: pa.RecordBatch) -> np.ndarray:
        x = b.column(0).flatten().to_numpy().reshape(-1, dim)
        return x / np.linalg.norm(x, axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((units(b).sum(0) for b in batches), np.zeros(dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], ["j", "x"])

    middle = np.zeros(dim)
    for r in own.mapInArrow(run, "j long, x double").groupBy("j").agg(F.sum("x").alias("x")).collect():  # dim rows
        middle[r.j] = r.x / n
    if middle @ middle < 0.05:
        return np.zeros(dim), 1.0

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(units(b) - middle, axis=1))], ["r"])

    return middle, own.mapInArrow(lengths, "r double").agg(F.percentile_approx("r", 0.02, 1000)).first()[0]


def _split(entries: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the windows' join with a salt: entries of a crowded cell are dealt out on the left and repeated on
    the right. Crowded cells hold more than CELL entries and more than a share of them all, so there are at most SHARE."""
    by = ["list", "cell"]
    n = entries.count()
    if n <= CELL:
        return left, right, by
    crowded = written(entries.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > max(CELL, n // SHARE)).select(*by, F.ceil(F.col("n") / CELL).cast("int").alias("salts")), "crowded")
    if crowded.isEmpty():
        return left, right, by
    few = F.broadcast(crowded)
    salts = F.coalesce("salts", F.lit(1))
    left = left.join(few, by, "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("salts")
    right = right.join(few, by, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left, right, [*by, "salt"]


def _near(vectors: DataFrame, cosine: float, recall: float, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    fit = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (square > 0) & (square < float("inf")), F.lit(False))
    rows = rows.select("vec_id", F.when(fit, F.col("v")).alias("v"))
    grouped = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("many"), F.min("vec_id").alias("first"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("key"), "v", "many", "first"), "vectors")
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans = {}
    for dim, n in sizes.items():
        middle, left = _middle(classes, dim, n)
        left = max(left, (0.5 * (1 - cosine)) ** 0.5)  # shorter ones are all near each other
        plans[dim] = (*calibrate(dim, n, cosine, recall, round(left, 2)), window(dim, cosine), middle)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            lens = np.array([len(x) for x in batch.column(1)], np.int64)
            flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(lens)
            for dim in np.unique(lens):
                m, t, count, w, middle = plans[int(dim)]
                for at in np.array_split(np.flatnonzero(lens == dim), max(1, (lens == dim).sum() * min(m, BLOCK) // 4_000_000)):
                    x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                    lists, far = farthest(x / np.linalg.norm(x, axis=1)[:, None] - middle, m, t)
                    k = lists.shape[1]
                    cell = np.floor(far / w).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(keys[at], k)), pa.array((lists.astype(np.int64) + (int(dim) << 40)).reshape(-1)), pa.array(cell.reshape(-1)), pa.array(far.reshape(-1)), pa.array(np.full(len(at) * k, w, np.float32)), pa.array(np.full(len(at) * k, count, np.int32))],
                        ["key", "list", "cell", "far", "w", "needed"],
                    )

    entries = written(classes.select("key", "v").mapInArrow(project, "key long, list long, cell int, far float, w float, needed int"), "entries")
    # windows: partners lie in the same cell of width w or the one below
    left = entries.select("list", "cell", F.col("key").alias("a"), F.col("far").alias("fa"), "w", "needed")
    right = entries.select("list", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"), F.col("cell").alias("own"), F.col("key").alias("b"), F.col("far").alias("fb"))
    left, right, by = _split(entries, left, right)
    met = left.join(right, by).where((F.abs(F.col("fa") - F.col("fb")) <= F.col("w")) & ((F.col("own") < F.col("cell")) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    counted = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    pairs = counted.where("n >= needed").select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array([len(x) for x in batch.column(2)], np.int64)
            good = np.zeros(batch.num_rows, bool)
            u, v, ends = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(), np.cumsum(dim)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                take = (ends[at] - d)[:, None] + np.arange(d)
                x, y = u[take], v[take]
                good[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= cosine
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    of_a = classes.select(F.col("key").alias("a"), F.col("v").alias("va"))
    of_b = classes.select(F.col("key").alias("b"), F.col("v").alias("vb"))
    links = written(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long"), "links")

    both = links.union(links.select("b", "a"))
    linked = both.join(classes.select(F.col("key").alias("b"), "many"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("many").alias("links"))
    comps = written(components(links), "components")
    firsts = comps.join(classes, comps.node == classes.key).groupBy("component").agg(F.min("first").alias("least"))
    known = comps.join(firsts, "component").select(F.col("node").alias("key"), "least")
    per_class = classes.join(linked, "key", "left").join(known, "key", "left").select("v", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    out = spread_join(rows, written(per_class, "links_of"), "v", "left")
    dropped(entries, links, comps)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
