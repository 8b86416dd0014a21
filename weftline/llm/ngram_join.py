"""Jaccard join of documents by word n-grams, over prefix trees.

1. Texts become sets of 64-bit shingle hashes; every document has the 128-bit digest of its set, and equal
   sets are one class from here on.
2. Two sets that are to link differ in few shingles. If hashes are cut into one part more than that number,
   the sets agree on some part as a whole; so classes are brought together by the signatures of
   their parts, and no link is lost. Empty parts and parts of one shingle are not signed; a few more parts
   make up for them. Passages that many documents share fill no part by themselves. Classes
   of one signature are chained (a signature costs its occurrences, not their pairs); connected chains are
   clusters, and all links lie inside clusters.
3. Only the clusters' sets travel. Within a cluster (or a pair of its blocks) the globally ordered sets stand in a
   trie, frequent shingles first; one vector of overlaps with all probes goes down each shared path once, and
   a subtree is left when no probe can reach the bound with the shingles that remain.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import claim, dropped, pieces, spread_join, tidy, written
from weftline.llm.components import components

MARKS = 1 << 27
BLOCK_SETS, BLOCK_SHINGLES = 1500, 1_000_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. To look them up among remembered ones takes longer than to make them."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of n words; of all its words if they are fewer; none of none.

    A-Z are lowered; words are runs without ASCII white space.
    """
    for a, b in pieces(texts):
        words = [(t or b"").lower().split() for t in texts[a:b]]
        every = word_hashes(list(itertools.chain.from_iterable(words)))
        stops = np.cumsum([len(w) for w in words]).tolist()
        rolled = np.zeros(max(0, len(every) - n + 1), np.uint64)
        for k in range(n):
            rolled = _mix(rolled + every[k : k + len(rolled)])
        for start, stop in zip([0, *stops], stops):
            if stop - start >= n:
                yield np.unique(rolled[start : stop - n + 1])
            elif stop > start:
                yield np.array([xxhash.xxh3_64_intdigest(every[start:stop].tobytes(), seed=stop - start)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def intervals(t: int, most: int = 1 << 40) -> list[tuple[int, int]]:
    """Sizes 1..most in intervals (low, high), each a quarter wider than the one before."""
    out, low = [], 1
    while low <= most:
        high = max(low, low * 5 // 4)
        out.append((low, high))
        low = high + 1
    return out


@lru_cache(4)
def _plan(t: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Lows and highs of the intervals, and for each (parts, spare, least): two sets of these sizes may differ by
    (100 - t) / (100 + t) of their sizes' sum, so of one part more than that they agree on one. Parts of fewer than
    `least` shingles say too little to bring sets together; `spare` more parts stand in for that many of them."""
    both, plans = intervals(t), []
    for low, high in both:
        d, least, spare = 2 * high * (100 - t) // (100 + t), 2, 0
        while d:  # spare weak parts: their number in the smallest sets of the interval, and three deviations
            parts = d + spare + 1
            log_none = low * np.log1p(-1 / parts)
            weak = parts * (np.exp(log_none) + low / parts * np.exp(log_none - np.log1p(-1 / parts)))
            if (need := int(weak + 3 * np.sqrt(weak))) <= spare:
                break
            spare = need
        plans.append((d + spare + 1, spare, least if d else 0))
    return np.array([a for a, _ in both]), np.array([b for _, b in both]), plans


@lru_cache(256)
def _cuts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def signatures(s: np.ndarray, t: int, tries: int = 8) -> np.ndarray:
    """A hash for each part of the set that says enough: for the interval of its size, and for the next one if a
    partner may lie there.

    A pair in which either set has at most `spare` weak parts agrees on a part that is not weak. Where a set has
    more, it is parted once more by other hashes, as its partners with too many are; the last time every part
    counts. So no link is lost, and sets that share nothing but an empty part don't meet.
    """
    low, high, plans = _plan(t)
    at = int(np.searchsorted(high, len(s)))
    out = []
    for b in (at, at + 1) if 100 * len(s) >= t * int(low[at + 1]) else (at,):
        parts, spare, least = plans[b]
        for k in range(tries):
            x = np.sort(_mix(s + np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64)))) if k else s
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(x))])
            bounds = np.concatenate([[0], np.searchsorted(x, _cuts(parts)), [len(x)]])
            strong = np.flatnonzero(np.diff(bounds) >= least)
            enough = parts - len(strong) <= spare
            if not enough and k == tries - 1:
                strong = np.arange(parts)
            inside = sums[bounds[strong + 1]] - sums[bounds[strong]]
            out.append(_mix(_mix(inside + np.uint64((k * 1024 + b + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) + strong.astype(np.uint64)))
            if enough:
                break
    return np.concatenate(out)


def trie_links(sets: list[np.ndarray], probes: list[np.ndarray] | None, t: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indices of probes linked with sets[i]): 100 * shared >= t * union. Without `probes`, sets probe
    themselves, each leaving itself out. All sets are sorted, distinct and not empty."""
    own = probes is None
    probes = sets if own else probes
    tokens, place = np.unique(np.concatenate(sets + ([] if own else probes)), return_inverse=True)
    cut = np.cumsum([len(s) for s in sets])
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -np.bincount(place, minlength=len(tokens))))] = np.arange(len(tokens))  # frequent first
    ranked = rank[place]
    paths = [np.sort(x).astype(np.int32) for x in np.split(ranked[: cut[-1]], cut[:-1])]
    sizes = np.array([len(p) for p in probes], np.int64)
    held = ranked if own else ranked[cut[-1] :]
    who = np.repeat(np.arange(len(probes)), sizes)
    by = np.argsort(held, kind="stable")
    who, first = who[by], np.searchsorted(held[by], np.arange(len(tokens) + 1))

    def add(vector: np.ndarray, path: np.ndarray) -> np.ndarray:
        if not len(path):
            return vector
        return vector + np.bincount(np.concatenate([who[first[r] : first[r + 1]] for r in path.tolist()]), minlength=len(probes))

    def reach(vector: np.ndarray, depth: int, low: int, high: int) -> np.ndarray:
        """Probes that a set of low..high shingles below this node can still link with."""
        most = np.minimum(vector + (high - depth), np.minimum(sizes, high))
        return (100 + t) * most >= t * (low + sizes)

    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())

    def common(a: np.ndarray, b: np.ndarray, at: int) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[at:m] != b[at:m])
        return at + int(differ[0]) if len(differ) else m

    # (sets in trie order, depth reached, overlaps so far); siblings are split off one level at a time
    todo = [(order, 0, np.zeros(len(probes), np.int64))]
    while todo:
        group, depth, vector = todo.pop()
        lens = [len(paths[i]) for i in group]
        alive = reach(vector, depth, min(lens), max(lens))
        if own and len(group) == 1:
            alive[group[0]] = False
        if not alive.any():
            continue
        a = paths[group[0]]
        down = len(a) if len(group) == 1 else common(a, paths[group[-1]], depth)  # sorted: what first and last share, all share
        vector = add(vector, a[depth:down])
        ends = [i for i in group if len(paths[i]) == down]
        for i in ends:
            union = sizes + down - vector
            found = 100 * vector >= t * union
            if own:
                found[i] = False
            if found.any():
                yield i, np.flatnonzero(found)
        rest = [i for i in group if len(paths[i]) > down]
        for _, child in itertools.groupby(rest, key=lambda i: paths[i][down]):
            todo.append((list(child), down, vector))


def short(d: bytes) -> int:
    """Eight bytes of a digest: enough to name a class while clusters are made, where a clash only merges two."""
    return int.from_bytes(d[:8], "big", signed=True)


class _Seen(set):
    """Digests that a task has met lately: no more than some hundred thousand are remembered."""

    def first(self, d: bytes) -> bool:
        if d in self:
            return False
        if len(self) > 200_000:
            self.clear()
        self.add(d)
        return True


def _digests(docs: DataFrame, n: int, t: int) -> DataFrame:
    """(doc_id, n_shingles, sid, signatures) for each document; the signatures once for a class, or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets", lambda: None)  # an operator before may have left its words
        seen = _Seen()
        for batch in batches:
            size, sid, signed = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                size.append(len(s))
                sid.append(digest(s) if len(s) else None)
                signed.append(signatures(s, t).tobytes() if len(s) and seen.first(sid[-1]) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sid, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "sid", "signatures"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sid binary, signatures binary")


def _chained(rows: DataFrame, at_once: int = 2_000_000) -> DataFrame:
    """(a, b): the classes of one signature, one after the other. A task chains what it has, so that a
    signature costs a row for each of its runs in the shuffle, however many classes bear it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            mark, of = np.concatenate(found), np.concatenate(ids)
            order = np.argsort(mark, kind="stable")
            mark, of = mark[order], of[order]
            again = np.concatenate([[False], mark[1:] == mark[:-1]])
            a = of[np.maximum(np.flatnonzero(again) - 1, 0)]
            b = of[again]
            edge = _mix(_mix(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)  # a mark of its own
            other = pa.concat_arrays([pa.nulls(int((~again).sum()), pa.int64()), pa.array(a)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([mark[~again], edge])), pa.array(np.concatenate([of[~again], b])), other], ["signature", "id", "other"])

        for batch in batches:
            for d, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.append(np.frombuffer(blob, np.int64))
                ids.append(np.full(len(found[-1]), short(d), np.int64))
            if sum(map(len, found)) > at_once:
                yield out()
                found, ids = [], []
        if found:
            yield out()

    runs = rows.where("signatures is not null").select("sid", "signatures").mapInArrow(run, "signature long, id long, other long")
    before = F.lag("id").over(W.partitionBy("signature").orderBy("id"))
    return runs.select(F.coalesce("other", before).alias("a"), F.col("id").alias("b")).where("a <> b")


def _sets(docs: DataFrame, n: int, marks) -> DataFrame:
    """(sid, shingles) for marked digests, once for each task that has one, or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets", lambda: None)  # an operator before may have left its words
        seen = _Seen()
        for batch in batches:
            sid, blob = [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                if len(s):
                    d = digest(s)
                    m = short(d) % (1 << 64) % MARKS
                    if marks.value[m >> 3] >> (m & 7) & 1 and seen.first(d):
                        sid.append(d)
                        blob.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(blob, pa.binary())], ["sid", "shingles"])

    return docs.mapInArrow(run, "sid binary, shingles binary")


def _marks(clusters: DataFrame) -> bytes:
    """MARKS bits, one set for each class that is in a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [(b.column(0).to_numpy().view(np.uint64) % np.uint64(MARKS)).astype(np.int64) for b in batches]
        at = np.unique(np.concatenate(words)) if words else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at // 8), pa.array(1 << (at % 8))], ["place", "bit"])

    rows = clusters.select("node").mapInArrow(run, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bit"))
    lumps = rows.groupBy((F.col("place") / (MARKS // 8 // 256)).cast("int").alias("lump")).agg(F.collect_list(F.struct("place", "bit")).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lump, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.zeros(MARKS // 8 // 256, np.uint8)
                for x in bits:
                    part[x["place"] - lump * len(part)] = x["bit"]
                out.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["lump", "part"])

    whole = bytearray(MARKS // 8)
    for r in lumps.mapInArrow(pack, "lump int, part binary").collect():  # MARKS / 8 bytes at most
        whole[r.lump * (MARKS // 8 // 256) : (r.lump + 1) * (MARKS // 8 // 256)] = r.part
    return bytes(whole)


def _join(blocks: DataFrame, t: int) -> DataFrame:
    """(sid, links, hub): from each block pair, how many documents a class is linked with, and for the
    components a chain of its links: each class with the least one it reaches here."""

    def one(sid: list[bytes], many: list[int], side: list[int], blob: list[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
        sets = [np.frombuffer(b, np.uint64) for b in blob]
        left = [i for i, s in enumerate(side) if s != 1]
        right = [i for i, s in enumerate(side) if s == 1]
        weight, links, hub = np.array(many, np.int64), np.zeros(len(sid), np.int64), list(range(len(sid)))

        def root(x: int) -> int:
            while hub[x] != x:
                hub[x] = hub[hub[x]]
                x = hub[x]
            return x

        if left and right:
            pairs = trie_links([sets[i] for i in left], [sets[i] for i in right], t)
        elif side[0] == -1:
            pairs = trie_links([sets[i] for i in left], None, t)
        else:
            return
        for i, found in pairs:
            a = left[i]
            for b in found.tolist():
                b = right[b] if right else left[b]
                links[a] += weight[b]
                if right:
                    links[b] += weight[a]
                ra, rb = root(a), root(b)
                hub[max(ra, rb)] = min(ra, rb)
        for i in np.flatnonzero(links).tolist():
            yield sid[i], int(links[i]), sid[root(i)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            _, sid, many, side, blob = zip(*group)
            out = list(one(list(sid), list(many), list(side), list(blob)))
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["sid", "links", "hub"])

    # a block pair's rows come together, in one task, and no more than one is held
    together = blocks.select("block", "sid", "many", "side", "shingles").repartition("block").sortWithinPartitions("block")
    return together.mapInArrow(run, "sid binary, links long, hub binary")


def similar(docs: DataFrame, t: int = 90, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id) for each row of `docs`.

    Two documents link when 100 * shared >= t * union of their sets of n-word shingles (a document of fewer
    words has its whole sequence as its one shingle). n_similar counts the other documents linked directly, copies
    included; component_id is the least doc_id reachable by links, itself included. Texts of any length are taken whole. A null or blank text
    has no shingles and links with nothing. Rows that repeat an id count as documents of their own; null ids
    take part and get the least known id of their component, or null. Other columns are ignored; an empty
    table gives no rows. Shingles are compared by 64-bit hashes, sets by 128-bit digests.
    """
    with tidy(docs.sparkSession):
        return _similar(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), t, n)


def _similar(source: DataFrame, t: int, n: int) -> DataFrame:
    spark = source.sparkSession
    rows = written(_digests(source, n, t), "digests")
    classes = written(rows.where("sid is not null").groupBy("sid").agg(F.count("*").alias("many"), F.min("doc_id").alias("first"), F.first("n_shingles").alias("n")), "classes")
    clusters = written(components(_chained(rows)), "clusters")

    marks = spark.sparkContext.broadcast(_marks(clusters))
    named = classes.withColumn("node", F.expr("cast(conv(hex(substring(sid, 1, 8)), 16, -10) as bigint)"))
    members = clusters.join(named, "node").select("sid", "many", "first", "n", F.col("component").alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    members = members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    found = _sets(source, n, marks).dropDuplicates(["sid"])
    placed = found.join(members, "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise((F.col("part") > F.col("other")).cast("int"))
    block = F.concat_ws(",", "cluster", F.least("part", "other"), F.greatest("part", "other"))
    linked = written(_join(placed.select(block.alias("block"), "sid", "many", side.alias("side"), "shingles"), t), "links")

    links = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    hubs = written(components(linked.select(F.col("sid").alias("a"), F.col("hub").alias("b"))), "hubs")
    firsts = hubs.join(classes, hubs.node == classes.sid).groupBy("component").agg(F.min("first").alias("component_id"))
    known = hubs.join(firsts, "component").select(F.col("node").alias("sid"), "component_id").join(links, "sid")
    per_class = classes.join(known, "sid", "left").select("sid", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "first").alias("component_id"))
    out = spread_join(rows.drop("signatures"), written(per_class, "links_of"), "sid", "left")
    dropped(clusters, linked, hubs)
    return out.select("doc_id", "n_shingles", F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))
