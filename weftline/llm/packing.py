"""Best-fit decreasing packing of documents into sequences.

Best-fit decreasing looks at lengths alone, and there are at most `capacity` of them. So the plan is made
from the histogram of lengths: taking lengths in descending order, every document goes to the tightest
open bin, which a segment tree over remaining capacities finds in logarithmic time; documents of one
length that meet bins of one kind are placed together. The plan has a few rows for each length, however
many documents there are. Documents then learn their bin and offset from their rank within their
length, which is counted in salted groups, so that no group of equal lengths meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import chunks
from weftline.llm.common import text_pieces, written

#: bytes of text that are looked up at once: their chunks and values stay in the processor's caches
PART = 100_000
PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


class RoomTree:
    """Segment tree over remaining capacities 0..n: which have open bins, and the least one >= a length."""

    def __init__(self, n: int) -> None:
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.open = bytearray(2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = room + self.size
        self.open[i] = there
        while i := i // 2:
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, length: int) -> int:
        """Least room >= length with an open bin, or -1."""
        i = length + self.size
        if length >= self.size:
            return -1
        while not self.open[i]:
            while i & 1:
                i //= 2
                if not i:
                    return -1
            i += 1
            if i & (i - 1) == 0:  # wrapped to the next level's first node
                return -1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, count, first_bin, per_bin, offset): documents of `length` with ranks from
    first_rank fill bins first_bin, first_bin + 1, ... with per_bin documents each, from offset on.

    It equals best-fit decreasing one document at a time (ties between equally tight bins: any).
    """
    tree = RoomTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs of bins (first, how many)
    made = 0
    rows = []

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in bins:
                bins[room] = []
                tree.set(room, True)
            bins[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:  # open as many bins as the rest needs
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            else:
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    tree.set(room, False)
            fit = room // length
            whole = min(n, left // fit)
            if whole:
                rows.append((length, rank, whole * fit, first, fit, capacity - room))
                give(room - fit * length, first, whole)
                rank, left = rank + whole * fit, left - whole * fit
            if whole < n and left:
                rows.append((length, rank, left, first + whole, left, capacity - room))
                give(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            give(room, first + whole, n - whole)
    return rows


def _bytes_of_ids(path: str | None) -> chunks.ChunkMemo:
    encoder = chunks.LibraryEncoder(path)
    return chunks.ChunkMemo(encoder, encoder.run_bytes, lambda ids: ids.tobytes(), b"".join, 600_000)


def cut(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece: ids and the end id, cut at `capacity`.

    A null or empty text is its end id alone.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = chunks.memo("bytes", lambda: _bytes_of_ids(tokenizer), tokenizer)
        step = 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for a, texts in text_pieces(batch.column(1), PART):
                words = [(t or b"").split() for t in texts]
                stops = list(accumulate(map(len, words)))
                parts = memo.values(list(chain.from_iterable(words)))
                for i, (at, stop) in enumerate(zip([0, *stops], stops), a):
                    ids = b"".join(parts[at:stop]) + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step] if len(ids) > step else ids
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, PIECE.format(kind=source.schema["doc_id"].dataType.simpleString()))


def assign(parts: DataFrame, capacity: int = 4096, salts: int | None = None) -> DataFrame:
    """`parts` (with a `length` of 1..capacity) plus sequence_id and offset.

    `parts` must be cheap and stable to read twice (a written table). Ranks within a length are counted
    in `salts` groups by a hash of the row, whose sizes are added up first: at most capacity * salts
    numbers. By default there are 2 for each of the shuffle's partitions, and at most 1,000.
    """
    spark = parts.sparkSession
    salts = salts or max(1, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2))
    salt = F.pmod(F.xxhash64(*[c for c in parts.columns]), F.lit(salts)).cast("int")
    salted = parts.withColumn("salt", salt)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    steps = np.array(sorted(plan(histogram, capacity)) or np.zeros((0, 6)), dtype=np.int64)

    ranked = salted.withColumn("place", F.row_number().over(W.partitionBy("length", "salt").orderBy(*[c for c in parts.columns])) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("before"))
    shared = spark.sparkContext.broadcast(steps)  # a few rows for each length

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        wide = np.int64(1) << 40
        i = np.searchsorted(s[:, 0] * wide + s[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        s = s[i]
        nth = rank.to_numpy() - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 3] + nth // s[:, 4], "offset": s[:, 5] + nth % s[:, 4] * s[:, 0]})

    out = ranked.withColumn("at", place("length", "rank"))
    return out.select(*parts.columns, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than `capacity` are cut. A null or empty text holds its end id alone; repeated
    rows are packed each for itself, pieces of equal length in any order; an empty table gives no rows. Texts of any length
    are taken whole. Other columns are ignored.
    """
    parts = written(cut(docs, capacity, end_id, tokenizer, doc_id, text), "pieces")
    return assign(parts, capacity)
