"""N-gram scores with contexts of unbounded length, from sharded suffix arrays.

The model: a token follows the longest context (the tokens right before it, within its document) that
occurs elsewhere in the training documents, and p = (hits + prior * p1) / (n + prior), where n counts the
other occurrences of the context, hits those of them that the token follows, and p1 is the smoothed
unigram probability. A training token's own occurrence is left out (leave-one-out), so training documents
are scored as held-out ones are: by what the rest of the corpus says.

A suffix is a position's context read backwards. Shards are ranges of suffixes, by a hash of their first
symbols, rather than groups of documents: all suffixes that share a context are in one shard, counts need no
second sum, and work grows with the corpus, not with its square. A shard sorts its suffixes; the longest match
of each is what it shares with a neighbour that counts, and the occurrences of a context are an interval.

Suffixes travel in rounds of a few symbols, and only what is still undecided goes on to the next round:
lengths 1 to 3, 4 to 8, 9 to 16, then 17 to 32, each token by its number. Longer matches are found between the
rungs of a ladder, 48, 64, 96, 128, 192, 256, 384 and so on without end, where one symbol of 40 bits stands for
the whole context of that length; the rounds after it divide what lies between two rungs, until the longest match
is known to the token. Suffixes that reach the next rung together are alike up to there: if a position's others are
all of one such kind (or one suffix), the longest match is with all of them, whatever its length, and is decided at
once; else one of a kind stands for all with its next token. A word that occurs once in all documents ends every
context, as it can be matched by none. Frequent first words are split by their second one; what is then missing for
contexts of one token, the counts of word pairs, is summed first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_of, dropped, tidy, written
from weftline.llm.ngram_join import _mix, word_hashes

#: the token at the end of a document, which no word can be
END = b"\n"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: words whose counts every task has; suffixes in a shard, about; bytes of text in a chunk
TOP, SHARD, CHUNK = 1 << 16, 900_000, 12_000_000
EXACT = (range(1, 4), range(4, 9), range(9, 17), range(17, 33))
#: rungs of a ladder, in halves of its first length; parts of what lies between two rungs
LADDER = np.array([2, 3, 4, 6, 8, 12, 16])
RUNGS = len(LADDER) - 1


def lengths(round_: int) -> range:
    """The lengths of contexts among which a round begins to look: all of them up to the last."""
    if round_ < len(EXACT):
        return EXACT[round_]
    base = EXACT[-1][-1] << 3 * (round_ - len(EXACT))
    return range(base + 1, 8 * base + 1)


def rung(first: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
    """Length of the k-th rung above `first`, for matches of `first` or more tokens and less than `first` + `gap` (0: of
    any length); a huge one if there is none."""
    step = -(-gap // (RUNGS + 1))
    return np.where(gap == 0, first * LADDER[k] // 2, np.where((k == 0) | (k * step < gap), first + k * step, 1 << 40))


def gap_above(first: np.ndarray, gap: np.ndarray, k: np.ndarray) -> np.ndarray:
    """What lies between the k-th rung and the next one (0: no end)."""
    step = -(-gap // (RUNGS + 1))
    ladder = np.append(np.diff(LADDER), 0)[k] * first // 2
    return np.where(gap == 0, ladder, np.minimum(step, gap - k * step))


def packed(a: np.ndarray, ascending: bool = False) -> bytes:
    """Bytes of `a`, each plane (all first bytes, all second ones...) for itself; of differences if it is `ascending`."""
    flat = np.ascontiguousarray(a).reshape(-1)
    if ascending and len(flat):
        flat = np.concatenate([flat[:1], flat[1:] - flat[:-1]])
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T)
    parts = [pa.compress(p, "zstd", asbytes=True) if p.any() else b"" for p in planes] if len(flat) else []
    return struct.pack(f"<q{len(parts)}i", len(flat), *map(len, parts)) + b"".join(parts)


def unpacked(b: bytes, dtype, ascending: bool = False) -> np.ndarray:
    (n,) = struct.unpack_from("<q", b)
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    sizes, at = struct.unpack_from(f"<{size}i", b, 8), 8 + 4 * size
    flat = np.zeros((n, size), np.uint8)
    for k, length in enumerate(sizes):
        if length:
            flat[:, k] = np.frombuffer(pa.decompress(memoryview(b)[at : at + length], n, "zstd", asbytes=True), np.uint8)
            at += length
    out = flat.reshape(-1).view(dtype)
    return np.cumsum(out, dtype=dtype) if ascending else out


_ZSTD = pa.Codec("zstd")


def blocks_of(columns: list[tuple[np.ndarray, bool]], cuts: np.ndarray) -> Iterator[bytes]:
    """The rows of `columns` (and whether they ascend within a block; the list is used up) in blocks between `cuts`,
    each plane for itself."""
    n = len(columns[0][0])
    starts, stops = np.append(0, cuts), np.append(cuts, n)
    planes: list[np.ndarray | None] = []
    for i, (x, ascending) in enumerate(columns):
        columns[i] = None  # not needed beside its planes
        if ascending:
            x, first = np.diff(x, prepend=x.dtype.type(0)), x[starts]
            x[starts] = first
        used = (int(x.max()).bit_length() + 7) // 8
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(n, -1)
        planes += [np.ascontiguousarray(raw[:, k]) if k < used else None for k in range(raw.shape[1])]
    del x, raw
    for start, stop in zip(starts.tolist(), stops.tolist()):
        parts = [b"" if p is None else _ZSTD.compress(p[start:stop], asbytes=True) for p in planes]
        yield struct.pack(f"<q{len(parts)}i", stop - start, *map(len, parts)) + b"".join(parts)


def columns_of(blobs: list[bytes], types: list[tuple[type, bool]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The blocks' sizes, and their columns laid end to end."""
    sizes = np.array([struct.unpack_from("<q", b)[0] for b in blobs])
    out = [np.zeros((sizes.sum(), np.dtype(t).itemsize), np.uint8) for t, _ in types]
    planes = [(x, k) for x in out for k in range(x.shape[1])]
    start = 0
    for blob, n in zip(blobs, sizes.tolist()):
        at = 8 + 4 * len(planes)
        for (x, k), length in zip(planes, struct.unpack_from(f"<{len(planes)}i", blob, 8)):
            if length:
                x[start : start + n, k] = np.frombuffer(_ZSTD.decompress(memoryview(blob)[at : at + length], n), np.uint8)
                at += length
        start += n
    done = [x.reshape(-1).view(t) for x, (t, _) in zip(out, types)]
    for x, (_, ascending) in zip(done, types):
        if ascending:
            for stop, n in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                np.cumsum(x[stop - n : stop], out=x[stop - n : stop])
    return sizes, done


def framed(parts: list[bytes]) -> bytes:
    return b"".join(x for p in parts for x in (struct.pack("<q", len(p)), p))


def frames(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        (n,) = struct.unpack_from("<q", blob, at)
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each of `x` its place among them."""
    order = np.argsort(x)
    there = x[order]
    first = np.concatenate([[True], there[1:] != there[:-1]]) if len(x) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(first) - 1
    return there[first], place


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary `texts` (A-Z lowered, runs without ASCII white space) end to end, and how many each text has."""
    plain = texts.fill_null(b"").cast(pa.string(), safe=False)  # any bytes: these functions look at ASCII alone
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(plain))
    lists = pc.ascii_split_whitespace(trimmed)
    words, lens = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    blank = pc.binary_length(trimmed).to_numpy() == 0  # split into one empty word
    if blank.any():
        words, lens = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(blank, 0, lens)
    return words, lens


def numbered_words(parts: list[pa.Array], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of `parts` and of END, each made once; the texts' tokens as places among them, END after each text."""
    coded = pa.chunked_array(parts, pa.string()).dictionary_encode().chunks  # all have one dictionary
    words = coded[0].dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist() if coded else []
    tokens = np.full(lens.sum() + len(lens), len(words), np.int32)
    is_word = np.ones(len(tokens), bool)
    is_word[np.cumsum(lens + 1) - 1] = False
    tokens[is_word] = np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded)])
    return word_hashes([*words, END]), tokens


def _rows(run, names: list[str], types: list[pa.DataType]):
    """A function over batches from one over a row's values, which yields dicts."""

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in them:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                for out in run(*row):
                    yield pa.RecordBatch.from_arrays([pa.array([out.get(n)], t) for n, t in zip(names, types)], names)

    return batches


def _tokenised(docs: DataFrame, shards: int, folds: int) -> DataFrame:
    """For chunks of about CHUNK bytes of text: a row with the documents as numbers of a sorted dictionary, and
    rows with the dictionary's part in each shard and its counts. Equal documents of a chunk are kept once."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    names = ["chunk", "shard", "ids", "a", "b", "c"]
    types = [pa.string(), pa.int32(), pa.list_(to_arrow_type(kind)), pa.binary(), pa.binary(), pa.binary()]
    cuts = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)

    def rows(name: str, ids: list, parts: list[pa.Array], lens: np.ndarray) -> Iterator[list]:
        hashes, tokens = numbered_words(parts, lens)
        lens = lens + 1
        first: dict[tuple, int] = {}
        stops = np.cumsum(lens)
        of = np.array([first.setdefault((xxhash.xxh3_128_digest(tokens[a:b]), crc_of(d) % folds == 0), len(first)) for d, a, b in zip(ids, (stops - lens).tolist(), stops.tolist())])
        own = np.unique(of, return_index=True)[1]  # a document for each that differs
        held = np.array([h for _, h in first])
        times = np.bincount(of)
        if len(own) < len(ids):
            kept = np.zeros(len(ids), bool)
            kept[own] = True
            tokens, lens = tokens[np.repeat(kept, lens)], lens[own]
        dictionary, place = distinct(hashes)
        local = place.astype(np.uint32)[tokens]
        of_token = np.repeat(np.arange(len(own)), lens)
        count = lambda w: np.bincount(local, w[of_token], len(dictionary)).astype(np.uint64)
        train, rest = count(np.where(held, 0, times)), count(np.where(held, times, 0))
        yield [name, None, ids, packed(local), packed(of.astype(np.uint32)), packed(np.stack([lens, held, times]).astype(np.int64))]
        ends = np.searchsorted(dictionary, cuts)
        for s, (part, n, m) in enumerate(zip(*[np.split(x, ends) for x in (dictionary, train, rest)])):
            if len(part):
                yield [name, s, None, packed(part, True), packed(n), packed(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[pa.Array] = []
        lens: list[np.ndarray] = []
        size = made = 0
        task = TaskContext.get().partitionId()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            made += 1
            for row in rows(f"{task}.{made}", ids, parts, np.concatenate(lens)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for batch in batches:
            own, of = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(of), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            a = done = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(sizes, done + 1_000_000, "right")))
                words, n = split_words(of.slice(a, b - a))
                ids += own[a:b]
                parts.append(words)
                lens.append(n)
                size += int(sizes[b - 1]) - done
                a, done = b, int(sizes[b - 1])
                if size > CHUNK:
                    yield from out()
                    ids, parts, lens, size = [], [], [], 0
        if ids:
            yield from out()

    return docs.mapInArrow(run, f"chunk string, shard int, ids array<{kind.simpleString()}>, a binary, b binary, c binary")


def _numbered(parts: DataFrame, shards: int) -> DataFrame:
    """Per shard of words: each chunk's words with their counts in training documents and their numbers (frequent
    words have low ones; 0: the word occurs once in all documents), the shard's sums and its top counts."""

    def total(t: pa.Table) -> pa.Table:
        hashes = [unpacked(x, np.uint64, True) for x in t.column("a").to_pylist()]
        words, at = distinct(np.concatenate(hashes))
        train, rest = (np.bincount(at, np.concatenate([unpacked(x, np.uint64) for x in t.column(c).to_pylist()]), len(words)).astype(np.int64) for c in "bc")
        many = np.flatnonzero(train + rest > 1)
        many = many[np.argsort(-train[many], kind="stable")]
        number = np.zeros(len(words), np.int64)
        number[many] = 1 + np.arange(len(many)) * shards + t.column("shard")[0].as_py()
        if len(many) and number.max() >= 1 << 32:
            raise ValueError("more than 2^32 different words that repeat")
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        each = lambda x, kind: pa.array([packed(x[p].astype(kind)) for p in np.split(at, ends)], pa.binary())
        once = lambda x: [x] + [None] * (len(t) - 1)
        return pa.table(
            {
                "chunk": t.column("chunk"), "shard": t.column("shard"), "counts": each(train, np.uint64), "numbers": each(number, np.uint32),
                "n": pa.array(once(int(train.sum())), pa.int64()), "v": pa.array(once(int((train > 0).sum())), pa.int64()), "every": pa.array(once(int((train + rest).sum())), pa.int64()),
                "top": pa.array(once(packed(train[many[: max(1, TOP // shards)]])), pa.binary()),
            }
        )

    return parts.groupBy("shard").applyInArrow(total, "chunk string, shard int, counts binary, numbers binary, n long, v long, every long, top binary")


def _chunks(table: DataFrame, numbered: DataFrame, n: int, v: int, tops: int) -> DataFrame:
    """A row for each chunk: its documents (`ids`, `docs`) and its tokens' numbers, with the counts of those beyond `tops`."""
    kind = table.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["chunk", "ids", "docs", "tokens", "rare", "shape"]
    types = [pa.string(), pa.list_(to_arrow_type(kind)), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def one(chunk: str, ids: list, a: bytes, b: bytes, c: bytes, parts: list) -> Iterator[dict]:
        parts = sorted(parts, key=lambda x: x["shard"])
        count, number = (np.concatenate([unpacked(x[k], t) for x in parts]) for k, t in (("counts", np.uint64), ("numbers", np.uint32)))
        local = unpacked(a, np.uint32)
        lens, held, times = unpacked(c, np.int64).reshape(3, -1)
        starts = np.cumsum(lens) - lens
        log_p = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        base, known = np.add.reduceat(log_p[local], starts), np.add.reduceat((count > 0)[local].astype(np.int64), starts)
        rare = np.where((number > 0) & (number <= tops), 0, np.minimum(count, 0xFFFFFFFF)).astype(np.uint32)  # a rarer word's count is far below 2^32
        yield dict(chunk=chunk, ids=ids, docs=framed([b, packed(base), packed(known)]), tokens=packed(number[local]), rare=packed(rare[local]), shape=c)

    lists = numbered.groupBy("chunk").agg(F.collect_list(F.struct("shard", "counts", "numbers")).alias("parts"))
    named = table.where("shard is null").join(lists, "chunk").select("chunk", "ids", "a", "b", "c", "parts")
    return named.mapInArrow(_rows(one, names, types), f"chunk string, ids array<{kind.simpleString()}>, docs binary, tokens binary, rare binary, shape binary")


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hashes' base, and of its inverse; a worker keeps the longest it has made."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, _BACK)]
    return _POWERS[0][:n], _POWERS[1]


class Chunk:
    """A chunk's tokens, and how long the context before each is: up to a document's start or a word that occurs once."""

    def __init__(self, tokens: bytes, rare: bytes, shape: bytes) -> None:
        self.tokens, self.rare = unpacked(tokens, np.uint32), unpacked(rare, np.uint32)
        self.lens, self.held, self.times = unpacked(shape, np.int64).reshape(3, -1)
        place = np.arange(len(self.tokens), dtype=np.int32)
        begin = np.zeros(len(place), bool)
        begin[np.cumsum(self.lens) - self.lens] = True
        begin[1:] |= self.tokens[:-1] == 0
        self.before = place - np.maximum.accumulate(np.where(begin, place, np.int32(0)))
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.uint32), self.lens)
        self._sums = None

    def token(self, rows: np.ndarray, before: np.ndarray, back: int) -> np.ndarray:
        """The token `back` places before each of `rows`, whose contexts are `before` long; 0 where there is none."""
        out = self.tokens.take(rows - back, mode="clip")
        short = before < back
        if short.any():
            out[short] = 0
        return out

    def hashed(self, rows: np.ndarray, before: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64-bit hash of the last `length` tokens (a number for each) before each of `rows`, whose contexts are `before` long; 0 where
        there are fewer."""
        if self._sums is None:
            powers, self._back = _powers(len(self.tokens))
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.tokens.astype(np.uint64)) * powers)])
        out = np.zeros(len(rows), np.uint64)
        fit = before >= length
        end, length = rows[fit], length[fit]
        start = end - length
        out[fit] = np.maximum(_mix((self._sums[end] - self._sums[start]) * self._back[start] + length.astype(np.uint64)), np.uint64(1))
        return out


def _hot_pairs(c: Chunk, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows after a hot word, their pairs' places among the chunk's distinct pairs (by shard), those, and their shards."""
    rows = np.flatnonzero(c.before >= 1)
    first = c.tokens[rows - 1]
    rows = rows[hot[np.minimum(first, len(hot) - 1)]]
    pairs = c.tokens[rows - 1].astype(np.uint64) << np.uint64(32) | c.tokens[rows]
    own, at = distinct(pairs)
    shard = (_mix(own) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return rows, place[at], own[order], shard[order]


def _pair_counts(chunks: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """(chunk, shard, a): occurrences in training documents of the chunk's pairs that begin with a hot word."""

    def send(chunk: str, *cols: bytes) -> Iterator[dict]:
        c = Chunk(*cols)
        rows, place, own, shard = _hot_pairs(c, hot, shards)
        n = np.bincount(place, np.where(c.held, 0, c.times)[c.doc[rows]], len(own)).astype(np.uint64)
        cuts = np.searchsorted(shard, np.arange(1, shards))
        for s, (keys, times) in enumerate(zip(np.split(own, cuts), np.split(n, cuts))):
            if len(keys):
                yield dict(chunk=chunk, shard=s, a=packed(keys, True), b=packed(times))

    def total(t: pa.Table) -> pa.Table:
        keys = [unpacked(x, np.uint64, True) for x in t.column("a").to_pylist()]
        words, at = distinct(np.concatenate(keys))
        sums = np.bincount(at, np.concatenate([unpacked(x, np.uint64) for x in t.column("b").to_pylist()]), len(words)).astype(np.uint64)
        parts = [packed(sums[p]) for p in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "a": pa.array(parts, pa.binary())})

    names, types = ["chunk", "shard", "a", "b"], [pa.string(), pa.int32(), pa.binary(), pa.binary()]
    sent = chunks.select("chunk", "tokens", "rare", "shape").mapInArrow(_rows(send, names, types), "chunk string, shard int, a binary, b binary")
    return sent.groupBy("shard").applyInArrow(total, "chunk string, shard int, a binary")


OPEN, HELD, COUNTS = 1, 2, 4
#: what is told of a place that goes on: itself, its flags, how long its match is at least and how far it may go, its weight
GOING = [(np.uint32, True), (np.uint8, False), (np.uint32, False), (np.uint32, False), (np.uint32, False)]


def width(round_: int) -> int:
    """Numbers of four bytes that a round's rows have to be sorted by; places on the ladder hold where they are on it, too."""
    return len(EXACT[round_]) + (0, 3, 2, 2)[round_] if round_ < len(EXACT) else 2 * (1 + RUNGS + 2)


def shards_of(suffixes: int, round_: int = 0) -> int:
    """Shards of a round, by how wide its rows are: a task holds about the bytes of SHARD suffixes of round 1 in each."""
    return max(1, -(-suffixes * max(8, width(round_)) // (8 * SHARD)))


def _first(c: Chunk, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of round 0, by shard, and their shards."""
    rows = np.flatnonzero(c.before >= 1)
    first = c.tokens[rows - 1]
    key = first.astype(np.uint64)
    is_hot = hot[np.minimum(first, len(hot) - 1)]
    key[is_hot] = _mix(key[is_hot]) + c.token(rows[is_hot], c.before[rows[is_hot]], 2)
    shard = (_mix(key) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    return rows[order], shard[order]


def labels(spark, shards: int) -> np.ndarray:
    """Numbers for about `shards` shards (or more, up to a multiple of the partitions) which Spark's hash deals out evenly."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = -(-shards // parts)
    wanted = min(shards, parts)
    found: dict[int, list[int]] = {}
    tried, step = 0, 16 * parts * each
    while len(found) < wanted or sum(len(x) for x in found.values()) < wanted * each:
        rows = spark.range(tried, tried + step).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(parts)).alias("part")).collect()
        for label, part in sorted(rows):
            if (part in found or len(found) < wanted) and len(own := found.setdefault(part, [])) < each:
                own.append(label)
        tried += step
    return np.sort(np.array([x for own in found.values() for x in own], np.int32))


def _suffixes(chunks: DataFrame, told: DataFrame, round_: int, names_: np.ndarray, first_names: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(chunk, shard, blob): the suffixes of a round; shards are named by labels. `told` (chunk, shard, a) has the counts of hot pairs in
    round 0, then the flags of round 0's places, later the places that the round before left open (GOING)."""
    shards, first_shards = len(names_), len(first_names)
    exact = round_ < len(EXACT)
    here = EXACT[round_] if exact else range(1, RUNGS + 1)
    names, types = ["chunk", "shard", "blob"], [pa.string(), pa.int32(), pa.binary()]

    def send(chunk: str, tokens: bytes, rare: bytes, shape: bytes, parts: list | None) -> Iterator[dict]:
        c = Chunk(tokens, rare, shape)
        parts = sorted(parts or [], key=lambda x: x["shard"])
        pairs = weight = first = gap = None
        if not round_:
            rows, shard = _first(c, hot, shards)
            flags = np.where(c.held[c.doc[rows]], OPEN | HELD, OPEN).astype(np.uint8)
            pairs = np.zeros(len(c.tokens), np.uint64)
            if parts:
                found, place, _, _ = _hot_pairs(c, hot, shards)
                pairs[found] = np.concatenate([unpacked(x["a"], np.uint64) for x in parts])[place]
            before = c.before[rows]
            columns = [c.token(rows, before, k) for k in here]
        else:
            if round_ == 1:
                rows, shard = _first(c, hot, first_shards)
                flags = np.zeros(len(rows), np.uint8)
                for x in parts:
                    own = np.searchsorted(first_names, x["shard"])  # labels ascend
                    start, stop = np.searchsorted(shard, [own, own + 1])
                    flags[start:stop] = columns_of([x["a"]], [(np.uint8, False)])[1][0]
                rows, flags = rows[flags > 0], flags[flags > 0]
            else:
                _, (rows, flags, first, gap, weight) = columns_of([x["a"] for x in parts], GOING)
            order = np.argsort(rows)
            rows, flags = rows[order].astype(np.int64), flags[order] & np.uint8(OPEN | HELD)
            if round_ > 1:
                first, gap, weight = first[order].astype(np.int64), gap[order].astype(np.int64), weight[order]
            before = c.before[rows]
            if round_ == 1:  # tokens from the first on
                columns = [c.token(rows, before, k) for k in range(1, here[-1] + 1)]
                key = _mix(_mix(columns[0].astype(np.uint64)) + columns[1]) + columns[2]
            elif exact:
                key = c.hashed(rows, before, first)
                columns = [key] + [c.token(rows, before, k) for k in here]
            else:
                key = _mix(c.hashed(rows, before, first) + gap.astype(np.uint64))
                columns, valid, last = [key], np.zeros(len(rows), np.uint8), first.copy()
                for k in here:
                    length = rung(first, gap, k)
                    columns.append(c.hashed(rows, before, length) >> np.uint64(24))
                    reached = before >= length
                    valid += reached
                    np.copyto(last, length, where=reached)
                valid = valid * np.uint8(2) + (before > last)
            shard = (_mix(key) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)
            order = np.argsort(shard, kind="stable")
            rows, flags, before, shard, columns = rows[order], flags[order], before[order], shard[order], [x[order] for x in columns]
            if round_ > 1:
                first, gap, weight = first[order], gap[order], weight[order]
            if not exact:
                valid = valid[order]
        if not len(rows):
            return
        if exact:  # how many of the lengths lie in the context, and whether it goes beyond the last of them
            valid = np.clip(before - (here[0] - 1), 0, len(here)).astype(np.uint8) * np.uint8(2) + (before > here[-1])
        cuts = np.flatnonzero(np.diff(shard)) + 1
        doc = c.doc[rows]
        if weight is None:
            weight = np.where(c.held, 0, c.times).astype(np.uint32)[doc]
        sent = [(doc, True), (flags, False), (valid, False), (weight, False), (c.tokens[rows], False), (c.rare[rows], False)]
        sent += [(pairs[rows], False)] if pairs is not None else [(rows.astype(np.uint32), True)]
        sent += [] if exact else [(first.astype(np.uint32), False), (gap.astype(np.uint32), False)]
        sent += [(x, False) for x in columns]
        chunk_of = names_[shard[np.append(0, cuts)]].tolist()
        del c, rows, doc, flags, valid, before, pairs, weight, first, gap, columns, shard  # a worker's memory is small
        for s, blob in zip(chunk_of, blocks_of(sent, cuts)):
            yield dict(chunk=chunk, shard=s, blob=blob)

    lists = told.groupBy("chunk").agg(F.collect_list(F.struct("shard", "a")).alias("parts"))
    joined = chunks.select("chunk", "tokens", "rare", "shape").join(lists, "chunk", "inner" if round_ else "left")
    return joined.mapInArrow(_rows(send, names, types), "chunk string, shard int, blob binary")


def _slim(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """The chunks that have places among `told` (GOING), with 0 for the tokens of their documents that have none: few bytes."""

    def one(chunk: str, tokens: bytes, rare: bytes, shape: bytes, parts: list[bytes]) -> Iterator[dict]:
        lens = unpacked(shape, np.int64).reshape(3, -1)[0]
        stops = np.cumsum(lens)
        some = np.zeros(len(lens), bool)
        for x in parts:
            some[np.searchsorted(stops, columns_of([x], GOING)[1][0], "right")] = True
        some = np.repeat(some, lens)
        yield dict(chunk=chunk, shape=shape, **{k: packed(np.where(some, unpacked(x, np.uint32), np.uint32(0))) for k, x in (("tokens", tokens), ("rare", rare))})

    lists = told.groupBy("chunk").agg(F.collect_list("a").alias("parts"))
    joined = chunks.select("chunk", "tokens", "rare", "shape").join(lists, "chunk")
    return joined.mapInArrow(_rows(one, ["chunk", "tokens", "rare", "shape"], [pa.string()] + [pa.binary()] * 3), "chunk string, tokens binary, rare binary, shape binary")


def grouping(columns: list[np.ndarray]) -> np.ndarray:
    """An order in which rows with equal first columns lie together, among them those with equal second ones, and so on.

    Columns of unsigned numbers are packed into keys of 64 bits; a prefix that fills one becomes its rank.
    """
    n = len(columns[0])
    place = np.arange(n, dtype=np.uint64)
    place_bits, key, bits, order = max(1, (n - 1).bit_length()), None, 0, None

    def ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        if bits + place_bits <= 64:  # a sort of numbers is faster than one of places
            there = np.sort(key << np.uint64(place_bits) | place)
            order = (there & np.uint64((1 << place_bits) - 1)).astype(np.int64)
            there >>= np.uint64(place_bits)
        else:
            order = np.argsort(key)
            there = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], there[1:] != there[:-1]]))
        return rank, max(1, int(rank[order[-1]]).bit_length())

    for i, x in enumerate(columns):
        own = max(1, int(x.max()).bit_length())
        if key is not None and bits + own > 64:
            key, bits = ranked(key, bits)
        if bits + own > 64:  # a hash
            x, own = ranked(x, own)
        key, bits = (x.astype(np.uint64), own) if key is None else (key << np.uint64(own) | x.astype(np.uint64), bits + own)
    if bits + place_bits > 64:
        return np.argsort(key)
    order = np.sort(key << np.uint64(place_bits) | place)
    return (order & np.uint64((1 << place_bits) - 1)).astype(np.int64)


def resolve(
    columns: list[np.ndarray], known: int, weight: np.ndarray, flags: np.ndarray, valid: np.ndarray, token: np.ndarray, p: np.ndarray, prior: float,
    hot_n: np.ndarray | None = None, hot_hits: np.ndarray | None = None, first: np.ndarray | None = None, gap: np.ndarray | None = None,
) -> tuple[np.ndarray, list[np.ndarray]]:
    """For suffixes with `columns` (the first `known` of them are matched already; the list is used up): what the longest context adds
    to each one's score if it is found now (0 otherwise), and which suffixes go on: their places (in order), the
    levels from which they do, their flags and their weights.

    `weight` is how often a suffix stands for itself in training documents. `valid` is twice the number of columns after the known
    ones that lie in the context, and one more if it goes beyond them. Only OPEN suffixes ask; others are there to be counted.
    `hot_n` > 0: the occurrences of the first token, which are not all here, with `hot_hits` of its pair.
    Without `first` and `gap` (see rung), every length from the known ones to the last column's has one.
    """
    size, m = len(token), len(columns) - known
    last = m
    order = grouping(columns)
    weight, flags, more, valid = weight[order], flags[order], (valid[order] & 1) > 0, valid[order] >> 1
    own = (flags & HELD) == 0
    asks = (flags & OPEN) > 0
    level = np.zeros(size, np.int8)
    new = np.zeros(size, bool)
    new[0] = True
    heads, counts = [], []

    def differs(x: np.ndarray) -> None:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]

    for x in columns[:known]:
        differs(x)
    for j in range(m + 1):
        if j:
            differs(columns[known + j - 1])
        head = np.flatnonzero(new)
        count = np.add.reduceat(weight, head, dtype=np.int64)
        heads.append(head)
        counts.append(count)
        if j:
            other = np.repeat(count, np.diff(head, append=size)) > own
            if j == 1 and hot_n is not None:
                other |= hot_n[order] > own
            other &= valid >= j
            other &= level == j - 1
            if not other.any():
                m = j
                break
            level += other
    columns.clear()
    sizes = lambda j: np.diff(heads[j], append=size)
    going: list[tuple[np.ndarray, ...]] = []
    for j in range(m + 1) if first is not None else [last] if m == last else []:
        wants = asks & (level == j) & ((valid > j) | more)
        if first is not None:
            wants &= gap_above(first, gap, np.int64(j))[order] != 1
        if not wants.any():
            continue
        # suffixes that reach the next rung together are alike as far as these look: one kind, as is a document's own copies
        reach = valid > j if j < m else np.zeros(size, bool)
        kind = (weight > 0) & ~reach
        if reach.any():
            child = np.repeat(np.arange(len(heads[j + 1])), sizes(j + 1))
            there = np.flatnonzero(reach & (weight > 0))
            kind[there[np.diff(child[there], prepend=-1) != 0]] = True
        # if there is one other kind, it is the longest match's, whatever its length
        wants &= np.repeat(np.add.reduceat(kind, heads[j], dtype=np.int64), sizes(j)) - (weight > 0) + (weight > 1) > 1
        if not wants.any():
            continue
        rest = np.flatnonzero(np.repeat(np.logical_or.reduceat(wants, heads[j]), sizes(j)) & ~wants & (weight > 0))
        of_rest = weight[rest]
        if (alike := reach[rest]).any():  # one of a kind for each next token
            short, far = rest[~alike], rest[alike]
            group, there = child[far].astype(np.uint64), token[order[far]]
            by = grouping([group, there])
            head = np.flatnonzero(np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(there[by]) != 0)]))
            rest = np.concatenate([short, far[by][head]])
            of_rest = np.concatenate([weight[short], np.add.reduceat(weight[far][by], head, dtype=np.uint32)])
        on = np.flatnonzero(wants)
        flag = np.concatenate([flags[on] & np.uint8(HELD) | np.uint8(OPEN | COUNTS), np.full(len(rest), COUNTS, np.uint8)])
        going.append((order[np.concatenate([on, rest])], np.full(len(flag), j, np.int64), flag, np.concatenate([weight[on], of_rest])))
        asks &= ~wants
    gain = np.zeros(size)
    for j in range(0 if known else 1, m + 1):
        mine = asks & (level == j)
        if not mine.any():
            continue
        few = np.logical_or.reduceat(mine, heads[j])
        some = np.repeat(few, sizes(j))
        at = np.flatnonzero(some)
        group = np.repeat(np.arange(few.sum(), dtype=np.uint64), sizes(j)[few])
        there = order[at]
        next_token = token[there]
        by = grouping([group, next_token])
        head = np.flatnonzero(np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(next_token[by]) != 0)]))
        hits = np.empty(len(at), np.int64)
        hits[by] = np.repeat(np.add.reduceat(weight[at][by], head, dtype=np.int64), np.diff(head, append=len(at)))
        n = np.repeat(counts[j][few], sizes(j)[few])
        asked = mine[at]
        to, n, hits, one = there[asked], n[asked], hits[asked], own[at][asked]
        if not known and j == 1 and hot_n is not None:
            is_hot = hot_n[to] > 0
            n, hits = np.where(is_hot, hot_n[to], n), np.where(is_hot, hot_hits[to], hits)
        n, hits = n - one, np.where(token[to] == 0, 0, hits - one)
        gain[to] = np.log10((hits + prior * p[to]) / (n + prior)) - np.log10(p[to])
    if not going:
        return gain, [np.zeros(0, t) for t in (np.int64, np.int64, np.uint8, np.uint32)]
    if len(going) == 1:  # no place is there twice
        at = np.full(size, -1, np.int64)
        at[going[0][0]] = np.arange(len(going[0][0]))
        by = at[at >= 0]
    else:
        by = np.argsort(np.concatenate([x[0] for x in going]), kind="stable")
    return gain, [np.concatenate(x)[by] for x in zip(*going)]


def _resolved(sent: DataFrame, round_: int, n: int, v: int, prior: float, tops, hot: np.ndarray) -> DataFrame:
    """(chunk, shard, gains, a, going): by chunk, sums of what was found for its documents, and the places
    that stay open, as GOING tells them (in round 0: the flags of all places)."""
    known, exact = (0, 3)[round_] if round_ < 2 else 1, round_ < len(EXACT)
    wide = len(EXACT[round_]) if exact else RUNGS
    types = [(np.uint32, True), (np.uint8, False), (np.uint8, False), (np.uint32, False), (np.uint32, False), (np.uint32, False)]
    types += [(np.uint32, True) if round_ else (np.uint64, False)] + [(np.uint32, False)] * (0 if exact else 2)
    types += [(np.uint32 if round_ < 2 else np.uint64, False)] * known + [(np.uint32 if exact else np.uint64, False)] * wide

    def search(t: pa.Table) -> pa.Table:
        sizes, cols = columns_of([x.as_buffer() for x in t.column("blob")], types)
        t = t.select(["chunk", "shard"])
        doc, flags, valid, weight, token, rare, extra = cols[:7]
        first, gap = (None, None) if exact else (x.astype(np.int64) for x in cols[7:9])
        columns = cols[7 if exact else 9 :]
        del cols
        top = tops.value
        count = np.where((token > 0) & (token < len(top)), top[np.minimum(token, len(top) - 1)], rare.astype(np.int64))
        p = (count + 0.1) / (n + 0.1 * (v + 1))
        del count, rare
        hot_n = hot_hits = None
        if not round_ and hot.any():
            word = np.minimum(columns[0], len(top) - 1)
            hot_n, hot_hits = np.where(hot[np.minimum(columns[0], len(hot) - 1)], top[word], 0), extra.astype(np.int64)
        gain, (on, at, after, still) = resolve(columns, known, weight, flags, valid, token, p, prior, hot_n, hot_hits, first, gap)
        stops = np.cumsum(sizes)

        def by_chunk(at: np.ndarray, columns: list[tuple[np.ndarray, bool]]) -> tuple[list, np.ndarray]:
            """A blob of `columns` for each chunk that has some of the rows `at`, and how many it has."""
            blobs: list = [None] * len(sizes)
            many = np.diff(np.searchsorted(at, stops), prepend=0)
            there = np.flatnonzero(many)
            if len(there):
                for i, blob in zip(there.tolist(), blocks_of(columns, np.cumsum(many[there])[:-1])):
                    blobs[i] = blob
            return blobs, many

        g = np.flatnonzero(gain)
        owner = np.searchsorted(stops, g, "right") << 32 | doc[g]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        sums = np.add.reduceat(gain[g], heads).astype(np.float32) if len(g) else np.zeros(0, np.float32)
        gains, _ = by_chunk(g[heads], [(doc[g[heads]], True), (sums.view(np.uint32), False)])
        if round_:
            if exact:
                first, gap = np.full(len(on), EXACT[round_][-1]), np.zeros(len(on), np.int64)
            else:
                first, gap = np.where(gap[on] == 0, first[on] * LADDER[at] // 2, first[on] + at * -(-gap[on] // (RUNGS + 1))), gap_above(first[on], gap[on], at)
            a, going = by_chunk(on, [(extra[on], True), (after, False), (first.astype(np.uint32), False), (gap.astype(np.uint32), False), (still, False)])
        else:  # flags for all of a chunk's places, which it can tell without being told
            going = np.diff(np.searchsorted(on, stops), prepend=0)
            every = np.zeros(len(token), np.uint8)
            every[on] = after
            a = [blob if n else None for blob, n in zip(blocks_of([(every, False)], stops[:-1]), going.tolist())]
        return pa.table({"chunk": t.column("chunk"), "shard": t.column("shard"), "gains": pa.array(gains, pa.binary()), "a": pa.array(a, pa.binary()), "going": pa.array(going, pa.int64())})

    return sent.groupBy("shard").applyInArrow(search, "chunk string, shard int, gains binary, a binary, going long")


def _summed(found: DataFrame) -> DataFrame:
    """(chunk, gains): what a round found for each document of a chunk."""

    def one(chunk: str, parts: list[bytes]) -> Iterator[dict]:
        _, (doc, gain) = columns_of(parts, [(np.uint32, True), (np.float32, False)])
        yield dict(chunk=chunk, gains=packed(np.bincount(doc, gain)))

    lists = found.where("gains is not null").groupBy("chunk").agg(F.collect_list("gains").alias("parts"))
    return lists.mapInArrow(_rows(one, ["chunk", "gains"], [pa.string(), pa.binary()]), "chunk string, gains binary")


def _documents(chunks: DataFrame, gains: DataFrame, n: int) -> DataFrame:
    kind = chunks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, docs, shape, parts in zip(*[c.to_pylist() for c in batch.columns]):
                of, base, known = (unpacked(x, t) for x, t in zip(frames(docs), (np.uint32, np.float64, np.int64)))
                lens, held, _ = unpacked(shape, np.int64).reshape(3, -1)
                score = base.copy()
                for x in parts or []:
                    gain = unpacked(x, np.float64)
                    score[: len(gain)] += gain
                cols = [pa.array(ids, to_arrow_type(kind)), pa.array(held[of].astype(bool)), pa.array(lens[of]), pa.array(known[of]), pa.array(np.full(len(of), n)), pa.array(base[of]), pa.array(score[of])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    lists = gains.groupBy("chunk").agg(F.collect_list("gains").alias("parts"))  # as many as there are rounds
    joined = chunks.select("chunk", "ids", "docs", "shape").join(lists, "chunk", "left").select("ids", "docs", "shape", "parts")
    return joined.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, folds: int = 10, prior: float = 5.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Documents whose crc32(doc_id as text) mod `folds` is not 0 are learnt from. Tokens are the words (A-Z
    lowered, runs without ASCII white space) and one end; a null or blank text is its end alone. A null
    id counts as empty text; repeated rows each count, also as evidence for one another; an empty table gives
    no rows; without training documents every probability is 1. Texts of any length are taken whole; a
    document is never cut, so one must fit a worker. Other columns are ignored. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with tidy(spark):
        source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
        table = written(_tokenised(source, parts, folds), "words", "uncompressed")
        numbered = written(_numbered(table.where("shard is not null").select("chunk", "shard", "a", "b", "c"), parts), "numbers", "uncompressed")
        n, v, every = numbered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "every")]).first()
        per = max(1, TOP // parts)
        top = np.zeros(1 + per * parts, np.int64)  # TOP counts, or one for each shard
        for r in numbered.where("top is not null").select("shard", "top").collect():
            own = unpacked(r.top, np.int64)
            top[1 + r.shard + np.arange(len(own)) * parts] = own
        chunks = written(_chunks(table, numbered, n, v, per * parts), "chunks", "uncompressed")
        dropped(table, numbered)
        names_ = first_names = labels(spark, shards_of(every))
        hot = top * 2 * len(names_) > max(n, 2 * len(names_))
        hot[-1] = False  # stands for all rarer words
        tops = spark.sparkContext.broadcast(top)
        before = written(_pair_counts(chunks, hot, len(names_)), "pairs", "uncompressed") if hot.any() else None
        told = before if before is not None else spark.createDataFrame([], "chunk string, shard int, a binary")
        gains, round_, open_ = [], 0, chunks
        while True:
            found = written(_resolved(_suffixes(open_, told, round_, names_, first_names, hot), round_, n, v, prior, tops, hot), f"found{round_}", "uncompressed")
            if before is not None:
                dropped(before)
            before = found
            gains.append(written(_summed(found), f"gains{round_}", "uncompressed"))
            going = found.agg(F.coalesce(F.sum("going"), F.lit(0))).first()[0]
            if not going:
                break
            told = found.where("going > 0").select("chunk", "shard", "a")
            names_, round_ = labels(spark, shards_of(going, round_ + 1)), round_ + 1
            if round_ == len(EXACT):  # few documents have matches that long
                open_ = written(_slim(chunks, told), "open", "uncompressed")
        dropped(before)
        if open_ is not chunks:
            dropped(open_)
        every_gain = gains[0]
        for g in gains[1:]:
            every_gain = every_gain.union(g)
        return _documents(chunks, every_gain, n)
