"""Quality classifier: a factorisation machine over hashed words, structure and size.

score = sigmoid(bias + <w, x> + sum over pairs <v_i, v_j> x_i x_j); the pairs cost one pass over the
features, since their sum is half the difference between the squared sum and the sum of squares of v_i x_i.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import claim, crc_bucket, text_pieces

BUCKETS = 1 << 16
#: structure and metadata features, after the words
DENSE = 16
_WORDS: dict[bytes, int] = {}
_SIGN = re.compile(rb"[^A-Za-z0-9\x80-\xff]")


def _of_word(w: bytes) -> int:
    """Bucket, and above it class bits: letters only, signs at the end, capitals, digits, one sign, repeated sign."""
    core = w.strip(b".,;:!?\"'()")
    signs = len(_SIGN.findall(w))
    bits = (
        (signs == 0)
        | (len(w) - len(w.rstrip(b"!#$%&*|~^@")) >= 2) << 1
        | (w.isupper() and len(core) > 1) << 2
        | any(48 <= c < 58 for c in w) << 3
        | (signs == len(w)) << 4
        | (signs > 2) << 5
        | (len(w) > 16) << 6
        | w[-1:].endswith((b".", b",", b"?")) << 7
    )
    return zlib.crc32(core.lower()) % BUCKETS + bits * BUCKETS


def _learn(words: Iterator[bytes]) -> None:
    claim("words", _WORDS.clear)
    if len(_WORDS) > 300_000:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = _of_word(w)


def features(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: distinct hashed words with log-scaled frequencies of unit length, then structure."""
    n = len(words)
    counts = Counter(words)
    bits, buckets = np.divmod(np.fromiter(map(_WORDS.__getitem__, counts), np.int64, len(counts)), BUCKETS)
    times = np.fromiter(counts.values(), np.float32, len(counts))
    idx, at = np.unique(buckets, return_inverse=True)
    val = np.log1p(np.bincount(at, times, len(idx))).astype(np.float32)
    if n:
        val /= np.sqrt((val * val).sum())
    share = [float((times * (bits >> b & 1)).sum()) / max(n, 1) for b in range(8)]
    lines = text.split(b"\n")
    dense = np.array(
        [
            *share,
            len(counts) / max(n, 1),
            min(1.0, np.log1p(n) / 12),
            len(set(lines)) / len(lines),
            min(1.0, len(text) / max(n, 1) / 20),
            min(1.0, n / len(lines) / 100),
            float(times.max()) / n if n else 0.0,
            float(n < 5),
            float(n == 0),
        ],
        np.float32,
    )
    return np.concatenate([idx, BUCKETS + np.arange(DENSE)]), np.concatenate([val, dense])


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        idx, val = (np.concatenate(x) for x in zip(*sets))
        starts = np.cumsum([0] + [len(i) for i, _ in sets[:-1]])
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        raw = self.bias + np.add.reduceat(self.w[idx] * val, starts) + pairs
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -35, 35)))


def fit(sets: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on log loss, in batches of 64, both labels weighing the same in total (up to a factor 8).

    Without labels every score is 0.5; with one label only, the machine leans that way.
    """
    rng = np.random.default_rng(seed)
    size = BUCKETS + DENSE
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32))
    if not len(labels):
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(size, 1e-4, np.float32), np.full((size, rank), 1e-4, np.float32), 1e-4
    share = labels.mean()
    weight = np.where(labels == 1, min(8, 0.5 / max(share, 1e-9)), min(8, 0.5 / max(1 - share, 1e-9))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), 64):
            rows = order[start : start + 64]
            idx, val = (np.concatenate(x) for x in zip(*[sets[r] for r in rows]))
            lens = np.array([len(sets[r][0]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            vx = m.v[idx] * val[:, None]
            total = np.add.reduceat(vx, starts)
            raw = m.bias + np.add.reduceat(m.w[idx] * val, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[rows]) * weight[rows] / len(rows)
            gx = np.repeat(g, lens).astype(np.float32) * val
            uniq, at = np.unique(idx, return_inverse=True)
            dw = np.bincount(at, gx, len(uniq)).astype(np.float32) + decay * m.w[uniq]
            dv_all = gx[:, None] * (np.repeat(total, lens, axis=0) - vx)
            dv = np.stack([np.bincount(at, dv_all[:, f], len(uniq)) for f in range(m.v.shape[1])], 1).astype(np.float32) + decay * m.v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * 0.3 * dv / np.sqrt(gv[uniq])
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5) -> Machine:
    """A machine from at most about `most` labelled documents outside the held-out fold.

    Rows are chosen by a hash of their id, half of them of either label where there are enough, so the same
    rows are taken wherever they lie. Labels that are null or neither 0 nor 1 are left out, as are
    documents without a label; several labels for one id count once each.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != 0))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, most / 2 / n))).otherwise(share)
    chosen = known.where(place < share * 1_000_000)  # about `most` rows at most
    picked = spark.sparkContext.broadcast(_by_id(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = picked.value
        for batch in batches:
            y, idx, val = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for label_of in wanted.get(d, ()):
                    words = (t or b"").split()
                    _learn(words)
                    i, x = features(t or b"", words)
                    y.append(label_of)
                    idx.append(i.astype("<i4").tobytes())
                    val.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["y", "idx", "val"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).where(F.col("doc_id").isNotNull())
    rows = source.mapInArrow(run, "y int, idx binary, val binary").toArrow().to_pydict()
    order = sorted(range(len(rows["y"])), key=lambda i: (rows["y"][i], rows["idx"][i], rows["val"][i]))  # whatever the partitions
    sets = [(np.frombuffer(rows["idx"][i], "<i4").astype(np.int64), np.frombuffer(rows["val"][i], "<f4")) for i in order]
    return fit(sets, np.array([rows["y"][i] for i in order], np.float32))


def _by_id(chosen: DataFrame) -> dict:
    out: dict = {}
    for d, y in chosen.select("doc_id", "y").collect():
        out.setdefault(d, []).append(y)
    return out


def scores(texts: pa.Array, m: Machine) -> Iterator[np.ndarray]:
    """The machine's scores, for texts of some megabytes at a time; a null text is empty."""
    for _, some in text_pieces(texts):
        some = [t or b"" for t in some]
        words = [t.split() for t in some]
        _learn(chain.from_iterable(words))
        sets = [features(t, ws) for t, ws in zip(some, words)]
        for k in range(0, len(sets), 256):
            yield m.score(sets[k : k + 256])


def scored(machine: Machine, spark) -> Callable[[Column], Column]:
    """A column function from texts to scores. Only the text goes to Python."""
    shared = spark.sparkContext.broadcast(machine)  # a fixed size

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *scores(batch, shared.value)]), pa.float64())

    return lambda text: of(text.cast("binary"))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null texts count as empty, which are scored too.

    held_out: crc32 of the id as text is divisible by `folds` (a null id: of empty text). Only the text is scored, whole,
    however long. Other columns are ignored.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), scored(machine, docs.sparkSession)(F.col(text)).alias("score"))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, most: int = 6000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, by a machine fitted on at most about `most`
    labelled rows whose crc32(doc_id) mod 5 is not 0. Repeated rows each give a row; an empty table none."""
    return score(docs, train(docs, labels, most), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, most: int = 6000, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with their columns unchanged."""
    return docs.where(scored(train(docs, labels, most), docs.sparkSession)(F.col("text")) >= threshold)
