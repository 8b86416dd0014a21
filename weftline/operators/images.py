"""Image stages, over pixel tables (image_id, r, c, ch, v) and over binary images (image_id, w, h, ch, pixels).

The binary form is the one to run: one Arrow batch of images in, one out. The pixel form says the same in
plain SQL and checks it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IMAGE = "image_id bigint, w int, h int, ch int, pixels binary"


def grayscale_pixels(p: DataFrame) -> DataFrame:
    weight = F.when(F.col("ch") == 0, 77).when(F.col("ch") == 1, 150).otherwise(29)
    return p.where("ch < 3").groupBy("image_id", "r", "c").agg(F.shiftright(F.sum(F.col("v") * weight), 8).cast("int").alias("v"))


def rotate_pixels(p: DataFrame) -> DataFrame:
    """A quarter turn clockwise: row r, column c goes to row c, column h - 1 - r."""
    height = p.groupBy("image_id").agg(F.max("r").alias("last"))
    return p.join(height, "image_id").select("image_id", F.col("c").alias("r"), (F.col("last") - F.col("r")).alias("c"), "ch", "v")


def equalize_pixels(g: DataFrame) -> DataFrame:
    """Gray values by their share of the image's pixels at or below them."""
    hist = g.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    by = W.partitionBy("image_id").orderBy("v")
    cdf = hist.select("image_id", "v", F.sum("n").over(by).alias("cdf"), F.first("n").over(by).alias("low"), F.sum("n").over(W.partitionBy("image_id")).alias("total"))
    lut = cdf.select("image_id", "v", F.expr("cast(case when total = low then v else ((cdf - low) * 255 + (total - low) div 2) div (total - low) end as int)").alias("out"))
    return g.join(lut, ["image_id", "v"]).select("image_id", "r", "c", F.col("out").alias("v"))


def blur_pixels(g: DataFrame) -> DataFrame:
    """Whole mean of the 3 x 3 neighbourhood, cut off at the edges. Each pixel goes to its nine neighbours' places."""
    size = g.groupBy("image_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    around = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = g.select("image_id", "r", "c", "v", F.explode(around).alias("d")).select("image_id", (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"), "v")
    sums = spread.groupBy("image_id", "r", "c").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    inside = sums.join(size, "image_id").where("r between 0 and mr and c between 0 and mc")
    return inside.select("image_id", "r", "c", F.expr("cast(s div n as int)").alias("v"))


def resize_pixels(p: DataFrame) -> DataFrame:
    """Half size, every second pixel; an odd last row or column is left out."""
    size = p.groupBy("image_id").agg(((F.max("r") + 1) / 2).cast("int").alias("h"), ((F.max("c") + 1) / 2).cast("int").alias("w"))
    halves = p.where("r % 2 = 0 and c % 2 = 0").selectExpr("image_id", "cast(r div 2 as int) as r", "cast(c div 2 as int) as c", "ch", "v")
    return halves.join(size, "image_id").where("r < h and c < w").select("image_id", "r", "c", "ch", "v")


def _each(df: DataFrame, f: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    """`f` on each image as an array (h, w, ch); None drops it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, w, h, ch, pixels in zip(*[c.to_pylist() for c in b.columns]):
                out = f(np.frombuffer(pixels, np.uint8)[: w * h * ch].reshape(h, w, ch))
                if out is not None:
                    rows.append((i, out.shape[1], out.shape[0], out.shape[2], np.ascontiguousarray(out, np.uint8).tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["image_id", "w", "h", "ch", "pixels"])

    return df.select("image_id", "w", "h", "ch", "pixels").mapInArrow(run, IMAGE)


def _gray(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.uint32)
    return ((y[:, :, 0] * 77 + y[:, :, 1] * 150 + y[:, :, 2] * 29) >> 8)[:, :, None] if x.shape[2] >= 3 else x[:, :, :1]


def _level(x: np.ndarray) -> np.ndarray:
    flat = x[:, :, 0]
    cdf = np.cumsum(np.bincount(flat.reshape(-1), minlength=256))
    low = cdf[cdf > 0][0] if flat.size else 0
    rest = flat.size - low
    lut = np.arange(256) if not rest else (np.maximum(cdf - low, 0) * 255 + rest // 2) // rest
    return lut[flat][:, :, None]


def _mean(x: np.ndarray) -> np.ndarray:
    def sums(a: np.ndarray) -> np.ndarray:
        p = np.pad(a.astype(np.int64), 1)
        return sum(p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc] for dr in (-1, 0, 1) for dc in (-1, 0, 1))

    g = x[:, :, 0]
    return (sums(g) // sums(np.ones_like(g)))[:, :, None]


def _half(x: np.ndarray) -> np.ndarray | None:
    h, w = x.shape[0] // 2, x.shape[1] // 2
    return x[: 2 * h : 2, : 2 * w : 2] if h and w else None


def rotate(df: DataFrame) -> DataFrame:
    return _each(df, lambda x: np.rot90(x, -1))


def grayscale(df: DataFrame) -> DataFrame:
    return _each(df, _gray)


def equalize(df: DataFrame) -> DataFrame:
    return _each(df, _level)


def blur(df: DataFrame) -> DataFrame:
    return _each(df, _mean)


def resize(df: DataFrame) -> DataFrame:
    return _each(df, _half)


def noop(df: DataFrame) -> DataFrame:
    return df


def pipeline(df: DataFrame) -> DataFrame:
    """Rotate, gray, equalize and blur in one pass over the batches."""
    return _each(df, lambda x: _mean(_level(_gray(np.rot90(x, -1)).astype(np.uint8)).astype(np.uint8)))


def parse_netpbm(files: DataFrame) -> DataFrame:
    """Images from P2 and P3 files (path, payload): comments dropped, values scaled to 255 with rounding, missing ones 0."""

    def one(payload: bytes) -> tuple | None:
        words = b" ".join(line.split(b"#")[0] for line in payload.split(b"\n")).split()
        if len(words) < 4 or words[0] not in (b"P2", b"P3"):
            return None
        w, h, most = (int(x) for x in words[1:4])
        ch = 3 if words[0] == b"P3" else 1
        v = np.zeros(w * h * ch, np.int64)
        given = np.array(words[4 : 4 + len(v)], np.int64)
        v[: len(given)] = given
        if most != 255 and most > 0:
            v = (v * 255 + most // 2) // most
        return w, h, ch, v.clip(0, 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (x := one(p))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["image_id", "w", "h", "ch", "pixels"])

    return files.select(F.xxhash64("path").alias("image_id"), "payload").mapInArrow(run, IMAGE)


def decode(files: DataFrame) -> DataFrame:
    """Images from binary files: width and height in two little-endian bytes each, channels in one, then pixels."""
    number = lambda at: F.conv(F.hex(F.concat(F.substring("payload", at + 1, 1), F.substring("payload", at, 1))), 16, 10).cast("int")
    return files.select(F.xxhash64("path").alias("image_id"), number(1).alias("w"), number(3).alias("h"), F.conv(F.hex(F.substring("payload", 5, 1)), 16, 10).cast("int").alias("ch"), F.expr("substring(payload, 6)").alias("pixels"))
