"""Matrix products of long tables (i, j, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a(i, k, v) times b(k, j, v), by an equi-join on k: for sparse or small inputs."""
    left, right = a.select("i", "k", F.col("v").alias("x")), b.select("k", "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def multiply_blocks(a: DataFrame, b: DataFrame, block: int = 256) -> DataFrame:
    """The same product for dense inputs: square blocks meet on their inner index, numpy multiplies them, and
    partial blocks are added. Work moved is N^3 / block values instead of N^3 rows."""

    def blocks(m: DataFrame, r: str, c: str) -> DataFrame:
        at = m.select((F.col(r) / block).cast("int").alias(r + "b"), (F.col(c) / block).cast("int").alias(c + "b"), (F.col(r) % block * block + F.col(c) % block).cast("int").alias("at"), F.col("v").cast("double").alias("v"))
        return at.groupBy(r + "b", c + "b").agg(F.collect_list(F.struct("at", "v")).alias("cells"))

    def dense(cells) -> np.ndarray:
        out = np.zeros(block * block)
        flat = cells.values
        out[flat.field("at").to_numpy()] = flat.field("v").to_numpy()
        return out.reshape(block, block)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                c = dense(batch.column(2)[n]) @ dense(batch.column(3)[n])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), batch.column(1).slice(n, 1), pa.array([c.tobytes()], pa.binary())], ["ib", "jb", "c"])

    def add(t: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(x.as_py()) for x in t.column("c")).reshape(block, block)
        i, j = np.nonzero(np.ones_like(c))
        ib, jb = t.column("ib")[0].as_py(), t.column("jb")[0].as_py()
        return pa.table({"i": i + ib * block, "j": j + jb * block, "v": c.reshape(-1)})

    left = blocks(a, "i", "k").withColumnRenamed("cells", "x")
    right = blocks(b, "k", "j").withColumnRenamed("cells", "y")
    parts = left.join(right, "kb").select("ib", "jb", "x", "y").mapInArrow(product, "ib int, jb int, c binary")
    size = a.agg(F.max("i").alias("mi")).join(F.broadcast(b.agg(F.max("j").alias("mj"))))
    out = parts.groupBy("ib", "jb").applyInArrow(add, "i bigint, j bigint, v double")
    return out.join(F.broadcast(size), (F.col("i") <= F.col("mi")) & (F.col("j") <= F.col("mj"))).select("i", "j", "v")


def tiles(matrix: DataFrame, rows: int, cols: int) -> DataFrame:
    """`matrix` with the tile each cell belongs to."""
    return matrix.withColumn("tile_i", F.expr(f"i div {rows}")).withColumn("tile_j", F.expr(f"j div {cols}"))


def checksum(product: DataFrame) -> DataFrame:
    return product.agg(F.sum("v").alias("checksum"), F.count("*").alias("elements"))
