"""The operators' inputs as views over the driver's tables: DataFrames, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark: SparkSession, d: str, symbol: str = "p_type") -> DataFrame:
    """(trade_id, symbol, price_cents, quantity, side, mins, account)."""
    lines, orders, parts = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(
        "l_orderkey * 8 + l_linenumber AS trade_id",
        f"{symbol} AS symbol",
        "cast(floor(l_extendedprice * 100 + 0.5) AS bigint) % 20000 + 1 AS price_cents",
        "cast(l_quantity AS bigint) * 200 AS quantity",
        "CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS side",
        "(l_orderkey * 37 + l_linenumber * 101) % 1440 AS mins",
        "o_custkey % 100 AS account",
    )


def prices(spark: SparkSession, d: str, symbol: str = "p_type") -> DataFrame:
    """(symbol, avg_cents): one row for each symbol there is."""
    found = table(spark, d, "part").select(F.col(symbol).alias("symbol")).distinct()
    return found.selectExpr("symbol", "2500 + 300 * row_number() OVER (ORDER BY symbol) AS avg_cents")


TRADES_SQL = """
trades AS (
  SELECT l_orderkey * 8 + l_linenumber AS trade_id, {symbol} AS symbol,
         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) % 20000 + 1 AS price_cents, CAST(l_quantity AS BIGINT) * 200 AS quantity,
         CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS side, (l_orderkey * 37 + l_linenumber * 101) % 1440 AS mins, o_custkey % 100 AS account
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), prices AS (
  SELECT symbol, 2500 + 300 * row_number() OVER (ORDER BY symbol) AS avg_cents FROM (SELECT DISTINCT {symbol} AS symbol FROM part)
)"""


def keys(spark: SparkSession, d: str) -> DataFrame:
    """(seq, key): ten hexadecimal digits for each event."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 10).alias("key"))


KEYS_SQL = "keys AS (SELECT event_id AS seq, substr(md5(CAST(event_id AS VARCHAR)), 1, 10) AS key FROM events)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, label, j, x): embeddings in sixteenths."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("j", "f"))
    return e.selectExpr("vec_id AS sample_id", "cast(label AS bigint) AS label", "cast(j AS bigint) AS j", "cast(floor(f * 16) AS bigint) AS x")


def sample_arrays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id AS sample_id", "cast(label AS bigint) AS label", "transform(embedding, f -> cast(floor(f * 16) AS bigint)) AS features")


SAMPLES_SQL = """
samples AS (
  SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS label, CAST(j - 1 AS BIGINT) AS j, CAST(floor(embedding[j] * 16) AS BIGINT) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS j)
)"""


def matrix(spark: SparkSession, d: str, row: str, col: str) -> DataFrame:
    """(row, col, v): every vector as a row."""
    return samples(spark, d).select(F.col("sample_id").alias(row), F.col("j").alias(col), F.col("x").alias("v"))


MATRIX_SQL = SAMPLES_SQL + ", a AS (SELECT j AS i, sample_id AS k, x AS v FROM samples), b AS (SELECT sample_id AS k, j, x AS v FROM samples)"


def app_events(spark: SparkSession, d: str, ops: dict[str, str]) -> DataFrame:
    return as_app_events(table(spark, d, "events"), ops)


def as_app_events(events: DataFrame, ops: dict[str, str]) -> DataFrame:
    """(seq, op, key, val): events with their types renamed; every seventh login has another user's password."""
    names = F.create_map(*[F.lit(x) for pair in ops.items() for x in pair])
    val = F.expr("concat('pw', cast(CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS string))")
    return events.select(F.col("event_id").alias("seq"), F.coalesce(names[F.col("event_type")], F.lit("other")).alias("op"), F.col("user_id").alias("key"), val.alias("val"))


def passwords(spark: SparkSession, d: str) -> DataFrame:
    """(key, stored) for each user up to the largest id."""
    top = table(spark, d, "events").agg(F.max("user_id").alias("m"))
    return top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("key")).select("key", F.concat(F.lit("pw"), F.col("key").cast("string")).alias("stored"))


def app_sql(ops: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ops.items())
    return f"""app AS (
  SELECT event_id AS seq, CASE event_type {cases} ELSE 'other' END AS op, user_id AS key,
         'pw' || CAST(CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR) AS val FROM events
), users AS (SELECT k AS key, 'pw' || CAST(k AS VARCHAR) AS stored FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS k))"""


def slots(spark: SparkSession, d: str) -> DataFrame:
    """(origin, seq, payload): events of four writers."""
    return table(spark, d, "events").select((F.col("user_id") % 4).alias("origin"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))


SLOTS_SQL = "slots AS (SELECT user_id % 4 AS origin, event_id AS seq, props AS payload FROM events)"


def writes(spark: SparkSession, d: str) -> DataFrame:
    """(name, writer_id, seq, payload): conflicting writes, one name for each user."""
    return table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("writer_id"), F.col("event_id").alias("seq"), F.col("props").alias("payload"), "event_type")


WRITES_SQL = "writes AS (SELECT user_id AS name, event_id AS writer_id, event_id AS seq, props AS payload, event_type FROM events)"


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """(round, i, v): twenty events each."""
    return table(spark, d, "events").selectExpr("event_id div 20 AS round", "event_id % 20 AS i", "cast(floor(value * 100 + 0.5) AS bigint) AS v")


ROUNDS_SQL = "rounds AS (SELECT event_id // 20 AS round, event_id % 20 AS i, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v FROM events)"


def pixels(spark: SparkSession, images: int = 4, size: int = 16) -> DataFrame:
    """(image_id, r, c, ch, v): generated images."""
    grid = spark.range(images).select(F.col("id").alias("image_id"))
    for name, n in (("r", size), ("c", size), ("ch", 3)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.withColumn("v", F.expr("cast((r * 31 + c * 17 + ch * 7 + image_id * 13) % 256 AS int)"))


PIXELS_SQL = """
pixels AS (
  SELECT image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(ch AS INTEGER) AS ch, CAST((r * 31 + c * 17 + ch * 7 + image_id * 13) % 256 AS INTEGER) AS v
  FROM (SELECT unnest(range(0, 4)) AS image_id), (SELECT unnest(range(0, 16)) AS r), (SELECT unnest(range(0, 16)) AS c), (SELECT unnest(range(0, 3)) AS ch)
), gray AS (SELECT image_id, r, c, CAST(sum(v * CASE ch WHEN 0 THEN 77 WHEN 1 THEN 150 ELSE 29 END) AS BIGINT) >> 8 AS v FROM pixels GROUP BY ALL)"""
