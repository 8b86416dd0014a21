"""Scans: text lines, whole files, CSV records and generated rounds.

Lines are numbered only where a caller asks for it (`ordered_lines`): a number needs the files' order, a
plain scan does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADES = "trade_id bigint, symbol string, price string, quantity bigint, side string, time string, account string"

def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value): non-empty lines, cut at \\n alone; a \\r stays. Large files are read in splits: a split owns
    the lines that begin in it."""
    return spark.read.option("lineSep", "\n").text(paths).where(F.length("value") > 0)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) in file order; seq grows with the place in the file but leaves gaps between splits."""
    return text_lines(spark, path).select(F.monotonically_increasing_id().alias("seq"), "value")


def _placed(lines: DataFrame, order: str) -> DataFrame:
    """`lines` with before (bytes of the lines in front, each with its line end) and total."""
    from weftline.operators.routing import running_bytes

    return running_bytes(lines, (F.octet_length("value") + 1).cast("bigint"), order)


def sliced(lines: DataFrame, low: float, high: float, order: str = "seq") -> DataFrame:
    """The lines that begin in a window of the bytes, from `low` to `high` of all: slices side by side hold each line once."""
    at = lambda x: F.floor(F.col("total") * F.lit(float(x))).cast("bigint")
    return _placed(lines, order).where((F.col("before") >= at(low)) & (F.col("before") < at(high))).drop("before", "total")


def chunked(lines: DataFrame, chunk_bytes: int, order: str = "seq") -> DataFrame:
    """`lines` with their chunk: those that begin in the same window of `chunk_bytes`."""
    return _placed(lines, order).withColumn("chunk", F.expr(f"before div {int(chunk_bytes)}")).drop("before", "total")


def whole_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, payload): one record for each file, bytes untouched."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("payload"))


def cycled(paths: Sequence[str], run: int) -> str:
    """The path that run number `run` reads or writes."""
    if not paths:
        raise ValueError("no paths to cycle through")
    return paths[run % len(paths)]


def inline(spark: SparkSession, items: Sequence[str]) -> DataFrame:
    """(seq, payload) from literal strings."""
    return spark.createDataFrame(list(enumerate(items)), "seq bigint, payload string")


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of (value) over the files of a folder: what is read in pieces stays incremental."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("lineSep", "\n").format("text").load(folder).where(F.length("value") > 0)


def trade_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trades with a header line; rows with fewer than seven fields are left out."""
    return spark.read.csv(path, schema=TRADES, header=True, mode="PERMISSIVE").where(F.col("account").isNotNull())


def sample_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label, features): lines `label,f0,f1,...`; lines that start with neither a digit nor - are skipped."""
    lines = ordered_lines(spark, path).where(F.col("value").rlike("^[-0-9]"))
    fields = F.transform(F.split("value", ","), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    return lines.select(F.col("seq").alias("sample_id"), fields.alias("f")).select("sample_id", F.col("f")[0].alias("label"), F.slice("f", 2, F.size("f") - 1).alias("features"))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, op, key, val) from `op,key[,val]`; blank lines and lines that start with # are skipped; a key that is no number is 0."""
    lines = ordered_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", ",", 3)
    return lines.select("seq", parts[0].alias("op"), F.coalesce(F.get(parts, F.lit(1)).try_cast("bigint"), F.lit(0)).alias("key"), F.get(parts, F.lit(2)).alias("val"))


def fixed_width(lines: DataFrame, width: int = 10) -> DataFrame:
    """(key, payload): the first `width` characters of a line and the rest."""
    return lines.select(F.substring("value", 1, width).alias("key"), F.substring("value", width + 1, 2**31 - 1).alias("payload"))


def rounds(spark: SparkSession, n_rounds: int, sizes: Sequence[int] = (20,)) -> DataFrame:
    """(round, i, v): round r has sizes[r mod len(sizes)] records, v = 1000 r + i."""
    each = F.array(*[F.lit(s) for s in sizes])
    base = spark.range(n_rounds).select(F.col("id").alias("round"), F.element_at(each, (F.col("id") % len(sizes) + 1).cast("int")).alias("n"))
    return base.where("n > 0").select("round", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - F.lit(1).cast("bigint"))).alias("i")).select("round", "i", (F.col("round") * 1000 + F.col("i")).alias("v"))


def seeds(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    """(key, stored): prefix and number for each key below n."""
    return spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("stored"))


#: symbols of the audit's built-in market, with the mean price in cents and the mean volume in millions of shares
MARKET = {
    "AAPL": (17500, 80), "AMD": (16000, 50), "AMZN": (18000, 50), "BAC": (3500, 45), "CRM": (30000, 5), "DIS": (11000, 12), "GOOG": (14000, 25),
    "GS": (40000, 3), "INTC": (4500, 30), "JPM": (19500, 10), "MA": (45000, 4), "META": (50000, 15), "MS": (9000, 10), "MSFT": (37000, 22),
    "NFLX": (60000, 5), "NVDA": (80000, 40), "ORCL": (12500, 8), "TSLA": (25000, 100), "V": (28000, 7), "WFC": (5500, 20),
}


def market(spark: SparkSession) -> DataFrame:
    """(symbol, avg_cents, avg_vol) of the built-in market: what trades are judged by where no prices are given."""
    return spark.createDataFrame([(s, cents, millions * 1_000_000) for s, (cents, millions) in MARKET.items()], "symbol string, avg_cents bigint, avg_vol bigint")


def labelled(spark: SparkSession, branch: int, heavy: bool = False) -> DataFrame:
    """(origin, seq, payload): the records a branch of a routing test makes, three short ones or 150 of about seventy bytes."""
    seq = F.lpad(F.col("id").cast("string"), 4, "0")
    text = F.concat(F.lit(f"p={branch},s="), seq, F.lit(",DATA_BLOCK_"), seq, F.lit("_" + "X" * 27)) if heavy else F.concat(F.lit(f"StreamPayload_P{branch}_seq"), F.col("id").cast("string"))
    return spark.range(150 if heavy else 3).select(F.lit(branch).cast("bigint").alias("origin"), F.col("id").alias("seq"), text.alias("payload"))
