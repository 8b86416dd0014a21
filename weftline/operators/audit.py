"""Trade audit: eight rules in one pass over the trades and one over (account, symbol) groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("PRICE_OUTLIER", "LARGE_ORDER", "WASH_TRADE", "SPOOFING", "CONCENTRATION", "AFTER_HOURS", "PENNY_STOCK", "ROUND_LOT")
STATELESS = (0, 1, 5, 6, 7)
UNKNOWN_CENTS = 10_000


def parse_cents(price: Column) -> Column:
    """Cents of a decimal string; digits beyond the second are cut off, anything else counts as 0."""
    whole = F.coalesce(F.split_part(price, F.lit("."), F.lit(1)).try_cast("bigint"), F.lit(0))
    part = F.rpad(F.substring(F.split_part(price, F.lit("."), F.lit(2)), 1, 2), 2, "0")
    return F.coalesce(whole * 100 + F.coalesce(part.try_cast("bigint"), F.lit(0)), F.lit(0))


def parse_minutes(time: Column) -> Column:
    """Minutes of the day from `HH:MM` or an ISO time; 0 if there is none."""
    clock = F.regexp_extract(time, r"(?:^|T)(\d{1,2}):(\d{1,2})", 0)
    number = lambda k: F.coalesce(F.regexp_extract(clock, r"(\d{1,2}):(\d{1,2})", k).try_cast("int"), F.lit(0))
    return number(1) * 60 + number(2)


def account_number(account: Column) -> Column:
    """The digits of an account's name."""
    return F.coalesce(F.regexp_replace(account, "[^0-9]", "").try_cast("bigint"), F.lit(0))


def trades(raw: DataFrame) -> DataFrame:
    """Typed trades from the CSV scan: side is 0 for BUY, 1 otherwise."""
    return raw.select(
        "trade_id",
        "symbol",
        parse_cents(F.col("price")).alias("price_cents"),
        "quantity",
        F.when(F.col("side") == "BUY", 0).otherwise(1).alias("side"),
        parse_minutes(F.col("time")).alias("mins"),
        account_number(F.col("account")).alias("account"),
    )


def _simple(rule: int) -> Column:
    return {
        0: F.col("price_cents") > 2 * F.coalesce("avg_cents", F.lit(UNKNOWN_CENTS)),
        1: F.col("quantity") > 5000,
        5: (F.col("mins") < 570) | (F.col("mins") > 960),
        6: F.col("price_cents") < 500,
        7: (F.col("quantity") >= 1000) & (F.col("quantity") % 1000 == 0),
    }[rule]


def per_group(trade_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for each (account, symbol): trades, sides seen, and violations of the stateless rules.

    `prices` (symbol, avg_cents) is a reference table of one row for each symbol; it is joined after the
    trades have been counted by price, so only Spark's own size check may broadcast it.
    """
    joined = trade_rows.join(prices.select("symbol", "avg_cents"), "symbol", "left")
    counts = [F.count_if(_simple(r)).alias(f"rule_{r}") for r in STATELESS]
    return joined.groupBy("account", "symbol").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1, side)")).alias("sides"), *counts)


def audit(trade_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """(rule_id, rule, violations) for all eight rules, from one scan of the trades.

    Symbols without a price count as 10000 cents. Concentration: symbols with more than total div 20 + 100 trades.
    """
    groups = per_group(trade_rows, prices)
    # the groups' own sums by symbol carry every rule to the end
    by_symbol = groups.groupBy("symbol").agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("sides") == 3).alias("rule_2"),
        F.count_if(F.col("n") > 10).alias("rule_3"),
        *[F.sum(f"rule_{r}").alias(f"rule_{r}") for r in STATELESS],
    )
    whole = by_symbol.agg(F.sum("n").alias("total"))  # one row; its exchange is the same as below
    total = by_symbol.join(F.broadcast(whole)).agg(
        F.count_if(F.col("n") > F.expr("total div 20 + 100")).alias("rule_4"),
        *[F.coalesce(F.sum(f"rule_{r}"), F.lit(0)).alias(f"rule_{r}") for r in range(8) if r != 4],
    )
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(RULES[r]).alias("rule"), F.col(f"rule_{r}").alias("violations")) for r in range(8)])
    return total.select(F.inline(rows))


def rule(trade_rows: DataFrame, prices: DataFrame, number: int) -> DataFrame:
    """One row with the violations of one rule."""
    return audit(trade_rows, prices).where(F.col("rule_id") == number).select("rule_id", "violations")


def totals(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("total_rules_executed"), F.sum("violations").alias("total_violations"))
