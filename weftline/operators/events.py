"""Keyed event processing: review and social events against seeded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review(events: DataFrame, seeded: DataFrame) -> DataFrame:
    """One row: total_events, login_ok, rate_writes, review_writes over events (op, key, val).

    A login succeeds if the key's stored password equals val. Unknown operations count as events only.
    """
    known = events.join(seeded, "key", "left")
    return known.agg(
        F.count("*").alias("total_events"),
        F.count_if((F.col("op") == "login") & (F.col("stored") == F.col("val"))).alias("login_ok"),
        F.count_if(F.col("op") == "rate").alias("rate_writes"),
        F.count_if(F.col("op") == "review").alias("review_writes"),
    )


def social(events: DataFrame, users: DataFrame) -> DataFrame:
    """One row: total_events, login_ok, profile_reads, timeline_reads, tweet_writes.

    `users` (key, stored) are the seeded passwords; profiles exist for the same keys, tweets for one key more.
    A timeline reads the tweets of key and key + 1, a post writes both.
    """
    span = users.agg(F.max("key").alias("last"))  # one row; keys run from 0
    ok = events.join(users, "key", "left").join(F.broadcast(span))
    here = (F.col("key") >= 0) & (F.col("key") <= F.col("last") + 1)
    above = (F.col("key") + 1 >= 0) & (F.col("key") <= F.col("last"))
    reads = F.when(F.col("op") == "timeline", here.cast("bigint") + above.cast("bigint")).otherwise(0)
    return ok.agg(
        F.count("*").alias("total_events"),
        F.count_if((F.col("op") == "login") & (F.col("stored") == F.col("val"))).alias("login_ok"),
        F.count_if((F.col("op") == "profile") & F.col("stored").isNotNull()).alias("profile_reads"),
        F.coalesce(F.sum(reads), F.lit(0)).alias("timeline_reads"),
        (2 * F.count_if(F.col("op") == "post")).alias("tweet_writes"),
    )


def round_summary(records: DataFrame) -> DataFrame:
    """(round, batch_count, value_sum) over (round, i, v)."""
    return records.groupBy("round").agg(F.count("*").alias("batch_count"), F.sum("v").alias("value_sum"))


def even(records: DataFrame) -> DataFrame:
    """Records with an even i."""
    return records.where(F.col("i") % 2 == 0)


def mark(records: DataFrame) -> DataFrame:
    """Records as text `r=..,i=..,v=..|T`, numbers kept beside it."""
    text = F.concat(F.lit("r="), F.col("round").cast("string"), F.lit(",i="), F.lpad(F.col("i").cast("string"), 2, "0"), F.lit(",v="), F.lpad(F.col("v").cast("string"), 5, "0"), F.lit("|T"))
    return records.withColumn("record", text)
