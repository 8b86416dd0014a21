"""Round-based pipelines as micro-batches, incremental counts, and stateful event processing.

One round is one micro-batch: a stage sees exactly the records that were there when the batch began.
Stages of a round are chained transformations; running them one round apart is Spark's affair.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import sinks

#: records of a variable load, by round modulo seven
LOADS = (4, 4, 40, 40, 40, 4, 4)

Stage = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, stages: Sequence[Stage], width: int = 1) -> DataFrame:
    """`stages` one after the other; a width above one spreads the records over that many tasks first."""
    for stage in stages:
        df = stage(df.repartition(width) if width > 1 else df)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A folder under the session's checkpoint folder, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_rounds(spark: SparkSession, source: Callable[[int], DataFrame], stages: Sequence[Stage], n_rounds: int, sink: Callable[[DataFrame, int], None], width: int = 1) -> int:
    """Each round's source through all stages into `sink(df, round)`; returns ticks as a pipeline counts them."""
    for r in range(n_rounds):
        sink(chain(source(r), stages, width), r)
    return n_rounds + len(stages) - 1 if n_rounds else 0


def per_round_files(paths: Sequence[str], **kw) -> Callable[[DataFrame, int], None]:
    """A sink that writes round r to paths[r mod n]."""
    return lambda df, r: sinks.write_cycled(df, paths, r, **kw) and None


def stream_rounds(source: DataFrame, stages: Sequence[Stage], sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A stream through all stages; every micro-batch goes to `sink(df, batch)`. All that is there is read, once,
    whatever was read by earlier runs with the same checkpoint."""
    out = chain(source, stages)
    q = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def repeat(job: Callable[[int], None], runs: int) -> None:
    """The same job `runs` times, each told its number."""
    for r in range(runs):
        job(r)


def chunked_word_count(spark: SparkSession, parquet: str, files_per_batch: int = 1) -> DataFrame:
    """(word, n) by a stream over the files of a table: counts stay in state while chunks come and go."""
    from weftline.operators import text

    schema = spark.read.parquet(parquet).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(parquet + "*")
    home = scratch(spark, "chunked")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{home}/out")

    q = text.word_count(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def autoscale(loads: Sequence[int], floor: int, most: int, per_worker: int = 8) -> list[int]:
    """The width after each tick: half the old mean and half the load, over eight records a worker, one step at a time."""
    mean, width, out = 0.0, floor, []
    for load in loads:
        mean = 0.5 * mean + 0.5 * load
        want = min(most, max(floor, -(-mean // per_worker)))
        width += (want > width) - (want < width)
        out.append(int(width))
    return out


def autoscale_frame(spark: SparkSession, loads: Sequence[int], floor: int, most: int) -> DataFrame:
    widths = autoscale(loads, floor, most)
    return spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(loads, widths))], "tick bigint, load bigint, width bigint")


def _tally(op: pd.Series, val: pd.Series, stored: str | None, key: int, n_users: int, social: bool) -> dict[str, int]:
    login = int(((op == "login") & (val == stored)).sum()) if stored is not None else 0
    if not social:
        return {"total_events": len(op), "login_ok": login, "rate_writes": int((op == "rate").sum()), "review_writes": int((op == "review").sum())}
    tweet = 0 <= key <= n_users
    return {
        "total_events": int((~op.str.startswith("+")).sum()),
        "login_ok": login,
        "profile_reads": int((op == "profile").sum()) if 0 <= key < n_users else 0,
        "timeline_reads": int(op.isin(["timeline", "+timeline"]).sum()) if tweet else 0,
        "tweet_writes": int(op.isin(["post", "+post"]).sum()),
    }


def keyed_events(events: DataFrame, n_users: int, social: bool = False) -> DataFrame:
    """(key, tallies...) over a stream of events (op, key, val): a state for each key holds its tallies so far, and
    each batch gives the new totals of the keys it touched. Keys below `n_users` are seeded with password pw<key>.

    Social timelines and posts also touch key + 1: they become two events, one for each key.
    """
    names = ["total_events", "login_ok", *(["profile_reads", "timeline_reads", "tweet_writes"] if social else ["rate_writes", "review_writes"])]
    if social:
        both = F.when(F.col("op").isin("timeline", "post"), F.array(F.struct("op", "key", "val"), F.struct(F.concat(F.lit("+"), "op").alias("op"), (F.col("key") + 1).alias("key"), "val"))).otherwise(F.array(F.struct("op", "key", "val")))
        events = events.select(F.explode(both).alias("e")).select("e.*")
    schema = "key bigint, " + ", ".join(f"{n} bigint" for n in names)
    state = ", ".join(f"{n} bigint" for n in names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        k = int(key[0])
        sums = dict(zip(names, held.get)) if held.exists else dict.fromkeys(names, 0)
        for b in batches:
            for n, x in _tally(b["op"], b["val"], f"pw{k}" if 0 <= k < n_users else None, k, n_users, social).items():
                sums[n] += x
        held.update(tuple(sums[n] for n in names))
        yield pd.DataFrame({"key": [k], **{n: [sums[n]] for n in names}})

    return events.select("op", "key", "val").groupBy("key").applyInPandasWithState(step, schema, state, "update", "NoTimeout")


def latest_totals(updates: DataFrame, order: str) -> DataFrame:
    """One row of totals from the last update of each key."""
    names = [c for c in updates.columns if c not in ("key", order)]
    last = updates.groupBy("key").agg(*[F.max_by(n, order).alias(n) for n in names])
    return last.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def replay_events(spark: SparkSession, source: DataFrame, n_users: int, social: bool, checkpoint: str, out: str) -> DataFrame:
    """Runs keyed_events over a streaming `source` and returns the totals; updates are kept under `out`, so a run
    that starts again from `checkpoint` goes on where the last one ended."""

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = keyed_events(source, n_users, social).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return latest_totals(spark.read.parquet(out), "batch")


def source_rounds(spark: SparkSession, variable: bool = False) -> Callable[[int], DataFrame]:
    """The generated source of round r."""

    def of(r: int) -> DataFrame:
        n = LOADS[r % len(LOADS)] if variable else 20
        return spark.range(n).select(F.lit(r).cast("bigint").alias("round"), F.col("id").alias("i"), (F.lit(r * 1000) + F.col("id")).alias("v"))

    return of

