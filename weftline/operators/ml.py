"""Integer machine learning on long samples (sample_id, label, j, x): linear inference, gradient steps, stumps, PCA."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = 1024
RATE = 16


def long_samples(samples: DataFrame, features: str = "features") -> DataFrame:
    """(sample_id, label, j, x) from arrays."""
    return samples.select("sample_id", "label", F.posexplode(features).alias("j", "x")).withColumn("j", F.col("j").cast("bigint"))


def first_max(scores: DataFrame, keys: tuple[str, ...], score: str = "score", cls: str = "cls") -> DataFrame:
    """(keys, predicted): the class with the highest score; the lowest class of equal ones."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(cls)).alias("c")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.c")).alias("predicted"))


def last_max(scores: DataFrame, keys: tuple[str, ...], score: str = "votes", cls: str = "cls") -> DataFrame:
    """As first_max, but the highest class of equal ones."""
    best = F.max(F.struct(F.col(score).alias("s"), F.col(cls).alias("c")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.c").alias("predicted"))


def scores(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, label, cls, score): sums of w * x. `weights` (cls, j, w) is joined on the feature."""
    return samples.join(weights, "j").groupBy("sample_id", "label", "cls").agg(F.sum(F.col("w") * F.col("x")).alias("score"))


def infer(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, label, predicted)."""
    return first_max(scores(samples, weights), ("sample_id", "label"))


def infer_arrays(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, label, predicted) for (sample_id, label, features array) rows: no row for each feature, no shuffle.

    `weights` (cls, j, w) becomes one row, which every task has: a model must fit one. Missing weights are 0; the
    lowest class of equal scores wins.
    """
    size = weights.agg(F.max("j").alias("mj"))
    vectors = weights.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("of")).join(F.broadcast(size))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), "mj"), lambda j: F.coalesce(F.element_at("of", j), F.lit(0).cast("bigint")))
    model = vectors.select("cls", dense.alias("w")).agg(F.array_sort(F.collect_list(F.struct("cls", "w"))).alias("model"))  # one row
    total = lambda m: F.aggregate(F.zip_with("features", m["w"], lambda x, w: F.coalesce(x * w, F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    scored = samples.join(F.broadcast(model)).select("sample_id", "label", F.array_max(F.transform("model", lambda m: F.struct(total(m).alias("s"), (-m["cls"]).alias("c")))).alias("best"))
    return scored.select("sample_id", "label", (-F.col("best.c")).alias("predicted"))


def weights_frame(spark, w: np.ndarray) -> DataFrame:
    """(cls, j, w) of a matrix of weights, classes by features."""
    return spark.createDataFrame([(c, j, int(w[c, j])) for c in range(w.shape[0]) for j in range(w.shape[1])], "cls bigint, j bigint, w bigint")


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row: correct, total, predsum, and accuracy in hundredths of a percent."""
    out = predicted.agg(F.count_if(F.col("predicted") == F.col("label")).alias("correct"), F.count("*").alias("total"), F.coalesce(F.sum("predicted"), F.lit(0)).alias("predsum"))
    return out.withColumn("acc_bp", F.when(F.col("total") > 0, F.expr("correct * 10000 div total")).otherwise(F.lit(0)))


def zero_weights(samples: DataFrame, classes: int) -> DataFrame:
    js = samples.select("j").distinct()
    return js.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(classes - 1).cast("bigint"))).alias("cls"), "j", F.lit(0).cast("bigint").alias("w"))


def gradient(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(cls, j, g): sums over samples of (score - target) * x, target 1024 for the sample's own class."""
    error = scores(samples, weights).select("sample_id", "cls", (F.col("score") - F.when(F.col("label") == F.col("cls"), TARGET).otherwise(0)).alias("err"))
    return samples.select("sample_id", "j", "x").join(error, "sample_id").groupBy("cls", "j").agg(F.sum(F.col("err") * F.col("x")).alias("g"))


def step(samples: DataFrame, weights: DataFrame, n_samples: int) -> DataFrame:
    """Weights after one epoch: w - g div (16 n), division towards zero."""
    moved = weights.join(gradient(samples, weights), ["cls", "j"], "left")
    return moved.select("cls", "j", (F.col("w") - F.expr(f"coalesce(g, 0) div {max(1, n_samples * RATE)}")).alias("w"))


def train(samples: DataFrame, classes: int = 10, epochs: int = 1) -> DataFrame:
    """(cls, j, w) after `epochs` epochs. The weights (classes * features rows) pass through the driver after
    each epoch, which cuts the plan; the samples stay where they are."""
    spark = samples.sparkSession
    n = samples.select("sample_id").distinct().count()
    weights = zero_weights(samples, classes)
    for e in range(epochs):
        weights = step(samples, weights, n)
        if e + 1 < epochs:
            weights = spark.createDataFrame(weights.toArrow())
    return weights


def arrays_step(samples: DataFrame, weights: np.ndarray, n_samples: int) -> np.ndarray:
    """One epoch over (label, features array) rows: a gradient for each partition by numpy, summed by Spark.

    Sums are exact in 64-bit integers; it gives the same weights as `step`, without a row for each feature.
    """
    classes, width = weights.shape
    held = samples.sparkSession.sparkContext.broadcast(weights)  # classes * features numbers

    def run(batches):
        g = np.zeros((classes, width), np.int64)
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, width).astype(np.int64)
            err = x @ held.value.T
            err[np.arange(len(x)), b.column(0).to_numpy()] -= TARGET
            g += err.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.size)), pa.array(g.reshape(-1))], ["at", "g"])

    sums = samples.select("label", "features").mapInArrow(run, "at bigint, g bigint").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
    g = np.zeros(classes * width, np.int64)
    g[sums.column("at").to_numpy()] = sums.column("g").to_numpy()
    den = n_samples * RATE
    return weights - np.sign(g).reshape(classes, width) * (np.abs(g) // den).reshape(classes, width)


def fit(samples: DataFrame, classes: int = 10, epochs: int = 10) -> np.ndarray:
    """Weights by `arrays_step`, for (label, features) rows."""
    first = samples.select(F.size("features").alias("w")).first()
    weights, n = np.zeros((classes, first.w if first else 0), np.int64), samples.count()
    for _ in range(epochs if n else 0):
        weights = arrays_step(samples, weights, n)
    return weights


def stumps(samples: DataFrame, classes: int = 10) -> DataFrame:
    """(shard, cls, j, thresh, score): for each shard and class the best test x <= thresh, over (shard, sample_id,
    label, j, x).

    Thresholds lie between neighbouring distinct values (toward zero), every max(1, n div 10)-th of a feature;
    the score counts samples for which the test says whether it is the class. The first best in order of feature
    and threshold stays; without one, (0, 0, 0).
    """
    from pyspark.sql import Window as W

    counts = samples.groupBy("shard", "j", "x", "label").agg(F.count("*").alias("n"))
    values = counts.select("shard", "j", "x").distinct()
    by = W.partitionBy("shard", "j").orderBy("x")
    values = values.select("shard", "j", "x", F.lead("x").over(by).alias("above"), (F.row_number().over(by) - 1).alias("ti"), F.count("*").over(W.partitionBy("shard", "j")).alias("m"))
    stepped = values.where("above is not null and ti % (case when m > 10 then m div 10 else 1 end) = 0")
    candidates = stepped.select("shard", "j", "ti", F.expr("(x + above) div 2").alias("thresh"))
    # samples by label at or below each value: running sums over a shard's distinct values
    classes_df = values.select("shard", "j", "x").withColumn("cls", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(classes - 1).cast("bigint"))))
    at = classes_df.join(counts.select("shard", "j", "x", F.col("label").alias("cls"), "n"), ["shard", "j", "x", "cls"], "left")
    every = counts.groupBy("shard", "j", "x").agg(F.sum("n").alias("all"))
    at = at.join(every, ["shard", "j", "x"]).withColumn("n", F.coalesce("n", F.lit(0)))
    upto = W.partitionBy("shard", "j", "cls").orderBy("x")
    whole = W.partitionBy("shard", "j", "cls")
    at = at.select("shard", "j", "cls", "x", F.sum("n").over(upto).alias("own_low"), F.sum("all").over(upto).alias("all_low"), F.sum("n").over(whole).alias("own"), F.sum("all").over(whole).alias("total"))
    # x <= thresh is x <= the largest value at or below thresh; a midpoint cut toward zero may reach the value above
    scored = candidates.join(at, ["shard", "j"]).where("x <= thresh").groupBy("shard", "j", "ti", "thresh", "cls").agg(F.max_by(F.col("own_low") + (F.col("total") - F.col("own")) - (F.col("all_low") - F.col("own_low")), "x").alias("score"))
    best = scored.where("score > 0").groupBy("shard", "cls").agg(F.max(F.struct("score", (-F.col("j")).alias("j"), (-F.col("ti")).alias("ti"), "thresh")).alias("b"))
    shards = samples.select("shard").distinct().withColumn("cls", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(classes - 1).cast("bigint"))))
    out = shards.join(best, ["shard", "cls"], "left")
    return out.select("shard", "cls", F.coalesce(-F.col("b.j"), F.lit(0)).alias("j"), F.coalesce("b.thresh", F.lit(0)).alias("thresh"), F.coalesce("b.score", F.lit(0)).alias("score"))


def vote(samples: DataFrame, found: DataFrame, classes: int = 10) -> DataFrame:
    """(sample_id, label, predicted): each stump that a sample passes votes for its class; the highest class of
    equal ones wins, and the last class where none votes."""
    few = found.groupBy("j").agg(F.collect_list(F.struct("thresh", "cls")).alias("tests"))  # shards * classes stumps in all
    passed = samples.join(few, "j").select("sample_id", "label", F.explode("tests").alias("t"), "x").where("x <= t.thresh")
    votes = passed.groupBy("sample_id", "label", F.col("t.cls").alias("cls")).agg(F.count("*").alias("votes"))
    won = last_max(votes, ("sample_id", "label"))
    everyone = samples.select("sample_id", "label").distinct()
    return everyone.join(won, ["sample_id", "label"], "left").select("sample_id", "label", F.coalesce("predicted", F.lit(classes - 1)).alias("predicted"))


def pca(samples: DataFrame, components: int = 8, rounds: int = 20) -> DataFrame:
    """(shard, sample_id, label, projection array<int>) over (shard, sample_id, label, features).

    Power iteration with deflation on each shard's own samples, from the start vector 1 / (j + 1); projections are cut
    toward zero. A shard is what one task holds: choose as many as keep it in memory.
    """

    def project(t: pa.Table) -> pa.Table:
        x = np.array(t.column("features").to_pylist(), np.float64)
        x -= x.mean(0)
        rest, found = x.copy(), []
        for _ in range(min(components, x.shape[1])):
            v = 1 / np.arange(1.0, x.shape[1] + 1)
            v /= np.linalg.norm(v)
            for _ in range(rounds):
                v = rest.T @ (rest @ v)
                v /= np.linalg.norm(v) or 1.0
            rest -= np.outer(rest @ v, v)
            found.append(v)
        p = np.trunc(x @ np.array(found).T).astype(np.int32)
        return pa.table({"shard": t.column("shard"), "sample_id": t.column("sample_id"), "label": t.column("label"), "projection": pa.array(p.tolist(), pa.list_(pa.int32()))})

    typed = samples.select(F.col("shard").cast("int").alias("shard"), F.col("sample_id").cast("bigint").alias("sample_id"), F.col("label").cast("bigint").alias("label"), "features")
    return typed.groupBy("shard").applyInArrow(project, "shard int, sample_id bigint, label bigint, projection array<int>")
