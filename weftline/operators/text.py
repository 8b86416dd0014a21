"""Word count and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as fx
from weftline.functions.layout import spread


def words(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each non-empty word occurrence, with the columns in `keep`."""
    return spread(docs, *dict.fromkeys((*keep, text))).select(*keep, F.explode(fx.words(F.col(text))).alias("word")).where(F.col("word") != "")


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): partial counts before the shuffle, final ones after it."""
    return words(docs, text).groupBy("word").agg(F.count("*").alias("n"))


def summary(counts: DataFrame) -> DataFrame:
    """One row: distinct words and occurrences."""
    return counts.agg(F.count("*").alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences"))


def tf_idf(docs: DataFrame, text: str = "text", top: int = 50, min_bytes: int = 3) -> DataFrame:
    """The `top` terms by tf * floor_log2(N div df + 1); ties by term ascending.

    A row counts as one document; terms shorter than `min_bytes` bytes are left out.
    """
    long = F.filter(fx.words(F.col(text)), lambda w: F.octet_length(w) >= min_bytes)
    once = lambda all_, first: F.transform(all_, lambda w: F.struct(w.alias("word"), F.lit(first).alias("first")))
    # a document's words, and its distinct words once more: one shuffle by word, after partial sums
    listed = spread(docs, text).select(long.alias("w")).select(F.explode(F.concat(once(F.col("w"), 0), once(F.array_distinct("w"), 1))).alias("t"))
    terms = listed.groupBy("t.word").agg(F.sum(1 - F.col("t.first")).alias("tf"), F.sum("t.first").alias("df"))
    total = docs.agg(F.count("*").alias("n_docs"))  # one row
    idf = fx.floor_log2(F.expr("n_docs div greatest(df, 1) + 1"))
    scored = terms.join(F.broadcast(total)).select("word", "tf", "df", (F.col("tf") * idf).alias("score"))
    return scored.orderBy(F.desc("score"), "word").limit(top)
