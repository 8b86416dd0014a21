"""From raw documents to packed sequences: quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents`. A stage works on what its predecessor kept, written as Parquet and read again.

Every stage takes texts whole, however long, passes columns it does not know on unchanged (the last one leaves them out),
and gives no rows for an empty table. What nulls, empty texts, repeated rows and ties give is said for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import ngram_join, packing, quality, secrets
from weftline.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay unchanged. A null text is scored as an empty one and stays
    null; repeated rows stay or go together; a score that equals the threshold stays."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (Jaccard 0.9) the least one stays, by doc_id (a
    null id is the least), then by its text's digest. Blank texts link with nothing and stay."""
    key = F.struct(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"))
    keyed = docs.select(key.alias("key"), F.col("text").alias("text"), F.struct(*docs.columns).alias("row"))
    found = ngram_join.similar(keyed, doc_id="key")
    least = found.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("n"), F.max("n_shingles").alias("shingles"))
    counted = written(least, "kept")
    kept = keyed.join(counted, keyed["key"].eqNullSafe(counted["kept"]))
    if not counted.where("n > 1 and shingles > 0").isEmpty():  # whole rows repeat
        first = F.row_number().over(W.partitionBy("kept").orderBy("row"))
        kept = kept.withColumn("place", first).where("place = 1 or shingles = 0")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes [SECRET]; n_chars follows. Null and empty texts stay as they are (n_chars null and 0), repeated
    rows change alike, overlapping secrets become one mark."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as best-fit decreasing makes. A null or empty text is its end alone;
    repeated rows are packed each for itself; pieces of equal length take each other's places in any order."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", drop_near_copies), ("secret scans", hide_secrets), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents` under `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else written(docs, "stage"), sf_dir)
    return docs
