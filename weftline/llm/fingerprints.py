"""Merkle fingerprints of documents.

A text's paragraphs are its lines; a paragraph's leaves are its words, four at a time (a word longer
than 64 characters counts as several). Sections are runs of paragraphs that end where a paragraph's
digest starts with 0 to 3, so that an insertion moves no later border. Parents hash their children's
full digests up to the root. The fingerprint writes the tree down: the root, then for each section its
digest and its paragraphs, each with its leaves, digests shortened to eight digits:

    root:section=paragraph.leaf.leaf,paragraph.leaf;section=...

Equal roots mean equal texts; where roots differ, differing() follows the branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAF = r"(?s)\s*(?:\S{1,64}\s*){1,4}|\s+"


def _short(c: Column) -> Column:
    return F.substring(c, 1, 8)


def paragraphs(text: Column) -> Column:
    """array<struct<digest, short>>: a paragraph's full digest, and its line in the fingerprint."""

    def of(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
        return F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("digest"), F.array_join(F.transform(leaves, lambda x: F.concat(F.lit("."), _short(x))), "").alias("leaves"))

    return F.transform(F.split(text, "\n", -1), of)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the fingerprint of column `text`; a null text counts as empty."""
    df = df.withColumn("_p", paragraphs(F.coalesce(F.col(text), F.lit(""))))
    # one line for each paragraph: full digest, then its part of the fingerprint; ; after a section's last
    line = lambda p: F.concat(p["digest"], p["leaves"], F.when(_short(p["digest"]) < "4", ";").otherwise(""))
    df = df.withColumn("_s", F.split(F.rtrim(F.array_join(F.transform("_p", line), ","), F.lit(";")), ";,?"))

    def section(s: Column) -> Column:
        digest = F.sha2(F.regexp_replace(s, r"\.[0-9a-f]{8}", ""), 256)
        return F.struct(digest.alias("digest"), F.concat(_short(digest), F.lit("="), F.regexp_replace(s, r"([0-9a-f]{8})[0-9a-f]{56}", "$1")).alias("body"))

    df = df.withColumn("_s", F.transform("_s", section))
    root = F.sha2(F.array_join(F.transform("_s", lambda s: s["digest"]), ""), 256)
    return df.withColumn(out, F.concat(root, F.lit(":"), F.array_join(F.transform("_s", lambda s: s["body"]), ";"))).drop("_p", "_s")


def nodes(fp: Column) -> Column:
    """All digests of a fingerprint, from the root down, each once."""
    return F.array_distinct(F.split(fp, "[:=.,;]"))


def likeness(a: Column, b: Column) -> Column:
    """Twice the nodes that two trees share over the nodes of both: 1 for equal texts and only for them.
    Arguments are arrays from nodes()."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: places in `a` (from 0) of paragraphs that no differing section of
    `b` has. Empty for equal roots; sections with equal digests are skipped whole."""

    def body(fp: Column) -> Column:
        return F.split(F.regexp_extract(fp, "(?s)^[0-9a-f]*:(.*)$", 1), ";")

    theirs = body(b)
    heads = F.transform(theirs, _short)
    known = F.flatten(F.transform(F.array_except(theirs, body(a)), lambda s: F.split(F.substring_index(s, "=", -1), ",")))
    walked = F.transform(
        body(a),
        lambda s, i: F.when(F.array_contains(heads, _short(s)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.filter(
                F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p, k: F.when(~F.array_contains(known, p), F.struct(i.alias("section"), k.alias("paragraph")))),
                lambda x: x.isNotNull(),
            )
        ),
    )
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(walked))


def with_next(docs: DataFrame, order: str, carry: str) -> tuple[DataFrame, object]:
    """`docs` in ranges of `order` and the window in which a row's next one follows it.

    Ranges are cut by approximate percentiles. The first rows of a range stand also at the end of the
    range before it (`_ghost`; after the last range comes the first again), so the next row is always
    in the same range and the texts move through one shuffle. Nulls come first; ties by `carry`.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col(order), F.lit(-(2**63)).cast("long"))
    n = min(10_000, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(k.alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    def bucket_of(key: Column) -> Column:
        return F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= key)) if cuts else F.lit(0)

    bucket = bucket_of(k)
    firsts = sorted(ids.groupBy(bucket_of(F.col("k")).alias("bucket")).agg(F.min("k").alias("first")).collect()) if cuts else []  # <= n rows
    placed = docs.withColumn("_k", k).withColumn("_bucket", bucket)
    if len(firsts) > 1:
        back = F.create_map(*[F.lit(x) for i, (_, first) in enumerate(firsts) for x in (int(first), int(firsts[i - 1][0]))])
        homes = F.array_compact(F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("ghost")), F.when(back[F.col("_k")].isNotNull(), F.struct(back[F.col("_k")].alias("bucket"), F.lit(True).alias("ghost")))))
        placed = placed.withColumn("_home", F.explode(homes)).withColumn("_bucket", F.col("_home.bucket")).withColumn("_ghost", F.col("_home.ghost")).drop("_home")
    else:  # one range: everything once more as ghosts of itself would be the same
        placed = placed.withColumn("_ghost", F.explode(F.array(F.lit(False), F.lit(True))))
    return placed, W.partitionBy("_bucket").orderBy("_ghost", "_k", carry)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document in ascending doc_id; after the last comes the first. Null texts count as empty.
    Null ids (which count as one lowest id) come first; rows of one id follow each other by text. A lone
    document is its own next one. An empty table gives no rows. Texts of any length are taken whole, other columns are ignored.
    doc_id must be an integer.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    placed, window = with_next(rows, "doc_id", "_text")
    both = placed.withColumn("_next", F.lead("_text").over(window)).withColumn("_own", F.col("_text"))
    both = both.withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("_edited", F.concat(F.left("_text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("_next", F.lit("")), half)))
    both = fingerprint(both, "_text", "fingerprint").withColumn("_next_fp", F.lead("fingerprint").over(window))
    both = fingerprint(both.where("not _ghost"), "_edited", "edited_fingerprint")
    both = both.withColumn("_a", nodes(F.col("fingerprint")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("_a"), nodes(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("_a"), nodes(F.col("_next_fp"))).alias("near_next"),
    )
