"""Text queries over `documents`."""

from __future__ import annotations

from weftline.operators import text as op


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES = {
    "word_count": lambda spark, d: op.word_count(_docs(spark, d)),
    "word_count_summary": lambda spark, d: op.summary(op.word_count(_docs(spark, d))),
    "tfidf_top50": lambda spark, d: op.tf_idf(_docs(spark, d)),
}

_WORDS = r"""
words AS (
  SELECT doc_id, translate(regexp_replace(tok, '[^\p{L}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS tok FROM documents)
)"""

ORACLES = {
    "word_count": f"WITH {_WORDS} SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY word",
    "word_count_summary": f"WITH {_WORDS} SELECT count(*) AS unique_words, CAST(sum(n) AS BIGINT) AS total_occurrences FROM (SELECT word, count(*) AS n FROM words WHERE word <> '' GROUP BY word)",
    "tfidf_top50": f"""WITH {_WORDS},
terms AS (SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM words WHERE strlen(word) >= 3 GROUP BY word),
total AS (SELECT count(*) AS n_docs FROM documents)
SELECT word, tf, df, tf * CASE WHEN n_docs // greatest(df, 1) + 1 <= 1 THEN 0 ELSE length(bin(n_docs // greatest(df, 1) + 1)) - 1 END AS score
FROM terms, total ORDER BY score DESC, word LIMIT 50""",
}
