"""The queries over the smallest driver tables: columns, and rows against DuckDB SQL where it can express them."""

import os

import pytest

from weftline.llm import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")

COLUMNS = {
    "op1": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean",
    "op2": "vec_id bigint n_links bigint component_id bigint kept boolean",
    "op3": "page_id bigint host string path string rule string verdict string component string",
    "op4": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string",
    "op5": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
    "op6": "doc_id bigint held_out boolean score double predicted int",
    "op7": "doc_id bigint n_shingles bigint n_similar bigint component_id bigint",
    "op8": "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint",
    "op9": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint base_score double score double",
    "op10": "doc_id bigint n_chars bigint edited_sha256 string fingerprint string edited_fingerprint string near_edited double near_next double",
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_columns_and_rows(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert " ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name.split("_")[0]]
    rows = df.collect()
    source = spark.read.parquet(f"{DATA}/{'embeddings' if name.startswith('op2') else 'pages' if name.startswith('op3') else 'documents'}.parquet")
    assert len({r[0] for r in rows}) == source.count()
    if name in catalog.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        rel = con.sql(catalog.oracle_sql()[name])
        at = [rel.columns.index(c) for c in df.columns]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(key([r[i] for i in at]) for r in rel.fetchall()) == sorted(map(key, rows))


def test_held_out_text_scores_above_the_unigram(spark):
    rows = [r for r in catalog.queries()["op9_lm_scoring"](spark, DATA).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
