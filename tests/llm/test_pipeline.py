import random

import corpus_pipeline
from weftline.llm import chunks, quality, secrets

from .test_native import base_spans
from .test_ngram_join import brute


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(260):
        ws = rng.choices(words, k=rng.randint(8, 90))
        if i % 5 == 0:
            ws = [w + "###" for w in ws]
        elif i % 7 == 0 and docs:
            ws = docs[-1][1].split() + ["tail"] * (i % 2)
        elif i % 11 == 0:
            ws[3:3] = ["token", "=", "0123456789abcdef0123456789abcdef01234567"]
        docs.append((i, " ".join(ws), "en", "s", len(" ".join(ws))))
        labels.append((i, 0 if i % 5 == 0 else 1, 0))
    docs += [docs[6], docs[6], (300, None, "en", "s", 0), (301, "", "en", "s", 0), (None, "x y z " + docs[12][1], "en", "s", 5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    y.write.parquet(f"{tmp_path}/labels.parquet")

    good = quality.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet"), y).collect()
    assert [r for r in good if r.text and r.text.split()[0].endswith("###")] == []
    assert len([r for r in good if r.text]) >= 200
    # least key of each component
    keys = {}
    rows = sorted(good, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    component = brute(list(range(len(rows))), [r.text for r in rows])
    alive = [r for i, r in enumerate(rows) if dict((int(c[0]), c[3]) for c in component)[i] == str(i)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = chunks.LibraryEncoder(None).tok
    want = []
    for r in alive:
        text, at = "", 0
        for a, _, b in base_spans(r.text or ""):
            if a >= at:
                text += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        text += (r.text or "")[at:]
        want.append((str(r.doc_id), len(tok.encode(text, add_special_tokens=False).ids) + 1))
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted(want)
    assert not keys and len({r.sequence_id for r in got}) < len(got) / 10


def test_stages_keep_columns(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b c d e f", "x", "row", "y", 3)], "doc_id long, text string, spans string, row string, key string, place int")
    y = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    y.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
        assert stage(spark, d, str(tmp_path)).collect() == d.collect()
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
