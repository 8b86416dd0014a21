import random
import zlib

import numpy as np

from weftline.llm import quality


def test_pairs_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + quality.DENSE).astype(np.float32), rng.normal(0, 0.3, (quality.BUCKETS + quality.DENSE, 4)).astype(np.float32))
    sets = []
    for n in (1, 5, 20):
        sets.append((np.sort(rng.choice(quality.BUCKETS, n, replace=False)), rng.random(n).astype(np.float32)))
    for (idx, val), got in zip(sets, m.score(sets)):
        raw = 0.3 + (m.w[idx] * val).sum()
        for i in range(len(idx)):
            for j in range(i):
                raw += (m.v[idx[i]] * m.v[idx[j]]).sum() * val[i] * val[j]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-4


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        ws = rng.choices(words, k=rng.randint(5, 120))
        docs.append((i, " ".join(w + "###" if bad and rng.random() < 0.6 else w for w in ws), "c"))
        labels.append((i, 0 if bad else 1))
    docs += [(None, "word1", "c"), (None, None, "c"), (5000, "", "c"), (5001, None, "c"), (3, docs[3][1], "c"), (5002, "x" * 300_000, "c")]
    labels += [(None, 1), (7, None), (8, 5), (9, labels[9][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(d, y).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    kept = quality.keep_good(d, y)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.classify(d.where("false"), y).count() == 0
    assert {r.score for r in quality.classify(d, y.where("false")).collect()} == {0.5}
