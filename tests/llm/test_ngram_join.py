import random
import re

import numpy as np

from weftline.llm import ngram_join


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(ids, texts, t=90):
    sets = sets_of(texts)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), links[i], str(least.get(root(i)))) for i, d in enumerate(ids))


def families(rng, n_families=25, size=12):
    texts = []
    for _ in range(n_families):
        base = [str(rng.randrange(3000)) for _ in range(rng.choice([3, 8, 40, 200, 400]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "Z" + str(rng.randrange(99))
            texts.append(" ".join(w))
    passage = " ".join("p%d" % i for i in range(60))
    texts += [passage + " " + " ".join(str(rng.randrange(3000)) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    texts += [None, "", " \n", "One Two", "one\ttwo", "one two three four five", "One two three four FIVE", "w " * 4000, "w " * 5000]
    rng.shuffle(texts)
    return texts


def test_similar_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = families(rng)
    ids = list(range(len(texts)))
    ids[3] = None
    ids[7] = ids[8]
    docs = spark.createDataFrame([(d, t, "c") for d, t in zip(ids, texts)], "doc_id long, text string, sid string").repartition(5)
    want = brute(ids, texts)
    assert sorted((str(r.doc_id), r.n_shingles, r.n_similar, str(r.component_id)) for r in ngram_join.similar(docs).collect()) == want
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)  # clusters in several blocks
    assert sorted((str(r.doc_id), r.n_shingles, r.n_similar, str(r.component_id)) for r in ngram_join.similar(docs).collect()) == want
    assert ngram_join.similar(docs.where("false")).count() == 0


def test_trie_links_find_all():
    rng = random.Random(12)
    for _ in range(60):
        pool = [rng.sample(range(200), rng.randint(1, 60)) for _ in range(5)]
        sets = []
        for _ in range(rng.randint(2, 30)):
            s = set(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                s.discard(rng.randrange(200))
                s.add(rng.randrange(200))
            sets.append(s)
        t = rng.choice([50, 80, 90, 100])
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        linked = lambda a, b: 100 * len(a & b) >= t * len(a | b)
        got = {(i, int(b)) for i, found in ngram_join.trie_links(arrays, None, t) for b in found}
        assert got == {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and linked(sets[i], sets[j])}
        k = len(sets) // 2
        if k:
            got = {(i, int(b)) for i, found in ngram_join.trie_links(arrays[:k], arrays[k:], t) for b in found}
            assert got == {(i, j) for i in range(k) for j in range(len(sets) - k) if linked(sets[i], sets[k + j])}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in [1, 2, 5, 9, 10, 11, 19, 40, 100, 333, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            drop = rng.integers(0, max(1, n // 10) + 1)
            b = np.delete(b, rng.choice(len(b), min(drop, len(b) - 1), replace=False))
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 12) + 1)).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 90 * (len(a) + len(b) - shared):
                assert set(ngram_join.signatures(a, 90).tolist()) & set(ngram_join.signatures(b, 90).tolist())


def test_unrelated_sets_share_no_signature():
    """4,000 sets of 1,000 shingles with nothing in common, and smaller ones: an empty part brings none together."""
    rng = np.random.default_rng(6)
    for size, many in ((1000, 4000), (300, 2000), (12, 2000)):
        seen, shared = set(), 0
        for _ in range(many):
            own = set(ngram_join.signatures(np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)), 90).tolist())
            shared += bool(own & seen)
            seen |= own
        assert not shared


def test_sets_with_many_weak_parts_are_parted_again():
    """No link is lost where parts have to be weak: all hashes of a set lie in a few parts."""
    rng = np.random.default_rng(7)
    for size in (12, 60, 400):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 40, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - size // 25], rng.integers(0, 1 << 40, size // 25).astype(np.uint64)]))
            assert set(ngram_join.signatures(a, 90).tolist()) & set(ngram_join.signatures(b, 90).tolist())
            assert set(ngram_join.signatures(a, 90, 1).tolist()) & set(ngram_join.signatures(b, 90, 1).tolist())


def test_a_hot_signature_costs_a_row_for_each_run(spark):
    ids = [i.to_bytes(8, "big") + bytes(8) for i in range(1, 2001)]
    mark = np.array([77], np.int64).tobytes()
    rows = spark.createDataFrame([(i, mark) for i in ids] + [(ids[0], None)], "sid binary, signatures binary").repartition(3)
    edges = [(r.a, r.b) for r in ngram_join._chained(rows).collect()]
    assert len(edges) == 1999
    parent = {i: i for i in range(1, 2001)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len({root(i) for i in parent}) == 1


def test_very_long_text_is_taken_whole(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "t0 t1 t2 t3 t4 t5")]
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (59_996, 1, 1), 2: (59_997, 1, 1), 3: (2, 0, 3)}
