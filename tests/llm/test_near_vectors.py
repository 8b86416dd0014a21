import numpy as np
import pytest

from weftline.llm import near_vectors


def brute(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), links[i], str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("dim", [3, 32])
def test_near_equals_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for f in range(12):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 9)):
            x = centre + rng.normal(0, 0.12 * np.linalg.norm(centre) / np.sqrt(dim), dim)
            rows += [x.astype(np.float32).tolist()] * int(rng.integers(1, 3))
    rows += [rng.normal(size=dim).tolist() for _ in range(60)]
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim + 1), [1.0] * (dim + 1)]
    rows = [(i if i != 5 else None, v) for i, v in enumerate(rows)] + [(2, rows[2])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, v string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in near_vectors.near(df).collect())
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    lost = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert 0 <= lost <= 0.01 * sum(w[1] for w in want)
    assert lost or got == want
    assert near_vectors.near(df.where("false")).count() == 0


def pairs_at(u, rng, cosine=0.9):
    r = rng.normal(size=u.shape)
    r -= (r * u).sum(1)[:, None] * u
    return cosine * u + np.sqrt(1 - cosine**2) * r / np.linalg.norm(r, axis=1)[:, None]


def test_calibration_reaches_its_recall():
    m, t, count = near_vectors.calibrate(64, 16384, 0.9, 0.99)
    assert (m, t, count) == (4096, 18, 4)
    rng = np.random.default_rng(1)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    (lu, pu), (lv, pv) = near_vectors.farthest(u, m, t), near_vectors.farthest(pairs_at(u, rng), m, t)
    hits = [len(set(a) & set(b)) >= count for a, b in zip(lu.tolist(), lv.tolist())]
    assert np.mean(hits) > 0.98


def test_directions_come_in_blocks(monkeypatch):
    x = np.random.default_rng(2).normal(size=(50, 16))
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    lists, far = near_vectors.farthest(x, 256, 9)
    p = x.astype(np.float32) @ np.concatenate([near_vectors.directions(16, k, 64) for k in range(4)], 1)
    want = np.sort(np.abs(p), 1)[:, -9:]
    assert np.allclose(np.sort(far, 1), want) and all(len(set(r)) == 9 for r in (lists >> 1).tolist())
    assert np.allclose(np.take_along_axis(p, lists >> 1, 1) * np.where(lists & 1, -1, 1), far)


def candidates(x, m, t, count, w):
    """Pairs that pass, by brute force over the lists."""
    lists, far = near_vectors.farthest(x, m, t)
    key, far, who = lists.reshape(-1), far.reshape(-1), np.repeat(np.arange(len(x)), lists.shape[1])
    order = np.lexsort((far, key))
    key, far, who = key[order], far[order], who[order]
    found, step = [], 1
    while (same := (key[step:] == key[:-step]) & (far[step:] - far[:-step] <= w)).any():
        a, b = who[:-step][same], who[step:][same]
        found.append(np.minimum(a, b).astype(np.int64) * len(x) + np.maximum(a, b))
        step += 1
    pair, n = np.unique(np.concatenate(found), return_counts=True)
    return pair[n >= count]


@pytest.mark.parametrize("mean_cosine", [0.5, 0.8])
def test_vectors_with_a_mean_keep_recall_and_few_candidates(mean_cosine):
    per = []
    for n in (1600, 6400):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64))
        x = np.sqrt(1 - mean_cosine) * x / np.linalg.norm(x, axis=1)[:, None] + np.sqrt(mean_cosine) * np.eye(64)[3]
        x /= np.linalg.norm(x, axis=1)[:, None]
        x = np.concatenate([x, pairs_at(x[: n // 4], rng, 0.9001)])
        middle = x.mean(0)
        left = float(np.quantile(np.linalg.norm(x - middle, axis=1), 0.02))
        m, t, count = near_vectors.calibrate(64, n, 0.9, 0.99, round(left, 2))
        found = candidates(x - middle, m, t, count, near_vectors.window(64, 0.9))
        planted = np.arange(n // 4) * len(x) + np.arange(n, len(x))
        assert np.isin(planted, found).mean() >= 0.99
        per.append(len(found) / len(x))
    assert per[1] <= 2 * max(per[0], 5) and per[1] < 200  # fourfold vectors: no more than twice


def test_near_with_a_mean_and_crowded_cells_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 20)
    monkeypatch.setattr(near_vectors, "SHARE", 1_000_000)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 24)) + 4 * np.eye(24)[0]
    x = np.concatenate([x, x[:60] + rng.normal(0, 0.4, (60, 24))]).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in near_vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = brute(rows)
    every = sum(w[1] for w in want)
    assert every > 100 and sum(g[1] for g in got) >= 0.985 * every
    assert all(g[1] <= w[1] for g, w in zip(got, want))
