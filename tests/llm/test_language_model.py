import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import language_model as lm
from weftline.llm.ngram_join import word_hashes


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]


def brute(rows, prior=5.0, allowed=lambda k: True):
    """The longest context with another occurrence in training documents, of every length that is `allowed`."""
    docs = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0, words(t) + [None]) for d, t in rows]
    c = Counter(x for _, held, w in docs if not held for x in w)
    n, v = sum(c.values()), len(c)
    grams, nexts = Counter(), Counter()
    for _, held, w in docs:
        if not held:
            for i in range(len(w)):
                for k in filter(allowed, range(1, i + 1)):
                    grams[tuple(w[i - k : i])] += 1
                    nexts[tuple(w[i - k : i + 1])] += 1
    out = []
    for d, held, w in docs:
        base = score = 0.0
        for i, x in enumerate(w):
            p = (c[x] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            own = 0 if held else 1
            for k in filter(allowed, range(i, 0, -1)):
                if grams[tuple(w[i - k : i])] > own:
                    p = (nexts[tuple(w[i - k : i + 1])] - own + prior * p) / (grams[tuple(w[i - k : i])] - own + prior)
                    break
            score += math.log10(p)
        out.append((str(d), held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return sorted(out)


def compare(spark, rows, want):
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, score string").repartition(4)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-4, (g, w)
    return got, docs


def mixture(longest):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.choice([0, 1, 3, 6, longest]))) for _ in range(40)]
    rows = []
    for i in range(300):
        t = rng.choice(base).split()
        if rng.random() < 0.5 and t:
            t[rng.randrange(len(t))] = "New" + str(i % 7)
        rows.append((i, " ".join(t)))
    rows += [(None, "w1 w2 w3 w4"), (None, None), (20, ""), (20, "w1 w2\tw3\nw4 w5"), (7, " "), (400, "once1 w1 w2 once2 w3 w1"), (401, "once3 once4")]
    return rows + [(500 + i, "the " * min(longest, 40)) for i in range(3)]


@pytest.mark.parametrize("shard", [lm.SHARD, 300])
def test_every_row_is_searched_at_every_length(spark, monkeypatch, shard):
    """Texts of at most 9 tokens: the brute force knows nothing of rounds. Small shards split frequent words."""
    monkeypatch.setattr(lm, "SHARD", shard)
    rows = mixture(8)
    got, docs = compare(spark, rows, brute(rows))
    for held in (True, False):
        assert sum(g[6] for g in got if g[1] == held) > sum(g[5] for g in got if g[1] == held) + 1
    assert lm.score(docs.where("false")).count() == 0
    assert all(r.score == 0 for r in lm.score(docs.where("doc_id = 20")).collect() if r.held_out and not r.train_tokens)


def test_a_shard_holds_no_more_bytes_in_later_rounds():
    """Keys of 64 bits, tokens of 32; on the ladder a key, six rungs, and the place between two of them, all of 64 bits."""
    rows = [12, 4 * (3 + 5), 8 + 4 * 8, 8 + 4 * 16, 8 * (1 + 6 + 2), 8 * (1 + 6 + 2)]
    for k, size in enumerate(rows):
        assert 20_000_000 * size / lm.shards_of(20_000_000, k) <= 32 * lm.SHARD


def test_a_chunk_hashes_each_of_its_words_once(monkeypatch):
    rnd = random.Random(5)
    signs = b" \t\n\r\x0b\x0c\x1c\x1f\x00\x85\xa0\xc2\xffAZaz"
    texts = [b"", None, b" \n", b" The the\tTHE ", b"a", "\u00c4 \u3000x\u0130".encode()] + [bytes(rnd.choices(signs, k=rnd.randrange(30))) for _ in range(500)]
    hashed = []
    monkeypatch.setattr(lm, "word_hashes", lambda words: hashed.extend(words) or word_hashes(words))
    for part in (texts, texts[:3], texts[3:4]):
        expected = [[*(t or b"").lower().split(), lm.END] for t in part]
        hashed.clear()
        cuts = range(0, len(part), 100)
        split = [lm.split_words(pa.array(part, pa.binary()).slice(k, 100)) for k in cuts]
        hashes, tokens = lm.numbered_words([w for w, _ in split], np.concatenate([n for _, n in split]))
        assert np.array_equal(hashes[tokens], word_hashes(sum(expected, [])))
        assert np.concatenate([n + 1 for _, n in split]).tolist() == [len(w) for w in expected]
        assert sorted(hashed) == sorted(set(sum(expected, [])))


def test_rows_with_equal_first_columns_lie_together():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = (1, 3, 60, 2000)[seed % 4]
        columns = [rng.integers(0, 3, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if k else rng.integers(0, 5, n).astype(np.uint32) for k in rng.integers(0, 2, 5)]
        order = lm.grouping(list(columns))
        assert np.array_equal(np.sort(order), np.arange(n))
        rows = list(zip(*[x[order].tolist() for x in columns]))
        for k in range(1, 6):
            runs = [r[:k] for i, r in enumerate(rows) if not i or rows[i - 1][:k] != r[:k]]
            assert len(runs) == len(set(runs))


def test_contexts_beyond_8_tokens_are_rounded_down_to_a_known_length(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 2000)
    monkeypatch.setattr(lm, "CHUNK", 4000)
    some = {x for r in range(9) for x in lm.lengths(r)}
    assert set(range(1, 9)) < some and max(some) > 10_000
    rows = mixture(170)
    compare(spark, rows, brute(rows, allowed=some.__contains__))


def exact(rows, prior=5.0):
    """As `brute` without a limit, for long texts: a context has the number of (the shorter one's number, one more token)."""
    docs = [(d, zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0, words(t) + [None]) for d, t in rows]
    c = Counter(x for _, held, w in docs if not held for x in w)
    n, v = sum(c.values()), len(c)
    number, grams, nexts = {}, Counter(), Counter()
    contexts = []
    for _, held, w in docs:
        own = []
        for i in range(len(w)):
            at, all_ = 0, []
            for k in range(1, i + 1):
                at = number.setdefault((at, w[i - k]), len(number) + 1)
                all_.append(at)
            own.append(all_)
            if not held:
                grams.update(all_)
                nexts.update((x, w[i]) for x in all_)
        contexts.append(own)
    out = []
    for (d, held, w), own in zip(docs, contexts):
        base = score = 0.0
        for i, x in enumerate(w):
            p = (c[x] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            one = 0 if held else 1
            at = next((g for g in reversed(own[i]) if grams[g] > one), None)
            if at is not None:
                p = (nexts[at, x] - one + prior * p) / (grams[at] - one + prior)
            score += math.log10(p)
        out.append((str(d), held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("chunk", [lm.CHUNK, 4000])
def test_the_longest_match_is_found_to_the_token(spark, monkeypatch, chunk):
    """Matches of any length, between the rungs too: copies with different beginnings and ends, repeated lines, runs of a word."""
    monkeypatch.setattr(lm, "SHARD", 2000)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    rows = mixture(60)
    assert [w[:5] for w in brute(rows)] == [w[:5] for w in exact(rows)] and np.allclose([w[6] for w in brute(rows)], [w[6] for w in exact(rows)])
    rng = random.Random(5)
    long = rng.choices([f"z{i}" for i in range(50)], k=420)
    for i in range(14):
        start, stop = (0, 420) if i < 3 else (rng.randrange(200), 420 - rng.randrange(200))
        rows.append((1000 + i, " ".join(["new"] * rng.randrange(3) + [f"x{i % 4}"] + long[start:stop] + [f"y{i % 5}"])))
    held = [d for d in range(3000, 3200) if zlib.crc32(str(d).encode()) % 10 == 0][:3]
    learnt = [d for d in range(3000, 3200) if zlib.crc32(str(d).encode()) % 10 != 0][:4]
    tail = [f"t{i}" for i in range(360)]  # few that match, with beginnings between two rungs
    rows += [(d, " ".join(tail[-k:] + ["end"])) for d, k in zip(learnt + held, (300, 320, 270, 290, 310, 345, 280))]
    rows += [(2000 + i, "a line that comes again and " * (20 + i)) for i in range(4)] + [(2010 + i, "run " * (90 + 13 * i)) for i in range(4)]
    compare(spark, rows, exact(rows))


def test_a_text_that_occurs_twice_scores_above_one_that_does_not(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices([f"v{i}" for i in range(2000)], k=80))
    twice = [text() for _ in range(30)]
    rows = list(enumerate([text() for _ in range(120)] + twice + twice))
    per = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    learnt = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    known = [d for d in range(120, 180) if learnt(d + 30 if d < 150 else d - 30)]  # the other one is learnt from
    assert len(known) > 40 and min(per[d] for d in known) > max(per[d] for d in range(120)) + 0.5


def test_very_long_text_and_packing(spark):
    rows = [(1, "a b c d e f g h " * 30_000), (2, "a b c d e f g h " * 3), (3, "x " + "a b c d e f g h " * 10), (4, "y")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 240_001 and all(np.isfinite(r.score) for r in got.values())
    assert got[1].score > got[1].base_score + 100_000
    for a in (np.zeros(0, np.uint32), np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(9, np.uint8), np.array([-1.5, 2.0])):
        assert (lm.unpacked(lm.packed(a), a.dtype) == a).all()
    up = np.array([3, 3, 70_000, 1 << 31], np.uint32)
    assert (lm.unpacked(lm.packed(up, True), np.uint32, True) == up).all()
