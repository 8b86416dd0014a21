import random

import numpy as np
import zlib

from weftline.llm import chunks, packing


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    return len(rooms)


def test_tree_finds_the_tightest_room():
    rng = random.Random(1)
    tree, there = packing.RoomTree(50), set()
    for _ in range(3000):
        x = rng.randint(0, 50)
        tree.set(x, x not in there)
        there ^= {x}
        q = rng.randint(0, 51)
        assert tree.tightest(q) == min((y for y in there if y >= q), default=-1)


def test_plan_equals_one_at_a_time():
    rng = random.Random(2)
    for _ in range(300):
        cap = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
        hist = {n: lengths.count(n) for n in lengths}
        rows = packing.plan(hist, cap)
        used = {}
        for length, rank, count, first, per, off in rows:
            for i in range(count):
                used.setdefault(first + i // per, []).append((off + i % per * length, length))
        assert len(used) == best_fit_decreasing(lengths, cap)
        assert sorted(n for b in used.values() for _, n in b) == sorted(lengths)
        for b in used.values():
            at = 0
            for off, n in sorted(b):
                assert off == at
                at += n
            assert at <= cap


def test_pack_whole_and_gapless(spark):
    texts = [None, "", " ", "hello world", "hello world", "a b c " * 2000, "x" * 5000, "<|endoftext|> é"]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack(docs, 64).collect()
    enc = chunks.LibraryEncoder(None)
    want = []
    for i, t, _ in rows:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            p = np.array(ids[k : k + 64], dtype="<u4")
            want.append((str(i), k // 64, k, len(p), zlib.crc32(p.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 64
    assert len(bins) == best_fit_decreasing([w[3] for w in want], 64)
    assert packing.pack(docs.where("false")).count() == 0


def test_values_look_up_chunks_without_going_through_all_that_are_remembered():
    class Memo(chunks.ChunkMemo):
        def __iter__(self):
            raise AssertionError("went through all remembered chunks")

    enc = chunks.LibraryEncoder(None)
    memo = Memo(enc, enc.run_bytes, lambda ids: ids.tobytes(), b"".join, 3)
    texts = ["The end of the end, the END. it's 42 <|endoftext|> é日本", "", "of the a1b2!? the", "x y z", "the x of"]
    for t in texts:  # more chunks than the memo's limit: it forgets in between
        ids = enc.tok.encode(t, add_special_tokens=False).ids
        assert b"".join(memo.values(t.encode().split())) == np.array(ids, dtype="<u4").tobytes()
