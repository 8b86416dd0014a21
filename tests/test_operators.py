"""Operators against plain Python, and streams against their batch twins."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import audit, events, images, linalg, ml, routing, state
from weftline.streaming import rounds


def gate_trades(n):
    rng = random.Random(5)
    return [(i, f"S{rng.randrange(5)}", rng.randrange(1, 40000), rng.randrange(1, 9000), rng.randrange(2), rng.randrange(1440), rng.randrange(7)) for i in range(n)]


def test_audit_equals_plain_python(spark):
    rows = gate_trades(3000)
    ref = {f"S{i}": 3000 * (i + 1) for i in range(4)}
    t = spark.createDataFrame(rows, "trade_id bigint, symbol string, price_cents bigint, quantity bigint, side int, mins int, account bigint")
    p = spark.createDataFrame(list(ref.items()), "symbol string, avg_cents bigint")
    pairs, sizes = {}, {}
    for _, s, _, _, side, _, a in rows:
        pairs.setdefault((a, s), []).append(side)
        sizes[s] = sizes.get(s, 0) + 1
    want = [
        sum(c > 2 * ref.get(s, 10000) for _, s, c, *_ in rows),
        sum(q > 5000 for _, _, _, q, *_ in rows),
        sum(len(set(x)) == 2 for x in pairs.values()),
        sum(len(x) > 10 for x in pairs.values()),
        sum(n > len(rows) // 20 + 100 for n in sizes.values()),
        sum(m < 570 or m > 960 for *_, m, _ in rows),
        sum(c < 500 for _, _, c, *_ in rows),
        sum(q >= 1000 and q % 1000 == 0 for _, _, _, q, *_ in rows),
    ]
    assert [r.violations for r in audit.audit(t, p).orderBy("rule_id").collect()] == want
    assert [r.violations for r in audit.audit(t.where("false"), p).collect()] == [0] * 8


def contiguous(sizes, n):
    total, seen, w, out = sum(sizes), 0, 0, []
    for s in sizes:
        out.append(w)
        seen += s
        if w + 1 < n and seen >= (w + 1) * total // n:
            w += 1
    return out


def test_contiguous_split(spark):
    rng = random.Random(9)
    for big in (False, True):
        texts = ["x" * (rng.randrange(40) if not big or rng.random() < 0.9 else 2000) for _ in range(120)]
        df = spark.createDataFrame(list(enumerate(texts)), "seq bigint, payload string")
        got = [r.worker for r in routing.split_contiguous(df, 5).orderBy("seq").collect()]
        assert got == contiguous([8 + len(t) for t in texts], 5)


def test_learning_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(-3, 5, (80, 6)), rng.integers(0, 4, 80)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "sample_id bigint, label bigint, features array<bigint>")
    w = np.zeros((4, 6), np.int64)
    for _ in range(3):
        err = x @ w.T
        err[np.arange(80), y] -= 1024
        g = err.T @ x
        w = w - np.sign(g) * (np.abs(g) // (80 * 16))
    assert (ml.fit(df, 4, 3) == w).all()
    got = ml.train(ml.long_samples(df), 4, 3).collect()
    assert all(w[r.cls, r.j] == r.w for r in got) and len(got) == 24
    best = np.argmax(x @ w.T, 1)
    weights = spark.createDataFrame([(r.cls, r.j, r.w) for r in got], "cls bigint, j bigint, w bigint")
    assert {r.sample_id: r.predicted for r in ml.infer(ml.long_samples(df), weights).collect()} == dict(enumerate(best.tolist()))


def test_arrays_infer_as_long_samples_do(spark):
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(-9, 9, (120, 5)), rng.integers(0, 3, 120), rng.integers(-4, 5, (3, 5))
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "sample_id bigint, label bigint, features array<bigint>")
    weights = ml.weights_frame(spark, w)
    want = dict(enumerate(np.argmax(x @ w.T, 1).tolist()))
    assert {r.sample_id: r.predicted for r in ml.infer_arrays(df, weights).collect()} == want
    assert {r.sample_id: r.predicted for r in ml.infer(ml.long_samples(df), weights).collect()} == want
    tied = spark.createDataFrame([(0, 0, [0, 0, 0, 0, 0])], df.schema)
    assert ml.infer_arrays(tied, weights).first().predicted == 0 and ml.infer_arrays(df.where("false"), weights).count() == 0


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(90, 6)) * [40, 20, 9, 3, 1, 0.2]).round()
    df = spark.createDataFrame([(i % 2, i, 0, v.tolist()) for i, v in enumerate(x)], "shard int, sample_id bigint, label bigint, features array<double>")
    got = {r.sample_id: r.projection for r in ml.pca(df, components=2, rounds=60).collect()}
    for shard in (0, 1):
        own = x[shard::2] - x[shard::2].mean(0)
        _, _, axes = np.linalg.svd(own, full_matrices=False)
        want = own @ axes[:2].T
        have = np.array([got[i] for i in range(shard, 90, 2)])
        for k in range(2):  # an axis has no sign of its own
            assert min(np.abs(have[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1.5
    assert ml.pca(df.where("false")).count() == 0


def test_terms_count_within_a_row(spark):
    from weftline.operators import text

    docs = spark.createDataFrame([("The the\tcat, ca't don't",), ("cat É1éé --  the",), (None,), ("",), ("an ox",)], "body string")
    assert {tuple(r) for r in text.word_count(docs, "body").collect()} == {("the", 3), ("cat", 3), ("dont", 1), ("Ééé", 1), ("an", 1), ("ox", 1)}
    got = {r.word: (r.tf, r.df) for r in text.tf_idf(docs, "body").collect()}
    assert got == {"the": (3, 2), "cat": (3, 2), "dont": (1, 1), "Ééé": (1, 1)}


def test_blocks_equal_the_product(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, (23, 17)), rng.integers(0, 9, (17, 11))
    da = spark.createDataFrame([(i, k, int(a[i, k])) for i in range(23) for k in range(17)], "i bigint, k bigint, v bigint")
    db = spark.createDataFrame([(k, j, int(b[k, j])) for k in range(17) for j in range(11)], "k bigint, j bigint, v bigint")
    for df in (linalg.multiply(da, db), linalg.multiply_blocks(da, db, 8)):
        got = {(r.i, r.j): r.v for r in df.collect()}
        assert got == {(i, j): (a @ b)[i, j] for i in range(23) for j in range(11)}


def test_binary_images_equal_pixel_tables(spark):
    rng = np.random.default_rng(6)
    pics = {i: rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for i, (h, w) in enumerate([(5, 8), (1, 1), (7, 3)])}
    binary = spark.createDataFrame([(i, p.shape[1], p.shape[0], 3, p.tobytes()) for i, p in pics.items()], images.IMAGE)
    cells = spark.createDataFrame([(i, r, c, k, int(p[r, c, k])) for i, p in pics.items() for r in range(p.shape[0]) for c in range(p.shape[1]) for k in range(3)], "image_id bigint, r int, c int, ch int, v int")

    def table(df):
        return {(r.image_id, y, x, k): int(v) for r in df.collect() for (y, x, k), v in np.ndenumerate(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w, r.ch))}

    def flat(df):
        return {(r.image_id, r.r, r.c, r.ch if "ch" in df.columns else 0): r.v for r in df.collect()}

    gray, gray_cells = images.grayscale(binary), images.grayscale_pixels(cells)
    assert table(images.rotate(binary)) == flat(images.rotate_pixels(cells))
    assert table(gray) == flat(gray_cells)
    assert table(images.equalize(gray)) == flat(images.equalize_pixels(gray_cells))
    assert table(images.blur(gray)) == flat(images.blur_pixels(gray_cells))
    assert table(images.resize(binary)) == flat(images.resize_pixels(cells))
    chained = images.blur(images.equalize(images.grayscale(images.rotate(binary))))
    assert table(images.pipeline(binary)) == table(chained)
    text = b"P3\n# note\n2 1\n15\n0 15 7 1 2\n"
    files = spark.createDataFrame([("a", text), ("b", b"junk")], "path string, payload binary")
    (r,) = images.parse_netpbm(files).collect()
    assert (r.w, r.h, r.ch, list(r.pixels)) == (2, 1, 3, [0, 255, 119, 17, 34, 0])
    assert images.decode(spark.createDataFrame([("a", b"\x02\x01\x01\x00\x01" + b"z" * 258)], "path string, payload binary")).first()[1:4] == (258, 1, 1)


def test_swap_and_policies(spark):
    rows = [("a", 1, 0, 5), ("a", 2, 5, 6), ("a", 3, 5, 7), ("b", 1, 1, 2)]
    got = state.compare_and_swap(spark.createDataFrame(rows, "name string, seq bigint, compare bigint, swap bigint")).collect()
    assert {r.name: (r.final, r.swaps) for r in got} == {"a": (6, 2), "b": (0, 0)}
    w = spark.createDataFrame([("k", 1, 3, "xx"), ("k", 2, 1, "yyy"), ("k", 3, 2, "xx"), ("k", 4, 0, "abc")], "name string, writer_id bigint, seq bigint, payload string")
    assert {p: tuple(state.resolve(w, p).first())[1:] for p in state.POLICIES} == {"max_id": (4, "abc"), "min_id": (1, "xx"), "last_write": (1, "xx"), "largest": (4, "abc"), "majority": (1, "xx")}


def event_rows(n, users):
    rng = random.Random(8)
    ops = ["login", "rate", "review", "profile", "timeline", "post", "other"]
    return [(i, rng.choice(ops), k, f"pw{k if rng.random() < 0.8 else 0}") for i in range(n) for k in [rng.randrange(users + 3)]]


def test_streams_equal_batches(spark, tmp_path):
    users = 12
    rows = event_rows(300, users)
    schema = "seq bigint, op string, key bigint, val string"
    seeded = spark.range(users).select(F.col("id").alias("key"), F.concat(F.lit("pw"), F.col("id").cast("string")).alias("stored"))
    whole = spark.createDataFrame(rows, schema)
    for social, batch in ((False, events.review), (True, events.social)):
        home = tmp_path / f"s{social}"
        spark.createDataFrame(rows[:150], schema).coalesce(1).write.parquet(str(home / "in"))
        read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(home / "in"))  # noqa: E731,B023
        first = rounds.replay_events(spark, read(), users, social, str(home / "ck"), str(home / "out")).first()
        assert first == batch(spark.createDataFrame(rows[:150], schema), seeded).select(*first.__fields__).first()
        # a second run goes on from the checkpoint
        spark.createDataFrame(rows[150:], schema).coalesce(1).write.mode("append").parquet(str(home / "in"))
        second = rounds.replay_events(spark, read(), users, social, str(home / "ck"), str(home / "out")).first()
        assert second == batch(whole, seeded).select(*second.__fields__).first()


def test_rounds_and_autoscale(spark, tmp_path):
    got = {}
    ticks = rounds.run_rounds(spark, rounds.source_rounds(spark), [events.even, events.mark], 3, lambda df, r: got.update({r: events.round_summary(df).collect()[0][1:]}), width=2)
    assert ticks == 4 and got == {r: (10, 10000 * r + 90) for r in range(3)}
    assert rounds.autoscale(rounds.LOADS * 2, 1, 4)[:5] == [1, 1, 2, 3, 4] and max(rounds.autoscale(rounds.LOADS * 2, 1, 4)) <= 4
    seen = []
    spark.range(20).coalesce(1).selectExpr("id AS i", "0L AS round", "id AS v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i bigint, round bigint, v bigint").parquet(str(tmp_path / "in"))
    rounds.stream_rounds(stream, [events.even], lambda df, b: seen.append(df.count()), str(tmp_path / "ck"))
    rounds.stream_rounds(stream, [events.even], lambda df, b: seen.append(df.count()), str(tmp_path / "ck"))
    assert sum(seen) == 10


def test_parts_hold_each_row_once(spark, tmp_path):
    from weftline.plans.workload_queries import QUERIES

    ids = [None, -7, -2, -1, 0, 1, 2, 5]
    spark.createDataFrame([(i, "x y") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "view", 3, "p") for i in ids], "event_id long, event_type string, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("merge_wordcount")} == {("x", 8), ("y", 8)}
    assert {tuple(r) for r in run("merge_sum")} == {("x", 8), ("y", 8)} == {tuple(r) for r in run("merge_topk")}
    assert [r.value for r in run("merge_counters")] == ["24"]
    assert sorted((r.seq is not None, r.seq or 0) for r in run("merge_concat")) == sorted((i is not None, i or 0) for i in ids)
