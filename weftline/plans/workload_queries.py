"""Queries of the workloads other than text, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import audit, events, images, linalg, merge, ml, routing, sort, state, text
from weftline.plans import placement, views
from weftline.sources import files
from weftline.streaming import rounds as streaming

REVIEW = {"view": "login", "signup": "login", "purchase": "rate", "click": "review"}
SOCIAL = {"view": "profile", "click": "timeline", "purchase": "post", "signup": "login"}
RANGES = 8
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# --- trade audit

_AUDIT = f"""WITH {views.TRADES_SQL.format(symbol="{symbol}")},
t AS (SELECT trades.*, coalesce(avg_cents, 10000) AS ref FROM trades LEFT JOIN prices USING (symbol)),
pairs AS (SELECT account, symbol, count(*) AS n, count(DISTINCT side) AS sides FROM t GROUP BY ALL),
sizes AS (SELECT symbol, count(*) AS n FROM t GROUP BY symbol),
found AS (
  SELECT 0 AS rule_id, 'PRICE_OUTLIER' AS rule, count(*) FILTER (price_cents > 2 * ref) AS violations FROM t
  UNION ALL SELECT 1, 'LARGE_ORDER', count(*) FILTER (quantity > 5000) FROM t
  UNION ALL SELECT 2, 'WASH_TRADE', count(*) FILTER (sides = 2) FROM pairs
  UNION ALL SELECT 3, 'SPOOFING', count(*) FILTER (n > 10) FROM pairs
  UNION ALL SELECT 4, 'CONCENTRATION', count(*) FILTER (n > (SELECT count(*) FROM t) // 20 + 100) FROM sizes
  UNION ALL SELECT 5, 'AFTER_HOURS', count(*) FILTER (mins < 570 OR mins > 960) FROM t
  UNION ALL SELECT 6, 'PENNY_STOCK', count(*) FILTER (price_cents < 500) FROM t
  UNION ALL SELECT 7, 'ROUND_LOT', count(*) FILTER (quantity >= 1000 AND quantity % 1000 = 0) FROM t
)"""

query("finra_audit", _AUDIT.replace("{symbol}", "p_type") + " SELECT * FROM found")(lambda spark, d: audit.audit(views.trades(spark, d), views.prices(spark, d)))
query("finra_totals", _AUDIT.replace("{symbol}", "p_brand") + " SELECT count(*) AS total_rules_executed, CAST(sum(violations) AS BIGINT) AS total_violations FROM found")(
    lambda spark, d: audit.totals(audit.audit(views.trades(spark, d, "p_brand"), views.prices(spark, d, "p_brand")))
)
for _r in range(8):
    query(f"finra_rule_{_r}", _AUDIT.replace("{symbol}", "p_type") + f" SELECT rule_id, violations FROM found WHERE rule_id = {_r}")(
        lambda spark, d, r=_r: audit.rule(views.trades(spark, d), views.prices(spark, d), r)
    )

# --- range sort

_OWNER = f"least({RANGES - 1}, (greatest(33, least(96, ascii(substr(key, 1, 1)))) - 33) * {RANGES} // 64)"
_SUM = "CAST(list_sum(list_transform(range(1, 11), lambda i: ascii(substr(key, i, 1)))) AS BIGINT)"
_SUMMARY = f"""WITH {views.KEYS_SQL},
summary AS (SELECT {_OWNER} AS range_id, count(*) AS records, CAST(sum({_SUM}) AS BIGINT) AS keysum, min(lower(hex(key))) AS first_key, max(lower(hex(key))) AS last_key FROM keys GROUP BY 1)"""


@query("terasort_ranges", _SUMMARY + " SELECT * FROM summary")
def _ranges(spark, d):
    return sort.range_summary(views.keys(spark, d), RANGES)


@query("terasort_finalize", _SUMMARY + ", steps AS (SELECT *, lag(last_key) OVER (ORDER BY range_id) AS before FROM summary) SELECT count(*) AS ranges, CAST(sum(records) AS BIGINT) AS records, CAST(sum(keysum) AS BIGINT) AS keysum, bool_and(before IS NULL OR before <= first_key) AS in_order FROM steps")
def _finalize(spark, d):
    return sort.finalize(sort.range_summary(views.keys(spark, d), RANGES))


@query("terasort_sorted", f"WITH {views.KEYS_SQL} SELECT key, seq FROM keys ORDER BY key, seq")
def _sorted(spark, d):
    return sort.sorted_records(views.keys(spark, d).select("key", "seq"), ties=("seq",))


# --- matrices

_PRODUCT = f"WITH {views.MATRIX_SQL}, c AS (SELECT i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY 1, 2)"


def _ab(spark, d):
    """The vectors' transpose and the vectors: 64 by n, and n by 64, over all n rows."""
    return views.matrix(spark, d, "k", "i").select("i", "k", "v"), views.matrix(spark, d, "k", "j")


query("mat_mul", _PRODUCT + " SELECT i, j, v FROM c")(lambda spark, d: linalg.multiply(*_ab(spark, d)))
query("mat_mul_blocks", _PRODUCT + " SELECT i, j, CAST(v AS DOUBLE) AS v FROM c")(lambda spark, d: linalg.multiply_blocks(*_ab(spark, d), block=16))
query("mat_checksum", _PRODUCT + " SELECT CAST(sum(v) AS BIGINT) AS checksum, count(*) AS elements FROM c")(lambda spark, d: linalg.checksum(linalg.multiply(*_ab(spark, d))))
query("mat_tile", f"WITH {views.MATRIX_SQL} SELECT i // 16 AS tile_i, j // 16 AS tile_j, CAST(sum(v) AS BIGINT) AS total, count(*) AS cells FROM (SELECT k AS i, j, v FROM b) GROUP BY 1, 2")(
    lambda spark, d: linalg.tiles(views.matrix(spark, d, "i", "j"), 16, 16).groupBy("tile_i", "tile_j").agg(F.sum("v").alias("total"), F.count("*").alias("cells"))
)

# --- integer machine learning


def _epoch(prev: str, out: str) -> str:
    return f""", {out}_err AS (SELECT sample_id, cls, sum(w * x) - CASE WHEN label = cls THEN 1024 ELSE 0 END AS err FROM samples JOIN {prev} USING (j) GROUP BY sample_id, label, cls),
{out}_g AS (SELECT cls, j, CAST(sum(err * x) AS BIGINT) AS g FROM samples JOIN {out}_err USING (sample_id) GROUP BY cls, j),
{out} AS (SELECT cls, j, w - g // (16 * (SELECT count(DISTINCT sample_id) FROM samples)) AS w FROM {prev} JOIN {out}_g USING (cls, j))"""


_W0 = f"WITH {views.SAMPLES_SQL}, w0 AS (SELECT CAST(cls AS BIGINT) AS cls, j, CAST(0 AS BIGINT) AS w FROM (SELECT unnest(range(0, 10)) AS cls), (SELECT DISTINCT j FROM samples))"
_PREDICT = """, scored AS (SELECT sample_id, label, cls, CAST(sum(w * x) AS BIGINT) AS score FROM samples JOIN {w} USING (j) GROUP BY ALL),
predicted AS (SELECT sample_id, label, cls AS predicted FROM scored QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cls) = 1)"""
_ACCURACY = " SELECT count(*) FILTER (predicted = label) AS correct, count(*) AS total, CAST(sum(predicted) AS BIGINT) AS predsum, count(*) FILTER (predicted = label) * 10000 // count(*) AS acc_bp FROM predicted"

def _fitted(spark, d, epochs):
    return ml.weights_frame(spark, ml.fit(views.sample_arrays(spark, d), epochs=epochs))


query("sgd_epoch1", _W0 + _epoch("w0", "w1") + " SELECT cls, j, w FROM w1")(lambda spark, d: _fitted(spark, d, 1))
query("sgd_epoch2", _W0 + _epoch("w0", "w1") + _epoch("w1", "w2") + " SELECT cls, j, w FROM w2")(lambda spark, d: _fitted(spark, d, 2))
query("sgd_epoch1_long", _W0 + _epoch("w0", "w1") + " SELECT cls, j, w FROM w1")(lambda spark, d: ml.train(views.samples(spark, d), epochs=1))
query("sgd_validate", _W0 + _epoch("w0", "w1") + _epoch("w1", "w2") + _PREDICT.format(w="w2") + _ACCURACY)(
    lambda spark, d: ml.accuracy(ml.infer_arrays(views.sample_arrays(spark, d), _fitted(spark, d, 2)))
)
_MODEL = "WITH " + views.SAMPLES_SQL + ", model AS (SELECT CAST(cls AS BIGINT) AS cls, CAST(j AS BIGINT) AS j, CASE WHEN j % 10 = cls THEN 4 ELSE 1 END AS w FROM (SELECT unnest(range(0, 10)) AS cls), (SELECT unnest(range(0, 64)) AS j))"


def _model(spark):
    return spark.range(640).selectExpr("id div 64 AS cls", "id % 64 AS j", "CASE WHEN id % 64 % 10 = id div 64 THEN 4 ELSE 1 END AS w")


query("ml_inference", _MODEL + _PREDICT.format(w="model") + _ACCURACY)(lambda spark, d: ml.accuracy(ml.infer_arrays(views.sample_arrays(spark, d), _model(spark))))
_PREDICTIONS = _MODEL + _PREDICT.format(w="model") + " SELECT sample_id, label, predicted FROM predicted"
query("ml_predictions", _PREDICTIONS)(lambda spark, d: ml.infer_arrays(views.sample_arrays(spark, d), _model(spark)))
query("ml_predictions_long", _PREDICTIONS)(lambda spark, d: ml.infer(views.samples(spark, d), _model(spark)))

_STUMPS = f"""WITH {views.SAMPLES_SQL},
s AS (SELECT sample_id % 8 AS shard, * FROM samples),
vals AS (SELECT shard, j, x, lead(x) OVER p AS above, row_number() OVER p - 1 AS ti, count(*) OVER (PARTITION BY shard, j) AS m FROM (SELECT DISTINCT shard, j, x FROM s) WINDOW p AS (PARTITION BY shard, j ORDER BY x)),
cand AS (SELECT shard, j, ti, (x + above) // 2 AS thresh FROM vals WHERE above IS NOT NULL AND ti % (CASE WHEN m > 10 THEN m // 10 ELSE 1 END) = 0),
scored AS (SELECT c.shard, c.j, ti, thresh, cls, count(*) FILTER ((x <= thresh) = (label = cls)) AS score FROM cand c JOIN s ON s.shard = c.shard AND s.j = c.j, (SELECT CAST(unnest(range(0, 10)) AS BIGINT) AS cls) GROUP BY ALL),
stumps AS (SELECT shard, cls, j, thresh, score FROM scored QUALIFY row_number() OVER (PARTITION BY shard, cls ORDER BY score DESC, j, ti) = 1)"""


def _sharded(spark, d):
    return views.samples(spark, d).withColumn("shard", F.col("sample_id") % 8)


query("stump_train", _STUMPS + " SELECT * FROM stumps")(lambda spark, d: ml.stumps(_sharded(spark, d)))
query(
    "stump_validate",
    _STUMPS
    + """, votes AS (SELECT sample_id, label, cls, count(*) AS votes FROM samples JOIN stumps ON samples.j = stumps.j AND x <= thresh GROUP BY ALL),
everyone AS (SELECT DISTINCT sample_id, label FROM samples),
won AS (SELECT sample_id, cls FROM votes QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, cls DESC) = 1),
predicted AS (SELECT sample_id, label, coalesce(cls, 9) AS predicted FROM everyone LEFT JOIN won USING (sample_id))"""
    + _ACCURACY,
)(lambda spark, d: ml.accuracy(ml.vote(views.samples(spark, d), ml.stumps(_sharded(spark, d)))))
query("pca_project")(lambda spark, d: ml.pca(views.sample_arrays(spark, d).withColumn("shard", F.col("sample_id") % 8)))

# --- keyed events

query(
    "media_review",
    f"WITH {views.app_sql(REVIEW)} SELECT count(*) AS total_events, count(*) FILTER (op = 'login' AND stored = val) AS login_ok, count(*) FILTER (op = 'rate') AS rate_writes, count(*) FILTER (op = 'review') AS review_writes FROM app LEFT JOIN users USING (key)",
)(lambda spark, d: events.review(views.app_events(spark, d, REVIEW), views.passwords(spark, d)))
query(
    "social_network",
    f"""WITH {views.app_sql(SOCIAL)}, tweets AS (SELECT unnest(range(0, (SELECT max(key) + 2 FROM users))) AS k)
SELECT count(*) AS total_events, count(*) FILTER (op = 'login' AND stored = val) AS login_ok, count(*) FILTER (op = 'profile' AND stored IS NOT NULL) AS profile_reads,
  (SELECT count(*) FROM (SELECT key AS k FROM app WHERE op = 'timeline' UNION ALL SELECT key + 1 FROM app WHERE op = 'timeline') JOIN tweets USING (k)) AS timeline_reads,
  2 * count(*) FILTER (op = 'post') AS tweet_writes FROM app LEFT JOIN users USING (key)""",
)(lambda spark, d: events.social(views.app_events(spark, d, SOCIAL), views.passwords(spark, d)))



def _replayed(spark, d, ops, social):
    """The same totals by a stream that keeps a state for each key."""
    whole = views.table(spark, d, "events")
    users = whole.agg(F.coalesce(F.max("user_id"), F.lit(-1))).first()[0] + 1
    home = streaming.scratch(spark, "events")
    stream = views.as_app_events(spark.readStream.schema(whole.schema).parquet(f"{d}/events.parquet*"), ops)
    return streaming.replay_events(spark, stream, users, social, f"{home}/checkpoint", f"{home}/updates")


query("media_review_stream", ORACLES["media_review"])(lambda spark, d: _replayed(spark, d, REVIEW, False))
query("social_network_stream", ORACLES["social_network"])(lambda spark, d: _replayed(spark, d, SOCIAL, True))

# --- rounds

query("stream_pipeline", "SELECT r AS round, count(*) AS batch_count, CAST(sum(r * 1000 + i) AS BIGINT) AS value_sum FROM (SELECT unnest(range(0, 12)) AS r), (SELECT unnest(range(0, 20)) AS i) WHERE i % 2 = 0 GROUP BY r")(
    lambda spark, d: events.round_summary(events.mark(events.even(files.rounds(spark, 12))))
)
query(
    "stream_pipeline_var",
    "SELECT r AS round, count(*) AS batch_count, CAST(sum(r * 1000 + i) AS BIGINT) AS value_sum FROM (SELECT unnest(range(0, 14)) AS r), (SELECT unnest(range(0, 40)) AS i) WHERE i % 2 = 0 AND i < [4, 4, 40, 40, 40, 4, 4][r % 7 + 1] GROUP BY r",
)(lambda spark, d: events.round_summary(events.mark(events.even(files.rounds(spark, 14, streaming.LOADS)))))
query("events_rounds", f"WITH {views.ROUNDS_SQL} SELECT round, count(*) AS batch_count, CAST(sum(v) AS BIGINT) AS value_sum FROM rounds GROUP BY round")(lambda spark, d: events.round_summary(views.rounds(spark, d)))
_AUTOSCALE = """WITH RECURSIVE loads AS (SELECT CAST(t AS BIGINT) AS tick, CAST([4, 4, 40, 40, 40, 4, 4][t % 7 + 1] AS BIGINT) AS load FROM (SELECT unnest(range(0, 14)) AS t)),
t(tick, load, mean, width) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS BIGINT)
  UNION ALL SELECT loads.tick, loads.load, 0.5 * mean + 0.5 * loads.load,
    width + CAST(sign(least(4, greatest(1, ceil((0.5 * mean + 0.5 * loads.load) / 8))) - width) AS BIGINT) FROM t JOIN loads ON loads.tick = t.tick + 1)
SELECT tick, load, width FROM t WHERE tick >= 0"""
query("autoscale_trace", _AUTOSCALE)(lambda spark, d: streaming.autoscale_frame(spark, [streaming.LOADS[r % 7] for r in range(14)], 1, 4))

# --- routing

query("route_bridge", f"WITH {views.SLOTS_SQL} SELECT * FROM slots")(lambda spark, d: routing.bridge(views.slots(spark, d)))


def _branches(spark, d):
    s = views.slots(spark, d)
    return [s.where(F.col("origin") == i) for i in (2, 0, 3, 1)]


_BRANCHES = f"WITH {views.SLOTS_SQL}, listed AS (SELECT slots.*, CASE origin WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS branch_ord FROM slots)"
query("route_aggregate", _BRANCHES + " SELECT origin, seq, payload, branch_ord FROM listed")(lambda spark, d: routing.aggregate(_branches(spark, d)))
query("route_modulo", _BRANCHES + " SELECT CAST(origin % 3 AS INTEGER) AS dest, count(*) AS n FROM listed GROUP BY 1")(lambda spark, d: routing.slot_counts(routing.shuffle(views.slots(spark, d), routing.modulo(F.col("origin"), 3))))
query("route_round_robin", _BRANCHES + " SELECT branch_ord % 3 AS dest, count(*) AS n FROM listed GROUP BY 1")(
    lambda spark, d: routing.slot_counts(routing.shuffle(routing.aggregate(_branches(spark, d)), routing.round_robin(F.col("branch_ord"), 3)))
)
query("route_fixed_map", _BRANCHES + " SELECT CASE origin WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS dest, count(*) AS n FROM listed WHERE origin <> 1 GROUP BY 1")(
    lambda spark, d: routing.slot_counts(routing.shuffle(views.slots(spark, d), routing.fixed_map(F.col("origin"), {0: 2, 3: 0, 1: 7}, 1, 3)))
)
query("route_broadcast", f"WITH {views.SLOTS_SQL} SELECT CAST(dest AS INTEGER) AS dest, origin, seq FROM slots, (SELECT unnest(range(0, 3)) AS dest)")(lambda spark, d: routing.broadcast(views.slots(spark, d), 3).select("dest", "origin", "seq"))
query("route_fan_out", f"WITH {views.SLOTS_SQL} SELECT dest, count(*) AS n FROM slots, (SELECT unnest([5, 9]) AS dest) GROUP BY 1")(lambda spark, d: routing.slot_counts(routing.fan_out(views.slots(spark, d), (5, 9))))
query("route_scatter", f"WITH {views.SLOTS_SQL} SELECT CAST(seq % 5 AS INTEGER) AS dest, count(*) AS n FROM slots GROUP BY 1")(lambda spark, d: routing.slot_counts(routing.scatter(views.slots(spark, d), 5)))
query("route_by_key", "SELECT CAST(user_id % 6 AS INTEGER) AS dest, count(*) AS n FROM events GROUP BY 1")(lambda spark, d: routing.slot_counts(routing.by_key(views.table(spark, d, "events"), 6, "user_id")))
query("record_counts", f"WITH {views.SLOTS_SQL} SELECT origin, count(*) AS n, max_by(payload, seq) AS latest FROM slots GROUP BY origin")(
    lambda spark, d: views.slots(spark, d).groupBy("origin").agg(F.count("*").alias("n"), F.max_by("payload", "seq").alias("latest"))
)

# --- slices


def _lengths(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n"))


_SLICE = "SELECT doc_id, idx, off, len FROM ({}) "
query(
    "slice_equal",
    "WITH p AS (SELECT doc_id, strlen(text) AS n, least(7, strlen(text)) AS k FROM documents WHERE strlen(text) > 0), i AS (SELECT p.*, unnest(range(0, k)) AS idx FROM p) SELECT doc_id, idx, idx * (n // k) + least(idx, n % k) AS off, n // k + CASE WHEN idx < n % k THEN 1 ELSE 0 END AS len FROM i",
)(lambda spark, d: _lengths(spark, d).select("doc_id", F.inline(routing.equal_slices(F.col("n"), 7))))
query(
    "slice_fixed",
    "WITH i AS (SELECT doc_id, strlen(text) AS n, unnest(range(0, (strlen(text) - 1) // 1000 + 1)) AS idx FROM documents WHERE strlen(text) > 0) SELECT doc_id, idx, idx * 1000 AS off, least(1000, n - idx * 1000) AS len FROM i",
)(lambda spark, d: _lengths(spark, d).select("doc_id", F.inline(routing.fixed_slices(F.col("n"), 1000))))
query(
    "slice_line_boundary",
    """WITH l AS (SELECT doc_id, strlen(text) AS n, string_split(text, chr(10)) AS parts FROM documents WHERE strlen(text) > 0),
e AS (SELECT doc_id, n, list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: strlen(x) + 1)) AS BIGINT)) AS ends FROM l),
c AS (SELECT doc_id, list_sort(list_distinct([0, n] || list_transform(range(1, 4), lambda i: coalesce(list_min(list_filter(ends, lambda e: e > i * n // 4)), n)))) AS cuts FROM e)
SELECT doc_id, i - 1 AS idx, cuts[i] AS off, cuts[i + 1] - cuts[i] AS len FROM (SELECT doc_id, cuts, unnest(range(1, len(cuts))) AS i FROM c)""",
)(lambda spark, d: _lengths(spark, d).where("n > 0").select("doc_id", F.inline(routing.line_slices(F.col("text"), 4))))
query(
    "split_contiguous",
    "WITH r AS (SELECT event_id AS seq, 8 + strlen(props) AS b FROM events), c AS (SELECT seq, CAST(sum(b) OVER (ORDER BY seq) AS BIGINT) - b AS before, CAST(sum(b) OVER () AS BIGINT) AS total FROM r) SELECT seq, CAST(len(list_filter(range(1, 6), lambda w: before >= w * total // 6)) AS INTEGER) AS worker FROM c",
)(lambda spark, d: routing.split_contiguous(views.slots(spark, d), 6).select("seq", "worker"))

# --- shared state

_BEST = {
    "max_id": "writer_id DESC",
    "min_id": "writer_id",
    "last_write": "seq DESC",
    "largest": "strlen(payload) DESC, writer_id DESC",
}
for _p, _o in _BEST.items():
    query(f"policy_{_p}", f"WITH {views.WRITES_SQL} SELECT name, writer_id, payload FROM writes QUALIFY row_number() OVER (PARTITION BY name ORDER BY {_o}) = 1")(lambda spark, d, p=_p: state.resolve(views.writes(spark, d), p))
query(
    "policy_majority",
    "WITH w AS (SELECT user_id AS name, event_id AS writer_id, event_type AS payload FROM events), v AS (SELECT name, payload, count(*) AS n, max(writer_id) AS writer_id FROM w GROUP BY ALL) SELECT name, writer_id, payload FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, payload) = 1",
)(lambda spark, d: state.resolve(views.writes(spark, d).withColumn("payload", F.col("event_type")), "majority"))
query("shared_newest_first", f"WITH {views.WRITES_SQL} SELECT name, seq, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS age FROM writes")(lambda spark, d: state.newest_first(views.writes(spark, d)).select("name", "seq", F.col("age").cast("bigint").alias("age")))
query("atomic_fetch_add", f"WITH {views.WRITES_SQL} SELECT name, seq, seq % 10 AS delta, CAST(sum(seq % 10) OVER (PARTITION BY name ORDER BY seq) AS BIGINT) - seq % 10 AS old_value FROM writes")(
    lambda spark, d: state.fetch_add(views.writes(spark, d).selectExpr("name", "seq", "seq % 10 AS delta")).select("name", "seq", "delta", "old_value")
)
query("atomic_push", f"WITH {views.WRITES_SQL} SELECT name, CAST(sum(seq % 10) AS BIGINT) AS total FROM writes GROUP BY name")(lambda spark, d: state.totals(views.writes(spark, d).selectExpr("name", "seq % 10 AS delta")))
query(
    "atomic_cas",
    f"""WITH RECURSIVE {views.WRITES_SQL}, a AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY seq) AS k, seq % 3 AS compare, (seq + 1) % 3 AS swap FROM writes),
f AS (SELECT name, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT name FROM a)
  UNION ALL SELECT f.name, a.k, CASE WHEN f.v = compare THEN swap ELSE f.v END, f.n + CASE WHEN f.v = compare THEN 1 ELSE 0 END FROM f JOIN a ON a.name = f.name AND a.k = f.k + 1)
SELECT name, v AS final, n AS swaps FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1""",
)(lambda spark, d: state.compare_and_swap(views.writes(spark, d).selectExpr("name", "seq", "seq % 3 AS compare", "(seq + 1) % 3 AS swap")))
query("barrier_two_phase", f"WITH {views.SLOTS_SQL}, one AS (SELECT origin, CAST(sum(seq) AS BIGINT) AS phase1 FROM slots GROUP BY origin) SELECT origin, phase1, CAST(sum(phase1) OVER () AS BIGINT) AS total, count(*) OVER () AS parties FROM one")(
    lambda spark, d: state.two_phase(views.slots(spark, d), "origin", "seq")
)
query("byte_ranges", "SELECT event_id AS seq, substr(props, 3, 5) AS part, substr('XY' || substr(props, 3), 1, length(props)) AS overwritten, CASE WHEN event_id - 50 BETWEEN 0 AND 9000 THEN event_id - 50 END AS place FROM events")(
    lambda spark, d: views.slots(spark, d).select("seq", state.byte_range(F.col("payload"), 2, 5).alias("part"), state.overwrite(F.col("payload"), 0, "XY").alias("overwritten"), state.seek("current", F.col("seq"), F.lit(9000), -50).alias("place"))
)

# --- merging of partial results


def _part_of(column: str, n: int):
    """The one part of `n` a row is in, a null or negative id too."""
    return F.pmod(F.coalesce(F.col(column), F.lit(0)), F.lit(n))


def _parts(spark, d):
    docs = views.table(spark, d, "documents")
    return [text.word_count(docs.where(_part_of("doc_id", 3) == i)) for i in range(3)]


def _as_keys(parts):
    return [p.withColumnRenamed("word", "key") for p in parts]


def _merge_oracles() -> None:
    from weftline.plans.text_queries import ORACLES as TEXT

    counts = TEXT["word_count"]
    ORACLES["merge_wordcount"] = counts
    ORACLES["merge_sum"] = f"SELECT word AS key, CAST(n AS BIGINT) AS total FROM ({counts})"
    ORACLES["merge_topk"] = f"SELECT word AS key, CAST(n AS BIGINT) AS total FROM ({counts}) ORDER BY n DESC, word LIMIT 25"
    ORACLES["chunked_word_count"] = counts


query("merge_wordcount")(lambda spark, d: merge.reducer("wordcount")(_parts(spark, d)))
query("merge_sum")(lambda spark, d: merge.reducer("sum")(_as_keys(_parts(spark, d))))
query("merge_topk")(lambda spark, d: merge.reducer("topk:25")(_as_keys(_parts(spark, d))))
_merge_oracles()


def _counter_parts(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("key"), F.expr("CASE WHEN event_type = 'error' THEN props ELSE cast(user_id AS string) END").alias("value"), F.col("event_id").alias("seq"))
    return [e.where(_part_of("seq", 2) == i) for i in range(2)]


query(
    "merge_counters",
    """WITH e AS (SELECT event_type AS key, CASE WHEN event_type = 'error' THEN props ELSE CAST(user_id AS VARCHAR) END AS value, event_id % 2 * 1099511627776 + event_id AS place FROM events)
SELECT key, CASE WHEN key = 'error' THEN max_by(value, place) ELSE CAST(CAST(sum(try_cast(value AS BIGINT)) AS BIGINT) AS VARCHAR) END AS value, min(place) AS first_seen FROM e GROUP BY key""",
)(lambda spark, d: merge.counters(_counter_parts(spark, d)))
query("merge_concat", "SELECT event_type AS key, event_id AS seq, CAST(event_id % 2 AS INTEGER) AS branch_ord FROM events")(lambda spark, d: merge.concat(_counter_parts(spark, d)).select("key", "seq", "branch_ord"))

# --- images

_BLUR = "SELECT g.image_id, g.r, g.c, CAST(sum(n.v) // count(*) AS INTEGER) AS v FROM gray g JOIN gray n ON n.image_id = g.image_id AND abs(n.r - g.r) <= 1 AND abs(n.c - g.c) <= 1 GROUP BY ALL"
_LUT = """hist AS (SELECT image_id, v, count(*) AS n FROM gray GROUP BY ALL),
cdf AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS cdf, first_value(n) OVER (PARTITION BY image_id ORDER BY v) AS low, sum(n) OVER (PARTITION BY image_id) AS total FROM hist)"""
query("image_grayscale", f"WITH {views.PIXELS_SQL} SELECT image_id, r, c, CAST(v AS INTEGER) AS v FROM gray")(lambda spark, d: images.grayscale_pixels(views.pixels(spark)))
query("image_rotate", f"WITH {views.PIXELS_SQL} SELECT image_id, c AS r, 15 - r AS c, ch, v FROM pixels")(lambda spark, d: images.rotate_pixels(views.pixels(spark)))
query("image_equalize", f"WITH {views.PIXELS_SQL}, {_LUT} SELECT gray.image_id, r, c, CAST(CASE WHEN total = low THEN v ELSE ((cdf - low) * 255 + (total - low) // 2) // (total - low) END AS INTEGER) AS v FROM gray JOIN cdf USING (image_id, v)")(
    lambda spark, d: images.equalize_pixels(images.grayscale_pixels(views.pixels(spark)))
)
query("image_blur", f"WITH {views.PIXELS_SQL} {_BLUR}")(lambda spark, d: images.blur_pixels(images.grayscale_pixels(views.pixels(spark))))
query("image_resize", f"WITH {views.PIXELS_SQL} SELECT image_id, r // 2 AS r, c // 2 AS c, ch, v FROM pixels WHERE r % 2 = 0 AND c % 2 = 0")(lambda spark, d: images.resize_pixels(views.pixels(spark)))

# --- incremental text, planning

query("chunked_word_count")(lambda spark, d: streaming.chunked_word_count(spark, f"{d}/documents.parquet"))
query(
    "fanout_apportion",
    """WITH caps(host, cap) AS (VALUES (0, 3.0), (1, 5.5), (2, 1.25), (3, 6.0)), raw AS (SELECT host, cap / (SELECT sum(cap) FROM caps) * 17 AS share FROM caps),
f AS (SELECT host, CAST(floor(share) AS BIGINT) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, host) AS k FROM raw)
SELECT CAST(host AS BIGINT) AS host, base + CASE WHEN k <= 17 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS copies FROM f""",
)(lambda spark, d: spark.createDataFrame(list(enumerate(placement.apportion(17, [3.0, 5.5, 1.25, 6.0]))), "host bigint, copies bigint"))
