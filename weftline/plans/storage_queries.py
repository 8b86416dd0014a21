"""Queries that write the driver's rows as files and read them back: typed scans, sinks, jobs, binary images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audit, events, images, routing
from weftline.operators import text as text_op
from weftline.plans import compile as compiler
from weftline.plans import views
from weftline.plans.text_queries import ORACLES as TEXT
from weftline.plans.workload_queries import ORACLES, QUERIES, REVIEW, query  # noqa: F401 (the catalogue reads both)
from weftline.sources import files, sinks
from weftline.streaming import rounds as streaming

CHUNK = 100_000


def _home(spark: SparkSession, name: str) -> str:
    return streaming.scratch(spark, name)


def _save(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


# --- scans

_LINES = "lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)"


@query("scan_lines", f"WITH {_LINES} SELECT value, count(*) AS n FROM lines WHERE value <> '' GROUP BY value")
def _scan_lines(spark, d):
    path = _save(views.table(spark, d, "documents").select("text"), _home(spark, "lines"))
    return files.text_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("scan_lines_cycled", f"WITH {_LINES} SELECT 1 AS run, count(*) AS n, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM lines WHERE value <> ''")
def _scan_cycled(spark, d):
    """Run number 3 of two paths reads the second one."""
    home = _home(spark, "cycled")
    paths = [_save(views.table(spark, d, t).select(c), f"{home}/{t}") for t, c in (("benchmark", "text"), ("documents", "text"))]
    return files.text_lines(spark, files.cycled(paths, 3)).agg(F.lit(1).alias("run"), F.count("*").alias("n"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes"))


@query("scan_whole_files", "SELECT user_id % 16 AS bucket, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1")
def _scan_whole(spark, d):
    home = _home(spark, "whole")
    rows = views.table(spark, d, "events").select((F.col("user_id") % 16).alias("bucket"), F.col("props").alias("value"))
    rows.repartition(16, "bucket").write.partitionBy("bucket").option("lineSep", "\n").text(home)
    found = files.whole_files(spark, [f"{home}/*/*.txt"])
    return found.groupBy(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint").alias("bucket")).agg(F.sum(F.octet_length("payload")).cast("bigint").alias("bytes"))


@query("scan_trades", f"WITH {views.TRADES_SQL.format(symbol='p_brand')} SELECT trade_id, symbol, price_cents, quantity, side, mins, account FROM trades")
def _scan_trades(spark, d):
    t = views.trades(spark, d, "p_brand")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    raw = t.select(
        "trade_id", "symbol", F.concat(F.expr("price_cents div 100").cast("string"), F.lit("."), two(F.col("price_cents") % 100)).alias("price"), "quantity",
        F.when(F.col("side") == 0, "BUY").otherwise("SELL").alias("side"), F.concat(two(F.expr("mins div 60")), F.lit(":"), two(F.col("mins") % 60)).alias("time"), F.concat(F.lit("ACC"), F.lpad(F.col("account").cast("string"), 3, "0")).alias("account"),
    )
    home = _home(spark, "trades")
    raw.write.csv(home, header=True)
    return audit.trades(files.trade_csv(spark, home))


@query("scan_samples", f"WITH {views.SAMPLES_SQL} SELECT label, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * j) AS BIGINT) AS weighted, count(*) AS cells FROM samples GROUP BY label")
def _scan_samples(spark, d):
    s = views.sample_arrays(spark, d)
    path = _save(s.select(F.concat_ws(",", F.col("label").cast("string"), F.transform("features", lambda x: x.cast("string"))).alias("value")), _home(spark, "samples"))
    cells = files.sample_csv(spark, path).select("label", F.posexplode("features").alias("j", "x"))
    return cells.groupBy("label").agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("j")).alias("weighted"), F.count("*").alias("cells"))


@query("scan_events", f"WITH {views.app_sql(REVIEW)} SELECT op, key, val FROM app")
def _scan_events(spark, d):
    path = _save(views.app_events(spark, d, REVIEW).select(F.concat_ws(",", "op", F.col("key").cast("string"), "val").alias("value")), _home(spark, "events"))
    return files.event_lines(spark, path).select("op", "key", "val")


@query("scan_fixed_width", f"WITH {views.KEYS_SQL} SELECT key, CAST(seq AS VARCHAR) AS payload FROM keys")
def _scan_fixed(spark, d):
    path = _save(views.keys(spark, d).select(F.concat("key", F.col("seq").cast("string")).alias("value")), _home(spark, "fixed"))
    return files.fixed_width(files.text_lines(spark, path))


@query("scan_slice", "WITH r AS (SELECT event_id AS seq, props, strlen(props) + 1 AS b FROM events), c AS (SELECT seq, props, CAST(sum(b) OVER (ORDER BY seq) AS BIGINT) - b AS before, CAST(sum(b) OVER () AS BIGINT) AS total FROM r) SELECT count(*) AS n, min(seq) AS first, max(seq) AS last FROM c WHERE before >= total // 4 AND before < total // 2")
def _scan_slice(spark, d):
    """The lines that begin in the second quarter of the bytes."""
    lines = views.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("value"))
    return files.sliced(lines, 0.25, 0.5).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query("inline_items", "SELECT CAST(i AS BIGINT) AS seq, 'item' || CAST(i AS VARCHAR) AS payload FROM (SELECT unnest(range(0, 40)) AS i)")
def _inline(spark, d):
    return files.inline(spark, [f"item{i}" for i in range(40)])


_MARKET = ", ".join(f"('{k}', {c}, {m} * 1000000)" for k, (c, m) in files.MARKET.items())
query("market_prices", f"SELECT symbol, CAST(avg_cents AS BIGINT) AS avg_cents, CAST(avg_vol AS BIGINT) AS avg_vol FROM (VALUES {_MARKET}) AS t(symbol, avg_cents, avg_vol)")(lambda spark, d: files.market(spark))


@query("route_labelled", "SELECT CAST(o AS BIGINT) AS origin, count(*) AS n, CAST(sum(strlen(p)) AS BIGINT) AS bytes FROM (SELECT 5 AS o, 'StreamPayload_P5_seq' || CAST(i AS VARCHAR) AS p FROM (SELECT unnest(range(0, 3)) AS i) UNION ALL SELECT 7, 'p=7,s=' || lpad(CAST(i AS VARCHAR), 4, '0') || ',DATA_BLOCK_' || lpad(CAST(i AS VARCHAR), 4, '0') || '_' || repeat('X', 27) FROM (SELECT unnest(range(0, 150)) AS i)) GROUP BY o")
def _labelled(spark, d):
    rows = routing.aggregate([files.labelled(spark, 5), files.labelled(spark, 7, heavy=True)])
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).cast("bigint").alias("bytes"))


# --- sinks


@query("output_lines", TEXT["word_count"].replace("SELECT word, count(*) AS n", "SELECT word || ': ' || CAST(count(*) AS VARCHAR) AS value"))
def _output_lines(spark, d):
    home = _home(spark, "words")
    counts = text_op.word_count(views.table(spark, d, "documents")).select("word", F.concat_ws(": ", "word", F.col("n").cast("string")).alias("value"))
    sinks.write_lines(counts, home, order=("word",))
    return files.text_lines(spark, home)


@query("output_split_records", "SELECT CAST(event_id % 3 AS INTEGER) AS place, CAST(max_by(strlen(props), event_id) AS BIGINT) AS bytes FROM events GROUP BY 1")
def _output_split(spark, d):
    home = _home(spark, "records")
    targets = [f"{home.removeprefix('file:')}/r{i}" for i in range(3)]
    sinks.write_split(views.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("payload")), targets)
    found = files.whole_files(spark, targets)
    return found.select(F.regexp_extract("path", r"r(\d)$", 1).cast("int").alias("place"), F.octet_length("payload").cast("bigint").alias("bytes"))


@query("watch_dump", f"WITH {views.SLOTS_SQL}, n AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS i, * FROM slots) SELECT '[' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || '][src=' || CAST(origin AS VARCHAR) || '] ' || payload AS value FROM n")
def _watch(spark, d):
    home = _home(spark, "watch")
    sinks.watch(views.slots(spark, d), home)
    return files.text_lines(spark, home)


@query("snapshot_totals", f"WITH {views.SLOTS_SQL} SELECT origin, count(*) AS n FROM slots GROUP BY origin")
def _snapshot(spark, d):
    home = _home(spark, "snapshot")
    now, later = sinks.snapshot(views.slots(spark, d), home, "now"), sinks.snapshot_later(views.slots(spark, d), home, "later")
    both = now.unionByName(later()).groupBy("origin").agg(F.count("*").alias("twice"))
    return both.select("origin", F.expr("twice div 2").alias("n"))


@query("split_file", "WITH r AS (SELECT event_id AS seq, props FROM events) SELECT CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes, count(*) AS lines, 5 AS files FROM r")
def _split_file(spark, d):
    home = _home(spark, "split")
    lines = views.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("value"))
    paths = sinks.split_lines(lines, 5, f"{home}/part")
    return files.text_lines(spark, paths).agg(F.sum(F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.count("*").alias("lines"), F.lit(len(paths)).alias("files"))


# --- jobs


def _job(spark: SparkSession, nodes: list[dict], **more) -> compiler.Run:
    return compiler.run(spark, {"nodes": nodes, **more})


def _corpus(spark: SparkSession, d: str) -> str:
    return _save(views.table(spark, d, "documents").select("text"), _home(spark, "corpus"))


@query("job_word_count", TEXT["word_count"])
def _job_words(spark, d):
    """Load, four maps under a grouping, reduce: as a job file says it."""
    nodes = [
        {"id": "in", "kind": {"Input": {"path": _corpus(spark, d)}}},
        {"id": "words", "deps": ["in"], "kind": {"WasmGrouping": {"stages": [{"func": "words"}]}}},
        {"id": "count", "deps": ["words"], "kind": {"PyFunc": {"func": "count_words"}}},
    ]
    return _job(spark, nodes).data["count"]


@query("job_chunked_word_count", TEXT["word_count"])
def _job_chunked(spark, d):
    """The job runs once for each chunk of the input; counts add up in a dataset that outlives the runs."""
    nodes = [
        {"id": "in", "kind": {"Input": {"path": _corpus(spark, d), "chunk_bytes": max(CHUNK, _bytes(spark, d) // 3 + 1)}}},
        {"id": "part", "deps": ["in"], "kind": {"Func": {"func": "word_count"}}},
        {"id": "all", "deps": ["part"], "kind": "Aggregate"},
        {"id": "total", "deps": ["all"], "kind": {"Merge": {"reducer": "wordcount"}}},
    ]
    return _job(spark, nodes, persist_slots=["all"]).data["total"]


def _bytes(spark: SparkSession, d: str) -> int:
    return views.table(spark, d, "documents").agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1


_ROUNDS = "SELECT r AS round, count(*) AS batch_count, CAST(sum(r * 1000 + i) AS BIGINT) AS value_sum FROM (SELECT unnest(range(0, 9)) AS r), (SELECT unnest(range(0, 20)) AS i) WHERE i % 2 = 0 GROUP BY r"


@query("job_stream_pipeline", _ROUNDS)
def _job_stream(spark, d):
    """Nine rounds through two stages, three wide, to three files, and back."""
    home = _home(spark, "stream")
    paths = [f"{home}/{i}" for i in range(3)]
    nodes = [
        {"id": "p", "kind": {"PyPipeline": {"rounds": 9, "stages": [{"func": "even"}, {"func": "mark"}], "width": 3}}},
        {"id": "o", "deps": ["p"], "kind": {"StreamOutput": {"paths": paths, "column": "record", "order": ["round", "i"]}}},
    ]
    _job(spark, nodes)
    number = lambda k: F.regexp_extract("value", r"^r=(\d+),i=(\d+),v=(\d+)", k).cast("bigint")
    return events.round_summary(files.text_lines(spark, paths).select(number(1).alias("round"), number(2).alias("i"), number(3).alias("v")))


@query("job_reset_runs", "SELECT CAST(r % 2 AS INTEGER) AS path, CAST(r AS BIGINT) AS run, 'x' || CAST(r % 3 AS VARCHAR) AS value FROM (SELECT unnest([2, 3]) AS r)")
def _job_reset(spark, d):
    """Four runs over three inputs and two outputs: the last run of an output stays."""
    home = _home(spark, "reset")
    inputs = [_save(files.inline(spark, [f"x{i}"]).select("payload"), f"{home}/in{i}") for i in range(3)]
    outs = [f"{home}/out{i}" for i in range(2)]
    _job(spark, [{"id": "in", "kind": {"Input": {"paths": inputs}}}, {"id": "o", "deps": ["in"], "kind": {"Output": {"paths": outs}}}], mode="reset", runs=4)
    read = [files.text_lines(spark, p).select(F.lit(i).alias("path"), F.lit(i + 2).cast("bigint").alias("run"), "value") for i, p in enumerate(outs)]
    return read[0].unionByName(read[1])


@query("job_file_dispatch", "WITH f AS (SELECT CAST(sum(strlen(props) + 1) AS BIGINT) AS n FROM events), i AS (SELECT n, unnest(range(0, 4)) AS idx FROM f) SELECT idx, idx * (n // 4) + least(idx, n % 4) AS off, n // 4 + CASE WHEN idx < n % 4 THEN 1 ELSE 0 END AS len, CAST(idx % 4 AS BIGINT) AS worker FROM i")
def _job_dispatch(spark, d):
    home = _home(spark, "dispatch")
    views.table(spark, d, "events").select("props").coalesce(1).write.option("lineSep", "\n").text(home)
    done = _job(spark, [{"id": "d", "kind": {"FileDispatch": {"path": f"{home}/*.txt", "workers": 4, "policy": "EqualSlice"}}}])
    return done.data["d"].select("idx", "off", "len", F.col("worker").cast("bigint").alias("worker"))


@query("job_persist_free", f"WITH {views.SLOTS_SQL} SELECT origin, count(*) AS n FROM slots GROUP BY origin")
def _job_persist(spark, d):
    """Waves, a barrier group, a snapshot that is read back after its slot was freed."""
    home = _home(spark, "persist")
    source = _home(spark, "slots")
    views.slots(spark, d).write.parquet(source)
    nodes = [
        {"id": "a", "kind": {"Input": {"path": source, "format": "parquet"}}, "barrier_group": 1},
        {"id": "b", "kind": {"Input": {"path": source, "format": "parquet"}}, "barrier_group": 1},
        {"id": "keep", "deps": ["a"], "kind": {"Persist": {"output_dir": home, "async": True}}},
        {"id": "free", "deps": ["a", "b", "keep"], "kind": {"FreeSlots": {"inputs": ["b"]}}},
    ]
    _job(spark, nodes)
    return spark.read.parquet(f"{home}/a").groupBy("origin").agg(F.count("*").alias("n"))


@query("slot_cursor_reads", f"WITH {views.SLOTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq) AS k FROM slots) SELECT origin, CAST((k - 1) // 100 AS BIGINT) AS read, count(*) AS n, max(seq) AS cursor FROM n WHERE k <= 300 GROUP BY ALL")
def _cursor(spark, d):
    """Three reads of a hundred records each, from where the last one of a slot ended."""
    s, cursors, out = views.slots(spark, d), None, None
    for k in range(3):
        got, cursors = routing.read_next(s, cursors, 100)
        cursors = sinks.snapshot(cursors, _home(spark, "cursor"), str(k))
        part = got.groupBy("origin").agg(F.lit(k).cast("bigint").alias("read"), F.count("*").alias("n"), F.max("seq").alias("cursor"))
        out = part if out is None else out.unionByName(part)
    return out


# --- images in their binary form


def _binary(pixels: DataFrame) -> DataFrame:
    shape = pixels.groupBy("image_id").agg(
        (F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h"), (F.max("ch") + 1).alias("ch"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "ch", "v"))), lambda p: F.lpad(F.hex(p["v"]), 2, "0")), "").alias("hex"),
    )
    return shape.select("image_id", "w", "h", "ch", F.unhex("hex").alias("pixels"))


def _cells(df: DataFrame, gray: bool) -> DataFrame:
    each = df.select("image_id", "w", "ch", "pixels", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") * F.col("ch") - 1)).alias("at"))
    v = F.conv(F.hex(F.substring(F.col("pixels"), F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    out = each.select("image_id", F.expr("at div (w * ch)").cast("int").alias("r"), F.expr("at div ch % w").cast("int").alias("c"), (F.col("at") % F.col("ch")).alias("ch"), v.alias("v"))
    return out.drop("ch") if gray else out


for _name, _gray in (("rotate", False), ("resize", False), ("grayscale", True), ("equalize", True), ("blur", True)):

    def _image(spark, d, name=_name, gray=_gray):
        start = _binary(views.pixels(spark))
        stage = getattr(images, name)
        return _cells(stage(images.grayscale(start) if name in ("equalize", "blur") else start), gray)

    query(f"image_{_name}_binary", ORACLES[f"image_{_name}"])(_image)


@query("image_fan_out", f"WITH {views.PIXELS_SQL}, half AS (SELECT image_id, count(*) AS cells, CAST(sum(v) AS BIGINT) AS total FROM pixels WHERE r % 2 = 0 AND c % 2 = 0 GROUP BY image_id) SELECT worker, image_id, cells, total FROM half, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS worker) WHERE image_id % 3 = worker")
def _image_fan_out(spark, d):
    """Images dealt out to three workers, halved there, gathered again."""
    dealt = _binary(views.pixels(spark)).withColumn("worker", F.pmod("image_id", F.lit(3)).cast("int"))
    halves = [_cells(images.resize(dealt.where(F.col("worker") == k).drop("worker")), False).withColumn("worker", F.lit(k)) for k in range(3)]
    out = halves[0].unionByName(halves[1]).unionByName(halves[2])
    return out.groupBy("worker", "image_id").agg(F.count("*").alias("cells"), F.sum("v").cast("bigint").alias("total"))


@query("image_pgm", f"WITH {views.PIXELS_SQL} SELECT image_id, CAST(count(*) + 13 AS BIGINT) AS bytes FROM gray GROUP BY image_id")
def _image_pgm(spark, d):
    return sinks.pgm(images.grayscale(_binary(views.pixels(spark)))).select("image_id", F.octet_length("payload").cast("bigint").alias("bytes"))
