"""Jobs to DataFrames: each node adds a dataset or performs a sink; Catalyst plans what lies between."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import merge, routing, state
from weftline.plans import placement, registry, spec
from weftline.sources import files, sinks
from weftline.streaming import rounds


#: an input's lines with their chunk, for all runs of a job
CHUNKS = "chunks:"
#: datasets of `persist_slots` go from run to run under this name
PERSISTED = "persisted:"


class Run:
    """Datasets by node id (and by the names nodes give them), what sinks returned, and the seconds each node took
    (wave, node, seconds): sinks run there, datasets are only planned."""

    def __init__(self, spark: SparkSession, job: spec.Job, number: int = 0, kept: Mapping[str, DataFrame] | None = None) -> None:
        self.spark, self.job, self.number = spark, job, number
        self.data: dict[str, DataFrame] = dict(kept or {})
        self.results: dict[str, object] = {}
        self.pending: list[Callable[[], object]] = []
        self.seconds: list[tuple[int, str, float]] = []
        self.uses = Counter(d for n in job.nodes for d in (*n.deps, *n.params.get("inputs", ())))

    def inputs(self, node: spec.Node) -> list[DataFrame]:
        names = node.params.get("inputs", node.deps)
        missing = [n for n in names if n not in self.data]
        if missing:
            raise spec.SpecError(f"node {node.id!r} reads {missing}, which no node before it has made")
        return [self.data[n] for n in names]

    def put(self, node: spec.Node, df: DataFrame) -> None:
        """A dataset under its node's id, and under `output` if that is given.

        `fanout` asks for so many partitions, capped at what the cluster runs at once.
        """
        if wanted := node.params.get("fanout"):
            df = df.repartition(placement.cap(int(wanted), [self.spark.sparkContext.defaultParallelism], 0))
        if node.params.get("cache") and self.uses[node.id] > 1:
            df = df.persist()
        if names := {node.id, str(node.params.get("output")), str(node.params.get("downstream"))} & set(self.job.persist):
            name = f"{PERSISTED}{sorted(names)[0]}"
            df = self.data[name].unionByName(df) if name in self.data else df
            df = self.data[name] = sinks.snapshot(df, rounds.scratch(self.spark, "kept"), "all")
        self.data[node.id] = df
        if "output" in node.params:
            self.data[node.params["output"]] = df


def _input(run: Run, n: spec.Node) -> None:
    p = n.params
    paths = list(p.get("paths") or ([p["path"]] if "path" in p else []))
    if not paths:
        raise spec.SpecError(f"node {n.id!r}: an input needs path or paths")
    kind = p.get("format", "binary" if p.get("binary") else "text")
    if kind == "binary":
        run.put(n, files.whole_files(run.spark, files.cycled(paths, run.number) if p.get("cycle") else paths))
    elif kind == "text" and "chunk_bytes" in p:
        run.put(n, run.data[f"{CHUNKS}{n.id}"].where(F.col("chunk") == run.number).drop("chunk"))
    elif kind == "text":
        lines = files.ordered_lines(run.spark, files.cycled(paths, run.number))
        run.put(n, files.sliced(lines, *map(float, p["slice"])) if "slice" in p else lines)
    elif kind in ("trades", "samples", "events"):
        read = {"trades": files.trade_csv, "samples": files.sample_csv, "events": files.event_lines}[kind]
        run.put(n, read(run.spark, files.cycled(paths, run.number)))
    else:  # any of Spark's own formats
        reader = run.spark.read.format(kind).options(**p.get("options", {}))
        run.put(n, (reader.schema(p["schema"]) if "schema" in p else reader).load(paths))


def _output(run: Run, n: spec.Node) -> None:
    p, df = n.params, run.inputs(n)[0]
    paths = list(p.get("paths") or [p["path"]])
    column = p.get("column", "payload" if "payload" in df.columns else "value" if "value" in df.columns else df.columns[0])
    if p.get("split_records"):
        sinks.write_split(df, paths, p.get("index", "seq"), column)
        run.results[n.id] = paths
    elif p.get("format", "text") != "text":
        df.write.mode("overwrite").format(p["format"]).options(**p.get("options", {})).save(files.cycled(paths, run.number))
        run.results[n.id] = files.cycled(paths, run.number)
    else:
        if len(df.columns) > 1 and "column" not in p and column == df.columns[0]:
            df = df.select(*p.get("order", []), F.concat_ws(p.get("separator", ": "), *[F.col(c).cast("string") for c in df.columns]).alias("_line"))
            column = "_line"
        run.results[n.id] = sinks.write_cycled(df, paths, run.number, column=column, order=tuple(p.get("order", ())))


def _shuffle(run: Run, n: spec.Node) -> None:
    """Upstream branches by number into `downstream` slots under a policy; each slot is also a dataset `id/slot`."""
    policy = n.params.get("policy", {"type": "Modulo"})
    policy = {"type": policy} if isinstance(policy, str) else policy
    slots = int(n.params.get("slots") or len(n.params.get("downstream", ())) or 1)
    ids = n.params.get("upstream_ids") or range(len(run.inputs(n)))
    branches = [b.withColumn("upstream", F.lit(int(i))) for i, b in zip(ids, run.inputs(n))]
    rows = routing.aggregate(branches)
    kind = policy["type"].lower()
    if kind == "broadcast":
        out = routing.broadcast(rows, slots)
    elif kind == "roundrobin":
        out = routing.shuffle(rows, routing.round_robin(F.col("branch_ord"), slots))
    elif kind == "fixedmap":
        table = {int(a): int(b) for a, b in policy.get("map", ())}
        out = routing.shuffle(rows, routing.fixed_map(F.col("upstream"), table, int(policy.get("default_slot", 0)), slots))
    elif kind == "modulo":
        out = routing.shuffle(rows, routing.modulo(F.col("upstream"), slots))
    else:
        raise spec.SpecError(f"node {n.id!r}: no policy {policy['type']!r}")
    if slots > 1:  # each slot reads it
        out = out.persist()
    run.put(n, out)
    for s in range(slots):
        run.data[f"{n.id}/{s}"] = out.where(F.col("dest") == s)


def _func(run: Run, n: spec.Node) -> None:
    args = n.params.get("args", {})
    run.put(n, registry.lookup(n.params["func"])(run.inputs(n), **args))


def _grouping(run: Run, n: spec.Node) -> None:
    df = run.inputs(n)[0]
    for stage in n.params["stages"]:
        df = registry.lookup(stage["func"])([df], **stage.get("args", {}))
    run.put(n, df)


def _pipeline(run: Run, n: spec.Node) -> None:
    """Rounds of a generated source (or of an input with a column `round`) through named stages, as one plan: rounds
    do not see one another."""
    p = n.params
    stages = [(lambda df, s=s: registry.lookup(s["func"])([df], **s.get("args", {}))) for s in p["stages"]]
    source = run.inputs(n)[0] if n.deps or "inputs" in p else files.rounds(run.spark, int(p["rounds"]), p.get("loads", (20,)))
    run.put(n, rounds.chain(source, stages, int(p.get("width", 1))))


def _stream_output(run: Run, n: spec.Node) -> None:
    """One file for each round: round R to paths[R mod n]."""
    df, p = run.inputs(n)[0], n.params
    path, by = p["paths"], p.get("round", "round")
    column = p.get("column", "payload")
    place = F.pmod(F.col(by), F.lit(len(path)))
    df = df.persist()  # computed once, whatever the number of files
    for k, target in enumerate(path[: int(p.get("rounds", len(path)))]):
        sinks.write_lines(df.where(place == k), target, column, tuple(p.get("order", (by,))))
    df.unpersist()
    run.results[n.id] = path


def _persist(run: Run, n: spec.Node) -> None:
    where = n.params["output_dir"]
    for name, df in zip(n.params.get("inputs", n.deps), run.inputs(n)):
        file = str(name).replace("/", "_")
        if n.params.get("async"):  # written beside what follows, waited for when the run ends
            run.pending.append(sinks.snapshot_later(df, where, file))
        else:
            run.data[name] = sinks.snapshot(df, where, file)
    run.results[n.id] = where


def _watch(run: Run, n: spec.Node) -> None:
    sinks.watch(run.inputs(n)[0], n.params["path"], n.params.get("order", "seq"), n.params.get("origin", "origin"), n.params.get("column", "payload"))
    run.results[n.id] = n.params["path"]


def _free(run: Run, n: spec.Node) -> None:
    for name in n.params.get("inputs", n.deps):
        if name in run.data:
            run.data.pop(name).unpersist()


def _file_dispatch(run: Run, n: spec.Node) -> None:
    """(idx, off, len, worker): byte ranges of each file by a slice policy, worker = idx mod workers."""
    p = n.params
    found = files.whole_files(run.spark, p["path"]).select("path", F.octet_length("payload").cast("bigint").alias("n"), "payload")
    kind = str(p.get("policy", "EqualSlice")).lower()
    if kind.startswith("equal"):
        cut = routing.equal_slices(F.col("n"), int(p["workers"]))
    elif kind.startswith("fixed"):
        cut = routing.fixed_slices(F.col("n"), int(p["max_bytes"]))
    else:
        cut = routing.line_slices(F.decode("payload", "iso-8859-1"), int(p["workers"]))
    run.put(n, found.select("path", F.inline(cut)).withColumn("worker", F.pmod("idx", F.lit(int(p["workers"])))))


KINDS: dict[str, Callable[[Run, spec.Node], None]] = {
    "input": _input,
    "inline": lambda run, n: run.put(n, files.inline(run.spark, n.params["items"])),
    "rounds": lambda run, n: run.put(n, files.rounds(run.spark, int(n.params["rounds"]), n.params.get("loads", (20,)))),
    "seeds": lambda run, n: run.put(n, files.seeds(run.spark, n.params.get("prefix", "pw"), int(n.params["n"]))),
    "file_dispatch": _file_dispatch,
    "output": _output,
    "stream_output": _stream_output,
    "persist": _persist,
    "watch": _watch,
    "free": _free,
    "bridge": lambda run, n: run.put(n, routing.bridge(run.inputs(n)[0])),
    "send": lambda run, n: run.put(n, run.inputs(n)[0]),
    "recv": lambda run, n: run.put(n, run.inputs(n)[0]),
    "aggregate": lambda run, n: run.put(n, routing.aggregate(run.inputs(n))),
    "shuffle": _shuffle,
    "func": _func,
    "grouping": _grouping,
    "pipeline": _pipeline,
    "merge": lambda run, n: run.put(n, merge.reducer(n.params["reducer"])(run.inputs(n))),
    "resolve": lambda run, n: run.put(n, state.resolve(run.inputs(n)[0], n.params["policy"])),
    "atomic_add": lambda run, n: run.put(n, state.totals(run.inputs(n)[0])),
    "atomic_cas": lambda run, n: run.put(n, state.compare_and_swap(run.inputs(n)[0], int(n.params.get("initial", 0)))),
    "barrier": lambda run, n: run.put(n, routing.aggregate(run.inputs(n))),
}


def run(spark: SparkSession, job: str | Mapping | spec.Job, keep: tuple[str, ...] = ()) -> Run:
    """Runs a job `runs` times and returns its last run. Datasets named in `keep` pass from run to run."""
    job = job if isinstance(job, spec.Job) else spec.load(job)
    unknown = sorted({n.kind for n in job.nodes} - set(KINDS))
    if unknown:
        raise spec.SpecError(f"no node kind {', '.join(unknown)}; there are {', '.join(sorted(KINDS))}")
    done, kept, runs = None, {}, job.runs
    for n in job.nodes:
        if "chunk_bytes" in n.params:  # a run for each chunk
            lines = files.ordered_lines(spark, n.params.get("paths") or n.params["path"])
            cut = sinks.snapshot(files.chunked(lines, int(n.params["chunk_bytes"])), rounds.scratch(spark, "chunks"), n.id)
            kept[f"{CHUNKS}{n.id}"] = cut
            runs = max(runs, (cut.agg(F.max("chunk")).first()[0] or 0) + 1)
    for number in range(runs):
        done = Run(spark, job, number, kept)
        for wave, nodes in enumerate(spec.waves(job)):
            for node in nodes:
                began = time.monotonic()
                KINDS[node.kind](done, node)
                done.seconds.append((wave, node.id, time.monotonic() - began))
        for wait in done.pending:
            wait()
        kept = {k: df for k, df in done.data.items() if k in keep or k.startswith((CHUNKS, PERSISTED))}
    if job.merge and done:
        last = done.data[job.nodes[-1].id] if job.nodes[-1].id in done.data else done.inputs(job.nodes[-1])[0]
        done.data["merged"] = merge.reducer(job.merge["reducer"])([last])
    return done
