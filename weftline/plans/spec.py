"""Jobs as data: nodes with an id, a kind, parameters and dependencies; loading, checking and ordering."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

MOST_BARRIERS = 64

#: other names of a kind, as job files spell them
ALIASES = {
    "wasmvoid": "func", "wasmu32": "func", "wasmfatptr": "func", "pyfunc": "func", "wasmgrouping": "grouping", "pygrouping": "grouping",
    "streampipeline": "pipeline", "pypipeline": "pipeline", "owneddispatch": "inline", "filedispatch": "file_dispatch", "streamoutput": "stream_output",
    "freeslots": "free", "remotesend": "send", "remoterecv": "recv", "remoteatomicfetchadd": "atomic_add", "remoteatomicpush": "atomic_add", "remoteatomiccmpswap": "atomic_cas",
}


#: fields of a job; those of the second line name what Spark's own layers do here
JOB_FIELDS = {
    "name", "nodes", "dag", "node_dags", "per_shard_dag", "merge", "shards", "input", "output", "runs", "mode", "persist_slots",
    "shm_path", "wasm_path", "python_script", "python_wasm", "log_level", "rdma", "max_shard_bytes", "distribute", "max_concurrent", "keep_intermediates", "total_nodes", "max_colocation", "shared_inputs", "placement_policy", "hints", "converge_on_coordinator",
}
#: parameters of a node that any kind may have; those of the second line name what Spark's own layers do here
COMMON = {
    "inputs", "output", "fanout", "cache", "upstream", "downstream",
    "slot", "placement", "host", "split", "out_weight", "prefetch", "replicate", "_comment",
}
PARAMS = {
    "input": {"path", "paths", "format", "binary", "cycle", "options", "schema", "chunk_bytes", "slice"},
    "inline": {"items"}, "rounds": {"rounds", "loads"}, "seeds": {"prefix", "n"}, "file_dispatch": {"path", "workers", "policy", "max_bytes"},
    "output": {"path", "paths", "column", "split_records", "index", "format", "options", "separator", "order"},
    "stream_output": {"paths", "column", "round", "rounds", "order"}, "persist": {"output_dir", "async", "atomics", "stream_slots", "shared_state"},
    "watch": {"path", "order", "origin", "column"}, "free": {"slots"}, "bridge": set(), "send": {"peer"}, "recv": {"peer"}, "aggregate": set(),
    "shuffle": {"policy", "slots", "upstream_ids"}, "func": {"func", "args"}, "grouping": {"stages"}, "pipeline": {"rounds", "loads", "stages", "width"},
    "merge": {"reducer"}, "resolve": {"policy"}, "atomic_add": set(), "atomic_cas": {"initial"}, "barrier": set(),
}


class SpecError(ValueError):
    """A job that cannot run as written."""


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    params: Mapping = field(default_factory=dict)
    deps: tuple[str, ...] = ()
    barrier_group: int | None = None


@dataclass(frozen=True)
class Job:
    nodes: tuple[Node, ...]
    name: str = "job"
    runs: int = 1
    merge: Mapping | None = None
    shards: int = 1
    #: datasets (by node id, output or downstream name) that add up over the runs of a job
    persist: tuple[str, ...] = ()


def _node(raw: Mapping) -> Node:
    kind, params = raw.get("kind"), dict(raw.get("params", {}))
    if isinstance(kind, Mapping):  # {"Input": {...}}
        if len(kind) != 1:
            raise SpecError(f"node {raw.get('id')!r}: a kind is one name with its parameters")
        ((kind, more),) = kind.items()
        params |= dict(more or {})
    if not isinstance(kind, str) or "id" not in raw:
        raise SpecError(f"a node needs an id and a kind: {raw!r}")
    low = kind.lower()
    return Node(str(raw["id"]), ALIASES.get(low, low), params, tuple(map(str, raw.get("deps", ()))), raw.get("barrier_group"))


def load(job: str | Mapping) -> Job:
    """A job from JSON text or a mapping.

    `nodes`: one graph. `dag`: the same, one level down. `node_dags`: the graphs of several machines, which
    become one. `per_shard_dag` with `merge`: one graph whose input Spark splits by itself, then a reducer.
    """
    raw = json.loads(job) if isinstance(job, str) else dict(job)
    if "per_shard_dag" in raw:
        inner = load(raw["per_shard_dag"])
        return Job(inner.nodes, raw.get("name", inner.name), 1, raw.get("merge"), int(raw.get("shards") or 1))
    if unknown := set(raw) - JOB_FIELDS - {k for k in raw if k.startswith("_comment")}:
        raise SpecError(f"a job has no field {', '.join(sorted(unknown))}")
    if "dag" in raw:
        return load(raw["dag"])
    if "node_dags" in raw:
        graphs = raw["node_dags"].values() if isinstance(raw["node_dags"], Mapping) else raw["node_dags"]
        nodes = [n for g in graphs for n in (g["nodes"] if isinstance(g, Mapping) else g)]
    elif "nodes" in raw:
        nodes = raw["nodes"]
    else:
        raise SpecError("a job has nodes, dag, node_dags or per_shard_dag")
    reset = raw.get("mode") in ("reset", "Reset")
    out = Job(tuple(map(_node, nodes)), raw.get("name", "job"), int(raw.get("runs", 1)) if reset or "runs" in raw else 1, persist=tuple(map(str, raw.get("persist_slots", ()))))
    check(out)
    return out


def check(job: Job) -> None:
    ids = [n.id for n in job.nodes]
    if len(set(ids)) != len(ids):
        raise SpecError(f"ids repeat: {sorted({i for i in ids if ids.count(i) > 1})}")
    for n in job.nodes:
        if missing := [d for d in n.deps if d not in set(ids)]:
            raise SpecError(f"node {n.id!r} depends on {missing}, which the job does not have")
        if unknown := set(n.params) - COMMON - PARAMS.get(n.kind, set(n.params)):
            raise SpecError(f"node {n.id!r}: {n.kind} has no parameter {', '.join(sorted(unknown))}")
        if "chunk_bytes" in n.params and ("slice" in n.params or n.params.get("binary") or n.params.get("format", "text") != "text"):
            raise SpecError(f"node {n.id!r}: chunks are cut from the lines of a text")
    groups = {n.barrier_group for n in job.nodes if n.barrier_group is not None}
    if len(groups) > MOST_BARRIERS:
        raise SpecError(f"{len(groups)} barrier groups; at most {MOST_BARRIERS}")
    wave_of = {n.id: w for w, wave in enumerate(waves(job)) for n in wave}
    for g in groups:
        if len({wave_of[n.id] for n in job.nodes if n.barrier_group == g}) > 1:
            raise SpecError(f"barrier group {g} has nodes that wait for one another")


def waves(job: Job) -> list[list[Node]]:
    """Nodes that may run together, in the order they are written; a cycle raises."""
    left, done, out = list(job.nodes), set(), []
    while left:
        ready = [n for n in left if all(d in done for d in n.deps)]
        if not ready:
            raise SpecError(f"the nodes {[n.id for n in left]} depend on one another in a cycle")
        out.append(ready)
        done |= {n.id for n in ready}
        left = [n for n in left if n.id not in done]
    return out


def with_frees(job: Job) -> Job:
    """`job` with a node `free:<id>` for each dataset that fans out (`fanout`) to several nodes: it is released when the last
    of them has run."""
    fed = {n.id: tuple(c.id for c in job.nodes if n.id in c.deps) for n in job.nodes if n.params.get("fanout")}
    more = tuple(Node(f"free:{i}", "free", {"inputs": [i]}, users) for i, users in fed.items() if len(users) > 1)
    return replace(job, nodes=job.nodes + more)


def order(job: Job) -> list[Node]:
    return [n for wave in waves(job) for n in wave]
