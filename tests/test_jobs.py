"""Job files, sources and sinks."""

import json
import os

import pytest

from weftline.plans import compile as compiler
from weftline.plans import placement, registry, spec
from weftline.sources import files, sinks


def lines(path):
    """Lines of a folder's part files, in order."""
    return [x for n in sorted(os.listdir(path)) if n.startswith("part") for x in open(os.path.join(path, n), encoding="utf-8").read().split("\n")[:-1]]


def test_word_count_job(spark, tmp_path):
    (tmp_path / "in.txt").write_text("the cat\n\nThe dog\r\ncat É1!\n")
    out = str(tmp_path / "out")
    job = {
        "nodes": [
            {"id": "in", "kind": {"Input": {"path": str(tmp_path / "in.txt")}}},
            {"id": "wc", "deps": ["in"], "kind": {"WasmVoid": {"func": "word_count"}}},
            {"id": "save", "deps": ["wc"], "kind": {"Output": {"path": out, "order": ["word"]}}},
        ]
    }
    done = compiler.run(spark, json.dumps(job))
    assert done.results["save"] == 4
    assert lines(out) == ["cat: 2", "dog: 1", "the: 2", "É: 1"]
    assert {r.word: r.n for r in done.data["wc"].collect()} == {"the": 2, "cat": 2, "dog": 1, "É": 1}


def test_routing_and_state_job(spark):
    items = [f"p{i}" for i in range(5)]
    job = {
        "nodes": [
            {"id": "a", "kind": {"OwnedDispatch": {"items": items}}},
            {"id": "b", "kind": {"OwnedDispatch": {"items": items[:2]}}},
            {"id": "mod", "deps": ["a", "b"], "kind": {"Shuffle": {"policy": {"type": "Modulo"}, "slots": 2, "upstream_ids": [4, 7]}}},
            {"id": "rr", "deps": ["a", "b"], "kind": {"Shuffle": {"policy": {"type": "RoundRobin"}, "slots": 1}}},
            {"id": "fix", "deps": ["a", "b"], "kind": {"Shuffle": {"policy": {"type": "FixedMap", "map": [[0, 1], [1, 9]], "default_slot": 0}, "slots": 2}}},
            {"id": "all", "deps": ["a", "b"], "kind": {"Shuffle": {"policy": {"type": "Broadcast"}, "slots": 3}}},
            {"id": "agg", "deps": ["b", "a"], "kind": "aggregate"},
            {"id": "link", "deps": ["agg"], "kind": "bridge"},
            {"id": "n", "deps": ["link"], "kind": {"Func": {"func": "count"}}},
        ]
    }
    done = compiler.run(spark, job)
    size = {k: v.count() for k, v in done.data.items()}
    assert (size["mod/0"], size["mod/1"], size["rr/0"], size["fix/0"], size["fix/1"]) == (5, 2, 7, 0, 5)
    assert [size[f"all/{i}"] for i in range(3)] == [7] * 3
    assert done.data["n"].first().n == 7
    first = done.data["link"].orderBy("branch_ord", "seq").select("payload").collect()
    assert [r.payload for r in first] == items[:2] + items


def test_rounds_pipeline_job(spark, tmp_path):
    stages = [{"func": "even"}, {"func": "mark"}]
    base = {"id": "p", "kind": {"StreamPipeline": {"rounds": 5, "stages": stages}}}
    wide = {"id": "w", "kind": {"PyPipeline": {"rounds": 5, "stages": stages, "width": 3}}}
    outs = [str(tmp_path / f"r{i}") for i in range(2)]
    job = {"nodes": [base, wide, {"id": "s", "deps": ["p"], "kind": {"Func": {"func": "round_summary"}}}, {"id": "o", "deps": ["p"], "kind": {"StreamOutput": {"paths": outs, "column": "record", "order": ["round", "i"]}}}]}
    done = compiler.run(spark, job)
    assert {r.round: (r.batch_count, r.value_sum) for r in done.data["s"].collect()} == {r: (10, 10000 * r + 90) for r in range(5)}
    assert sorted(map(tuple, done.data["p"].collect())) == sorted(map(tuple, done.data["w"].collect()))
    assert len(lines(outs[0])) == 30 and lines(outs[1])[0] == "r=1,i=00,v=01000|T"


def test_sharded_and_other_forms(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a b a\n" * 50)
    graph = {"nodes": [{"id": "in", "kind": {"Input": {"path": str(tmp_path / "in.txt")}}}, {"id": "wc", "deps": ["in"], "kind": {"Func": {"func": "word_count", "fanout": 4}}}]}
    done = compiler.run(spark, {"per_shard_dag": graph, "shards": 4, "merge": {"reducer": "wordcount"}})
    assert {r.word: r.n for r in done.data["merged"].collect()} == {"a": 100, "b": 50}
    assert [n.id for n in spec.load({"dag": graph}).nodes] == ["in", "wc"]
    two = {"node_dags": [{"nodes": graph["nodes"][:1]}, {"nodes": graph["nodes"][1:]}]}
    assert compiler.run(spark, two).data["wc"].count() == 2


@pytest.mark.parametrize(
    "nodes, what",
    [
        ([{"id": "a", "kind": "bridge", "deps": ["b"]}, {"id": "b", "kind": "bridge", "deps": ["a"]}], "cycle"),
        ([{"id": "a", "kind": "inline"}, {"id": "a", "kind": "inline"}], "repeat"),
        ([{"id": "a", "kind": "inline", "deps": ["x"]}], "does not have"),
        ([{"id": "a", "kind": "inline", "barrier_group": 1}, {"id": "b", "kind": "bridge", "deps": ["a"], "barrier_group": 1}], "barrier"),
        ([{"id": "a"}], "kind"),
    ],
)
def test_bad_jobs(nodes, what):
    with pytest.raises(spec.SpecError, match=what):
        spec.load({"nodes": nodes})


def test_unknown_kind_and_function(spark):
    with pytest.raises(spec.SpecError, match="no node kind"):
        compiler.run(spark, {"nodes": [{"id": "a", "kind": "teleport"}]})
    with pytest.raises(KeyError, match="no function"):
        registry.lookup("nothing")


def test_cycled_runs_split_records_and_snapshots(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"in{i}").write_text(f"x{i}\n")
    outs = [str(tmp_path / f"out{i}") for i in range(2)]
    job = {"nodes": [{"id": "in", "kind": {"Input": {"paths": [str(tmp_path / f"in{i}") for i in range(2)]}}}, {"id": "o", "deps": ["in"], "kind": {"Output": {"paths": outs}}}], "mode": "reset", "runs": 2}
    compiler.run(spark, job)
    assert [lines(o) for o in outs] == [["x0"], ["x1"]]
    df = files.inline(spark, ["a", "b", "c"])
    targets = [str(tmp_path / f"rec{i}") for i in range(2)]
    sinks.write_split(df, targets)
    assert [open(t).read() for t in targets] == ["c", "b"]
    with pytest.raises(ValueError):
        sinks.write_split(df, targets[:1])
    assert sinks.snapshot(df, str(tmp_path / "snap"), "s").count() == 3
    both = {"nodes": [{"id": "a", "kind": {"OwnedDispatch": {"items": ["q"]}}}, {"id": "p", "deps": ["a"], "kind": {"Persist": {"output_dir": str(tmp_path / "p")}}}, {"id": "f", "deps": ["a", "p"], "kind": {"FreeSlots": {"inputs": ["a"]}}}]}
    done = compiler.run(spark, both)
    assert "a" not in done.data and os.path.isdir(tmp_path / "p" / "a")
    sinks.watch(df.selectExpr("seq", "7 AS origin", "payload"), str(tmp_path / "w"))
    assert lines(str(tmp_path / "w"))[0] == "[  0][src=7] a"


def test_a_dump_is_numbered_in_ranges(spark, tmp_path):
    n, many, kept = 4000, str(tmp_path / "many"), spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(0, n, 1, 3).selectExpr(f"{n} - id AS seq", "id % 4 AS origin", "concat('r', id) AS payload")
    sinks.watch(df, many)
    assert lines(many) == [f"[{i:3d}][src={(n - 1 - i) % 4}] r{n - 1 - i}" for i in range(n)]
    sizes = [len(open(os.path.join(many, x)).read().splitlines()) for x in os.listdir(many) if x.startswith("part")]
    assert sum(sizes) == n and max(sizes) < n / 2  # no task had them all
    sinks.watch(df.selectExpr(f"if(seq = 1, null, lpad({n} - seq, 4, '0')) AS name", "7 AS o", "payload AS p"), str(tmp_path / "names"), "name", "o", "p")
    found = lines(str(tmp_path / "names"))
    assert found[:2] + found[-2:] == ["[  0][src=7] r0", "[  1][src=7] r1", f"[{n - 2}][src=7] r{n - 2}", f"[{n - 1}][src=7] r{n - 1}"]
    sinks.watch(df.selectExpr("if(seq = 1, null, seq) AS seq", "origin", "payload"), str(tmp_path / "last"))  # no place: last, as in the SQL
    assert lines(str(tmp_path / "last"))[-1] == f"[{n - 1}][src={(n - 1) % 4}] r{n - 1}"
    sinks.watch(df.where("seq < 0"), str(tmp_path / "none"))
    assert lines(str(tmp_path / "none")) == [] and spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_typed_scans(spark, tmp_path):
    (tmp_path / "t.csv").write_text("trade_id,symbol,price,quantity,side,time,account\n1,A,175.559,100,BUY,10:30,ACC007\n2,B,x,5,SELL,2024-01-01T16:01:00,ACC1\n3,short\n")
    from weftline.operators import audit

    rows = [tuple(r) for r in audit.trades(files.trade_csv(spark, str(tmp_path / "t.csv"))).orderBy("trade_id").collect()]
    assert rows == [(1, "A", 17555, 100, 0, 630, 7), (2, "B", 0, 5, 1, 961, 1)]
    (tmp_path / "s.csv").write_text("label,f0\n3,1,2\n-1,4,x\n\n")
    assert [(r.label, r.features) for r in files.sample_csv(spark, str(tmp_path / "s.csv")).orderBy("sample_id").collect()] == [(3, [1, 2]), (-1, [4, 0])]
    (tmp_path / "e.txt").write_text("# c\n\nlogin,3,pw3\npost,x\n")
    assert [(r.op, r.key, r.val) for r in files.event_lines(spark, str(tmp_path / "e.txt")).orderBy("seq").collect()] == [("login", 3, "pw3"), ("post", 0, None)]
    (tmp_path / "f.txt").write_text("0123456789rest\n")
    assert tuple(files.fixed_width(files.text_lines(spark, str(tmp_path / "f.txt"))).first()) == ("0123456789", "rest")
    assert files.whole_files(spark, str(tmp_path / "f.txt")).first().payload == b"0123456789rest\n"


def test_file_dispatch(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"aa\nbbbb\nc\n")
    for policy, want in (("EqualSlice", [(0, 4), (4, 3), (7, 3)]), ("LineBoundarySlice", [(0, 8), (8, 2)])):
        done = compiler.run(spark, {"nodes": [{"id": "d", "kind": {"FileDispatch": {"path": str(tmp_path / "d.txt"), "workers": 3, "policy": policy}}}]})
        assert [(r.off, r.len) for r in done.data["d"].orderBy("idx").collect()] == want


def test_placement():
    assert placement.apportion(10, [1, 1, 2]) == [3, 2, 5] and placement.apportion(3, [0, 0]) == [2, 1]
    assert placement.cap(50, [16, 16]) == 28 and placement.cap(50, []) == 50
    assert placement.place(5, 2, "pack", 3) == [0, 0, 0, 1, 1] and placement.place(4, 2, "balanced") == [0, 0, 1, 1] and placement.place(3, 2) == [0, 1, 0]
    assert placement.place(6, 2, "weighted", 4, [5, 1]) == [0, 0, 0, 0, 1, 1] and max(map(placement.place(6, 3, "random", 2).count, range(3))) == 2
    assert placement.cut([5, 1, 3, 9], 3) == [1, 2]
    with pytest.raises(ValueError):
        placement.place(5, 2, "pack", 2)


def test_unknown_parameters_are_refused(spark):
    for nodes, what in (
        ([{"id": "a", "kind": {"Input": {"path": "x", "chunk_size": 3}}}], "chunk_size"),
        ([{"id": "a", "kind": {"Input": {"path": "x", "binary": True, "chunk_bytes": 3}}}], "chunks are cut"),
        ([{"id": "a", "kind": {"Shuffle": {"policies": "Modulo"}}}], "policies"),
    ):
        with pytest.raises(spec.SpecError, match=what):
            spec.load({"nodes": nodes})
    with pytest.raises(spec.SpecError, match="persist_slot"):
        spec.load({"nodes": [], "persist_slot": [1]})
    known = {"nodes": [{"id": "a", "kind": {"Input": {"path": "x", "slot": 0, "prefetch": True, "replicate": True, "_comment": "fine"}}}], "_comment2": "fine", "log_level": "info"}
    assert spec.load(known).nodes[0].params["slot"] == 0


def test_chunks_add_up_in_a_persisted_slot(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"w{'abcde'[i % 5]} x\n" for i in range(200)))
    job = {
        "persist_slots": [200],
        "nodes": [
            {"id": "load", "kind": {"Input": {"path": str(tmp_path / "in.txt"), "slot": 0, "chunk_bytes": 301}}},
            {"id": "map", "deps": ["load"], "kind": {"Func": {"func": "word_count"}}},
            {"id": "aggregate", "deps": ["map"], "kind": {"Aggregate": {"downstream": 200}}},
            {"id": "reduce", "deps": ["aggregate"], "kind": {"Merge": {"reducer": "wordcount"}}},
        ],
    }
    done = compiler.run(spark, job)
    assert done.number == 3  # 1,000 bytes in chunks of 301
    assert {r.word: r.n for r in done.data["reduce"].collect()} == {"x": 200, **{f"w{c}": 40 for c in "abcde"}}
    assert {w for w, _, _ in done.seconds} == {0, 1, 2, 3} and done.data["map"].count() < 7


def test_slices_hold_each_line_once(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join("y" * (i % 17 + 1) + "\n" for i in range(300)))
    whole = sum(len(x) + 1 for x in (tmp_path / "in.txt").read_text().split("\n")[:-1])
    parts = []
    for a, b in ((0, 0.3), (0.3, 0.31), (0.31, 1)):
        done = compiler.run(spark, {"nodes": [{"id": "in", "kind": {"Input": {"path": str(tmp_path / "in.txt"), "slice": [a, b]}}}]})
        parts.append([len(r.value) + 1 for r in done.data["in"].orderBy("seq").collect()])
    assert sum(map(len, parts)) == 300 and sum(map(sum, parts)) == whole
    assert abs(sum(parts[0]) - 0.3 * whole) < 20


def test_split_and_merge_from_the_command_line(spark, tmp_path):
    import subprocess
    import sys

    (tmp_path / "in.txt").write_text("".join(f"word{i % 3}: {i}\n" for i in range(50)))
    prefix = str(tmp_path / "part")
    run = lambda *args: subprocess.run([sys.executable, "-m", "weftline", *args], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = run("split", str(tmp_path / "in.txt"), "4", prefix)
    assert out.stdout.split() == [f"{prefix}.{i}" for i in range(4)], out.stderr[-500:]
    parts = [lines(f"{prefix}.{i}") for i in range(4)]
    assert sum(parts, []) == (tmp_path / "in.txt").read_text().split("\n")[:-1] and min(map(len, parts)) > 8
    assert run("merge", "sum", str(tmp_path / "sum"), *[f"{prefix}.{i}" for i in range(4)]).returncode == 0
    assert lines(str(tmp_path / "sum")) == [f"word{k}: {sum(i for i in range(50) if i % 3 == k)}" for k in range(3)]
    assert run("split", "x").returncode == 2
    (tmp_path / "five.txt").write_text("a\nb\nc\nd\ne\n")
    assert len(sinks.split_lines(files.ordered_lines(spark, str(tmp_path / "five.txt")), 7, str(tmp_path / "few"))) == 7
    assert sum((lines(str(tmp_path / f"few.{i}")) for i in range(7)), []) == ["a", "b", "c", "d", "e"]


def test_capacity_affinity_and_copies():
    hosts = [{"cpu": 0.9, "running": 1, "memory": 8e9, "cores": 8}, {"cpu": 0.1, "memory": 2e9, "migrations": 50, "cores": 4}, {"cores": 0}]
    assert placement.load(hosts) == pytest.approx([0.3 * 0.9 + 0.25 + 0.2, 0.03 + 0.05 + 0.1, 0])
    assert sum(placement.capacities(hosts)) == pytest.approx(1) and placement.capacities(hosts)[2] == max(placement.capacities(hosts))
    assert placement.limits(hosts) == [1, 3, 1] and placement.least_loaded(hosts, 2) == [2, 1]
    node = lambda i, deps=(), **params: spec.Node(i, "func", params, deps)
    chain = [node("a", host=1), node("b", ("a",)), node("c", ("b",)), node("d", ("a",))]
    assert placement.assign(chain, [0.2, 0.8], [9, 9]) == {"a": 1, "b": 1, "c": 1, "d": 1}
    # two a host: b and c stay with what they read; an edge to avoid outweighs two others
    assert placement.assign([node("x", host=0), node("y", host=1), *chain[1:]], [0.5, 0.5], [2, 2])["b"] in (0, 1)
    pulled = [node("p", host=0, split="avoid"), node("q", host=1), node("r", host=1), node("s", ("p", "q", "r")), node("t", ("q", "r"))]
    assert placement.assign(pulled, [0.5, 0.5], [1, 1]) == {"p": 0, "q": 1, "r": 1, "s": 0, "t": 1}
    assert placement.on_all_hosts([node("in", placement="all"), node("m", ("in",), placement="all"), node("sum", ("m",))], 2) == [
        ("in@0", 0, ()), ("in@1", 1, ()), ("m@0", 0, ("in@0",)), ("m@1", 1, ("in@1",)), ("sum", 0, ("m@0", "m@1")),
    ]


def test_fan_outs_are_freed_after_their_users(spark):
    nodes = [
        {"id": "a", "kind": {"OwnedDispatch": {"items": ["x", "y"], "fanout": 2, "cache": True}}},
        {"id": "b", "deps": ["a"], "kind": {"Func": {"func": "count"}}},
        {"id": "c", "deps": ["a"], "kind": "bridge"},
    ]
    job = spec.with_frees(spec.load({"nodes": nodes}))
    assert [(n.id, n.deps) for n in job.nodes[3:]] == [("free:a", ("b", "c"))]
    done = compiler.run(spark, job)
    assert "a" not in done.data and done.data["b"].first().n == 2
