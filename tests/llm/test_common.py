import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.common import dropped, pieces, shared_dir, spread_join, text_pieces, tidy, written


def test_written_reads_back_and_pieces_cover(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    again = written(df, "t")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.collect()), key=str) and again.schema == df.schema
    assert all(f.startswith("file:" + shared_dir(spark)) or shared_dir(spark) in f for f in again.inputFiles())
    assert list(pieces([b"aa", None, b"", b"bbbb", b"c"], 4)) == [(0, 3), (3, 4), (4, 5)]
    assert list(pieces([b"a" * 99], 4)) == [(0, 1)] and list(pieces([], 4)) == []


def test_a_new_holder_gets_the_memory_that_the_one_before_freed():
    """In a process of its own: freed blocks below one that stays are not returned by themselves."""
    run = """
import re
from weftline.llm.common import claim
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
claim("a", lambda: None)
blocks = [bytearray(b"x" * 100_000) for _ in range(2000)]
before, last = held(), blocks.pop()
blocks.clear()
claim("a", lambda: None)
kept = held()
claim("b", lambda: None)
print(before - kept, before - held())
"""
    kept, freed = map(int, subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True).stdout.split())
    assert kept < 100 < 150 < freed


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, how):
    left = written(spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 > 0, F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"), "id"), "left")
    right = written(spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), ("other", 4), (None, 5)], "key string, v int"), "right")
    want = sorted(map(tuple, left.join(right, "key", how).select("key", "id", "v").collect()), key=str)
    assert sorted(map(tuple, spread_join(left, right, "key", how, most=1000).select("key", "id", "v").collect()), key=str) == want
    assert sorted(map(tuple, spread_join(left, right, "key", how).select("key", "id", "v").collect()), key=str) == want
    assert len(want) > 2000


def test_tables_and_shuffle_files_go(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    df = written(spark.range(10), "gone")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    with tidy(spark):
        assert spark.conf.get(name) == "true" and df.groupBy("id").count().count() == 10
        dropped(df)
    assert not os.path.isdir(folder) and spark.conf.get(name, None) == before
    other = spark.createDataFrame([(1,)], "a int")
    dropped(other)  # nothing of ours
    assert other.count() == 1


def test_text_pieces_cover_a_column():
    texts = [b"ab", None, b"", b"c" * 50, b"d", b"e" * 9, None]
    for most in (1, 10, 1000):
        got = list(text_pieces(pa.array(texts, pa.binary()), most))
        assert [t for _, part in got for t in part] == texts and [a for a, _ in got] == [sum(len(p) for _, p in got[:i]) for i in range(len(got))]
        assert all(len(part) == 1 or sum(len(t or b"") for t in part) <= most for _, part in got)
    assert list(text_pieces(pa.array([], pa.binary()))) == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)
