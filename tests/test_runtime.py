import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from sigwright import runtime
from sigwright.operators.ranges import prefix_sums

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_session_leaves_nothing(tmp_path):
    code = """
import sys
from sigwright.runtime import Cut, session
spark = session("local[1]", partitions=1, **({"spark__checkpoint__dir": sys.argv[1]} if sys.argv[1:] else {}))
left = Cut(spark.range(3).toDF("x"), "left")
assert left.df.count() == 3
gone = Cut(left.df, "gone")
gone.drop()
print(left.path)
"""
    for shared in ([], [str(tmp_path / "shared")]):
        done = subprocess.run([sys.executable, "-c", code, *shared], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
        path = done.stdout.strip().splitlines()[-1]
        assert path.startswith(shared[0] if shared else "/tmp/checkpoints/") and not os.path.exists(path)
        assert not shared or not [x for x in os.listdir(shared[0]) if x.startswith(("left", "gone"))]


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Elsewhere)


def test_measures_are_taken_while_writing(spark, caplog):
    with caplog.at_level("INFO", "sigwright"):
        assert runtime.cut(spark.range(5).toDF("x"), "measured", n=F.count("*"), top=F.max("x")).count() == 5
    assert "'n': 5" in caplog.text and "'top': 4" in caplog.text


@pytest.mark.parametrize("n", [0, 1, 50])
def test_prefix_sums(spark, n):
    rows = spark.createDataFrame([(i * 37 % 50, i % 3) for i in range(n)], "x long, v long").repartition(3)
    got = prefix_sums(rows, [F.col("v").desc(), F.col("x")], {"before": F.col("x"), "place": F.lit(1)}).collect()
    order = sorted(((i * 37 % 50, i % 3) for i in range(n)), key=lambda r: (-r[1], r[0]))
    assert sorted((r.place, r.x, r.v, r.before) for r in got) == [(i, x, v, sum(y for y, _ in order[:i])) for i, (x, v) in enumerate(order)]


def test_an_owner_removes_what_was_cut_inside(spark):
    before = runtime.Cut(spark.range(2), "outside")
    with runtime.Owner() as outer:
        one = runtime.Cut(spark.range(3), "inside")
        with runtime.Owner():
            two = runtime.cut(spark.range(4), "deeper")
            assert two.count() == 4
        assert one.df.count() == 3 and len(outer.cuts) == 1
    assert before.df.count() == 2
    for gone in (one.df, two):
        with pytest.raises(Exception, match="(?i)exist|not found"):
            gone.collect()


def test_an_owner_hands_on_what_it_keeps(spark):
    with runtime.Owner() as outer:
        with runtime.Owner() as owner:
            kept, gone = owner.keep(runtime.Cut(spark.range(3), "kept")), runtime.Cut(spark.range(4), "gone")
        assert kept.df.count() == 3 and outer.cuts == [kept]
        with pytest.raises(Exception, match="(?i)exist|not found"):
            gone.df.collect()
    with pytest.raises(Exception, match="(?i)exist|not found"):
        kept.df.collect()


def test_what_is_old_is_swept(spark):
    from pathlib import Path

    kept = runtime.Cut(spark.range(2), "young")
    folder = Path(runtime.shared_dir(spark))
    old = folder / ("crashed-20200101-" + "a" * 32)
    old.mkdir()
    (folder / "mine").mkdir(exist_ok=True)
    assert runtime.sweep(spark, 7) == 1 and not old.exists() and (folder / "mine").exists()
    assert kept.df.count() == 2


def test_streams_are_logged(spark, tmp_path, caplog):
    from sigwright.streaming.counts import CountJob

    spark.createDataFrame([("ATCGATCG",), ("TTTT",)], "seq string").write.parquet(str(tmp_path / "in"))
    listener = runtime.watch(spark)
    try:
        with caplog.at_level("INFO", logger="sigwright"):
            job = CountJob(spark.readStream.schema("seq string").parquet(str(tmp_path / "in")), spark.createDataFrame([("g", "ATCG")], "gid string, key string"), 4)
            job.finish()
            for _ in range(50):
                if any("'hits': 3" in m for m in caplog.messages):
                    break
                time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert any("'kmers': 6" in m and "'hits': 3" in m for m in caplog.messages)
