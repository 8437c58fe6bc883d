"""Stored tables: nothing is lost without a word, runs are whole, dead letters are those of the last try."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom import pipelines, tables
from graphloom.operators.graph import build_adjacency
from graphloom.sources import sinks, stored


def parts(folder):
    return sorted(p for p in Path(folder).rglob("part-*.parquet"))


def spoil(file):
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(b"not a table")


@pytest.fixture
def graph(spark, tmp_path):
    comps = spark.range(100, numPartitions=4).select(F.col("id").alias("component_id"), F.array(F.lit(1.0)).alias("embedding"), F.array(F.array(F.lit(1.0))).alias("vectors"))
    titled = comps.select("*", F.concat(F.lit("D"), F.col("component_id") % 9).alias("doc_title"), F.array(F.lit("D1"), F.lit("none")).alias("neighbor_titles"))
    stored.save_graph(titled, build_adjacency(titled), f"{tmp_path}/g", buckets=4)
    return f"{tmp_path}/g"


def test_a_spoilt_graph_is_not_loaded(spark, graph):
    assert stored.load_graph(spark, graph).components.count() == 100
    spoil(parts(f"{graph}/components")[0])
    with pytest.raises(Exception, match="(?i)parquet|part-"):
        stored.load_graph(spark, graph).components.count()


def test_hops_join_the_graph_as_it_lies(spark, graph):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    g = stored.load_graph(spark, graph)
    beam = spark.range(0, 100, 7).select(F.lit(1).alias("qid"), F.col("id").alias("component_id"))
    reached = g.adjacency.reached(beam)
    got = {(r.component_id, r.b) for r in reached.collect()}
    assert got == {(a, b) for a in range(0, 100, 7) for b in range(100) if a % 9 == b % 9 or b % 9 == 1}
    lines = reached._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert len(scans) == 4
    depth = [len(re.match(r"[ :+|-]*", line)[0]) for line in lines]
    for i in scans:  # from each scan up to the join
        while "Join" not in lines[i]:
            assert "Exchange" not in lines[i], lines[i]
            i = max(j for j in range(i) if depth[j] < depth[i])
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(FileExistsError):
        stored.save(spark.range(3), f"{graph}/subs", "id", 4)


def test_a_graph_without_all_files_is_not_loaded(spark, graph):
    os.remove(parts(f"{graph}/subs")[1])
    with pytest.raises(stored.IncompleteTable, match="subs"):
        stored.load_graph(spark, graph)


def test_a_file_with_fewer_rows_is_noticed(spark, graph):
    file = parts(f"{graph}/links")[0]
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    spark.range(1).select(F.col("id").alias("component_id"), F.lit("D1").alias("key")).coalesce(1).write.parquet(f"{graph}/other")
    file.write_bytes(parts(f"{graph}/other")[0].read_bytes())
    with pytest.raises(stored.IncompleteTable, match="links: part"):
        stored.load_graph(spark, graph)


def test_unreadable_documents_are_rows(spark, tmp_path):
    rows = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("doc_title"))
    sinks.append(rows, f"{tmp_path}/documents", run="a")
    good, bad = stored.load_readable(spark, f"{tmp_path}/documents")
    assert good.count() == 100 and bad.collect() == [] and good.columns == ["doc_title"]
    files = parts(f"{tmp_path}/documents")
    spoil(files[0])
    os.remove(files[1])
    good, bad = stored.load_readable(spark, f"{tmp_path}/documents")
    assert good.count() == 50 and {r.name for r in bad.collect()} == {f.name for f in files[:2]}
    assert {r.error for r in bad.collect()} == {"rows read: 0 of 25"}
    got, failed = pipelines._documents(spark, f"{tmp_path}/nothing")
    assert got.count() == failed.count() == 0


def test_a_run_is_whole_or_not_there(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.range(10, numPartitions=2)
    assert sinks.append(rows, path, run="one") == 10

    def dies(i):
        if i == 5:
            raise RuntimeError("killed")
        return i

    broken = spark.range(10, 20, numPartitions=2).select(F.udf(lambda i: dies(i - 10), "long")("id").alias("id"))
    with pytest.raises(Exception, match="killed"):
        sinks.append(broken, path, run="two")
    assert stored.load(spark, path).count() == 10  # nothing of the run that died
    for _ in range(2):  # repeated, it replaces itself
        assert sinks.append(spark.range(10, 20), path, run="two") == 10
    assert sorted(r.id for r in stored.load(spark, path, counted=True).collect()) == list(range(20))
    assert sinks.append(rows.where("false"), path, run="three") == 0 and stored.load(spark, path).count() == 20


def test_dead_letters_are_those_of_the_last_try(spark, tmp_path):
    ok, bad = f"{tmp_path}/ok", f"{tmp_path}/bad"
    first = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "k string, v int, error string")
    assert tuple(sinks.split_failed(first, ok, bad, key="k").first()) == (3, 1, 2)
    again = spark.createDataFrame([("b", 2, None), ("d", 4, "z")], "k string, v int, error string")
    assert tuple(sinks.split_failed(again, ok, bad, key="k").first()) == (2, 1, 1)
    assert sorted(r.k for r in stored.load(spark, ok).collect()) == ["a", "b"]
    assert sorted((r.k, r.error) for r in stored.load(spark, bad).collect()) == [("c", "y"), ("d", "z")]


def test_intermediate_tables_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session)
