"""Sources, sinks, labelling and evaluation on small data."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import evaluation, labelling
from graphloom.operators.graph import build_edges, number_components
from graphloom.sources import readers, sinks
from graphloom.streaming.incremental import run_on_new_files


def test_read_resume_and_dead_letters(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"qid":"a","answer":"f_answers([\\"x\\"])"}\n{"qid":"b","answer":"y"}\n')
    rows = readers.jsonl(spark, str(tmp_path / "in.jsonl"), schemas.ANSWER)
    assert [r.qid for r in sinks.still_to_do(rows, rows.where("qid = 'a'"), "qid").collect()] == ["b"]
    done = rows.withColumn("error", F.when(F.col("qid") == "b", "bad"))
    summary = sinks.split_failed(done, str(tmp_path / "ok"), str(tmp_path / "failed")).first()
    assert tuple(summary) == (2, 1, 1) and spark.read.parquet(str(tmp_path / "failed")).count() == 1
    sinks.write_new(rows, str(tmp_path / "new"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(rows, str(tmp_path / "new"))


def test_pages_to_edges(spark, tmp_path):
    for i, links in enumerate([["p1"], [], ["p0", "none"]]):
        page = {"title": f"p{i}", "comp_data": [{"type": "paragraph", "heading_path": [], "edge": links, "paragraph": "x"}, {"type": "table", "table": [["a"]], "edge": []}]}
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    comps = number_components(readers.parsed_pages(spark, str(tmp_path))).withColumnRenamed("edge", "neighbor_titles")
    assert [(r.component_id, r.doc_title) for r in comps.orderBy("component_id").collect()] == [(i, f"p{i // 2}") for i in range(6)]
    edges = {tuple(r) for r in build_edges(comps).collect()}
    assert edges == {(a, b) for d in (0, 2, 4) for a in (d, d + 1) for b in (d, d + 1)} | {(0, 2), (0, 3), (4, 0), (4, 1)}


def test_token_recall_counts_repeats(spark):
    ref = spark.createDataFrame([(1, "a a b c"), (2, "zzz"), (3, "")], "ref_id long, value string")
    cand = spark.createDataFrame([(5, "a b"), (6, "a a"), (7, "a a a c")], "cand_id long, value string")
    best = {r.ref_id: (r.cand_id, r.score) for r in labelling.best_match(ref, cand).collect()}
    assert best == {1: (7, 0.75), 2: (5, 0.0), 3: (5, 0.0)}


def test_best_matches_by_bounds_are_those_of_all_pairs(spark):
    import random

    rnd = random.Random(12)
    words = [f"w{min(int(rnd.expovariate(0.05)), 99)}" for _ in range(9000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    cands = [(i, text(rnd.randint(0, 60)), i % 2) for i in range(250)]
    refs = [(r, text(rnd.randint(0, 12)), r % 3) for r in range(40)]
    refs += [(100 + r, " ".join(cands[5 * r][1].split()[:15]), cands[5 * r][2]) for r in range(20)]
    ref, cand = spark.createDataFrame(refs, "ref_id long, value string, part long"), spark.createDataFrame(cands, "cand_id long, value string, part long")
    full = labelling.token_recall(ref, cand).orderBy("ref_id", F.desc("score"), "cand_id").collect()
    want = {r: (0, 0.0) for r, _, _ in refs}
    for row in reversed(full):
        want[row.ref_id] = (row.cand_id, row.score)
    assert {r.ref_id: (r.cand_id, r.score) for r in labelling.best_match(ref, cand).collect()} == want
    within = labelling.token_recall(ref, cand, ["part"]).orderBy("ref_id", F.desc("score"), "cand_id").collect()
    want = {r: (p, 0.0) for r, _, p in refs if p < 2}
    for row in reversed(within):
        want[row.ref_id] = (row.cand_id, row.score)
    assert {r.ref_id: (r.cand_id, r.score) for r in labelling.best_match_within(ref, cand, ["part"]).collect()} == want
    copied = ref.where("ref_id >= 100")
    met, every = labelling.bounded_pairs(copied, cand).met.count(), labelling.token_recall(copied, cand).count()
    assert met < every / 4
    none = labelling.best_match(ref.where("false"), cand).collect() + labelling.best_match_within(ref, cand.where("false"), ["part"]).collect()
    assert none == []


def test_metrics(spark):
    lists = spark.createDataFrame([([1, 2], [3, 2, 1]), ([4], [1]), ([], [1])], "gold array<int>, found array<int>")
    r = evaluation.match_rates(lists).first()
    assert (r.n, r.exists_n, r.perfect_n) == (3, 1, 2)
    assert evaluation.mean_reciprocal_rank(lists).first().mrr == pytest.approx(0.5 / 3)
    assert evaluation.match_rates(lists.where("false")).first().exists_rate is None
    answers = spark.createDataFrame([("a", 'f_answers(["The X", "y"])'), ("b", "z"), ("c", "q")], "qid string, answer string")
    truth = spark.createDataFrame([("a", ["x"]), ("b", ["Z!"]), ("c", [])], "qid string, answers array<string>")
    r = evaluation.em_f1(answers, truth).first()
    assert (r.n, r.em, r.f1) == (2, 50.0, pytest.approx((2 / 3 + 1) / 2 * 100))
    with pytest.raises(KeyError):
        evaluation.require_all(answers, truth.where("qid = 'a'"))
    with pytest.raises(Exception, match="no truth for qid [bc]"):
        evaluation.em_f1(answers, truth.where("qid = 'a'")).collect()
    found, gold = spark.createDataFrame([("a", ["u"]), ("b", ["v"])], "qid string, found array<string>"), spark.createDataFrame([("a", ["u", "w"])], "qid string, gold array<string>")
    assert evaluation.match_rates(evaluation.strict_join(found.where("qid = 'a'"), gold)).first().exists_n == 1
    for measure in (evaluation.match_rates, evaluation.mean_reciprocal_rank):
        with pytest.raises(Exception, match="no truth for qid b"):
            measure(evaluation.strict_join(found, gold)).collect()


def test_dense_baseline(spark):
    comps = spark.createDataFrame([(1, [1.0, 0.0], ["u"]), (2, [0.9, 0.0], ["v", "u"]), (3, [0.0, 1.0], None), (4, [0.0, 0.5], [])], "component_id long, embedding array<double>, uuids array<string>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "qid string, embedding array<double>")
    gold = spark.createDataFrame([("a", ["v"]), ("b", ["u"]), ("c", [])], "qid string, gold array<string>")
    got = {r.qid: (r.gold, r.found) for r in evaluation.dense_baseline(asked, comps, gold, 2).collect()}
    assert got == {"a": (["v"], ["u", "v"]), "b": (["u"], []), "c": ([], [])}
    rates = evaluation.match_rates(evaluation.dense_baseline(asked, comps, gold, 2)).first()
    assert (rates.n, rates.exists_n, rates.perfect_n) == (3, 1, 2)
    with pytest.raises(Exception, match="no truth for qid c"):
        evaluation.dense_baseline(asked, comps, gold.where("qid <> 'c'"), 2).collect()


def test_incremental_runs_count_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"qid": str(i), "answer": "x"}) + "\n")
        run_on_new_files(spark, str(tmp_path / "in"), schemas.ANSWER, lambda d: d.select("qid"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.qid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1"]
