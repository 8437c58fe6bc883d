"""The stages on a small corpus, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from graphloom.llm.common import keep_rows
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.toxicity import without_toxic

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = after.collect()
        kept = {r.doc_id: r.text for r in rows}
        assert len(kept) == len(rows) and all(before[i] == t for i, t in kept.items())
        if name == "exact_dedup":
            assert sorted(map(str, kept.values())) == sorted(set(map(str, before.values())))
        assert len(kept) >= 0.7 * len(before)
        docs, before = spark.createDataFrame(rows, docs.schema), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_run_matches_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_row_given_twice_stays_once(spark):
    rows = [(1, "a", None), (1, "a", None), (2, "a", "x"), (None, "b", None), (None, "b", None), (3, None, "y"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __keep_sha string")
    kept = keep_rows(docs.drop("__keep_sha"), exact_dedup(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(2, "a"), (None, "b"), (4, "")])


def test_near_stage_keeps_unrelated_rows_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (6, text(3)), (6, text(4)), (None, text(5)), (7, text(5).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([*rows[:5], rows[6]])


def test_stages_on_odd_rows_and_empty_tables(spark):
    long = " ".join(f"v{i}" for i in range(20000))
    rows = [(None, None, 1, True), (1, "", 2, None), (None, "a", 3, False), (2, "a", 4, True), (2, "b c", 5, True), (2, "b c", 5, True), (3, long, 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _root int, kept boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        kept = Counter(map(tuple, after.collect()))
        assert not kept - Counter(rows) and (3, long, 6, None) in kept, name
        if name in ("toxicity", "decontamination"):
            assert kept == Counter(rows)
        elif name == "exact_dedup":
            assert Counter((r[0], r[1]) for r in kept) == Counter([(1, ""), (2, "a"), (2, "b c"), (3, long)])
        none = stage(spark, docs.where("false"), SF)
        assert none.collect() == [] and none.columns == docs.columns, name
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs.where("false"), SF).collect() == []
    assert Counter(r.doc_id for r in packed(spark, docs, SF).where("piece = 0").collect()) == Counter(r[0] for r in rows)


def test_without_labels_no_document_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("false")
    assert without_toxic(docs, labels).count() == 2
