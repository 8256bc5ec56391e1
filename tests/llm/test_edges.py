"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, in operators and stages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reasonmill.llm import decontaminate, jaccard, langid, licenses, line_dedup, lm_score, packing, quality, repeats
from reasonmill.llm.blocks import bound_batches
from reasonmill.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int, key long, k string"


@pytest.fixture(scope="module")
def odd(spark):
    bound_batches(spark)
    long = " ".join(f"word{n % 700}" for n in range(40_000))
    rows = [
        (1, "some words of a text that is long enough to have shingles", "en", "s", 57, 1.0, 1, 1, "k"),
        (1, "some words of a text that is long enough to have shingles", "en", "s", 57, 1.0, 1, 1, "k"),
        (2, None, None, None, None, None, None, None, None), (3, "", "", "", 0, 0.0, 0, 0, ""), (4, " \n\t ", "en", None, 4, None, 1, 1, "x"),
        (None, "a text without an id", "en", "s", 20, None, None, None, None), (5, long, "en", "s", len(long), None, None, None, None),
        (6, "\x00\x01 ünï 日本 \U0001f600", "de", "s", 9, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (5, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_odd_rows(spark, odd, labels):
    bench = spark.createDataFrame([(None, "words of a text that is long"), (1, None), (2, "")], "item_id long, text string")
    n = odd.count()
    assert quality.select(odd, labels).columns == [*odd.columns, "expected_grade", "p_top"]
    model = langid.fit(odd)
    assert langid.identify(odd, model).count() == n
    assert {r.lang_pred for r in langid.identify(odd, model).where("doc_id in (2, 3, 4)").collect()} == {"und"}
    assert packing.pack(odd).groupBy("doc_id").agg(F.max("piece")).count() == 7
    assert lm_score.score(odd, lm_score.fit(odd, labels)).count() == n
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(odd, bench).collect()} == {(1, None)}
    both = spark.createDataFrame([(None, "words of a text that is long"), (-1, "words of a text that is long")], bench.schema)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(odd, both).collect()} == {(1, None), (1, -1)}
    assert decontaminate.clean(odd, bench).columns == odd.columns
    joined = jaccard.join(odd).collect()
    assert len(joined) == n and {r.component_id for r in joined if r.doc_id == 1} == {1}
    assert repeats.remove_repeats(odd).count() == n
    assert line_dedup.dedup_lines(odd).columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert licenses.scan(odd, licenses.fit(odd, background=5)).count() == 0


def test_every_stage_takes_odd_rows_and_keeps_the_columns(spark, odd, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns, name
        assert out.where("doc_id is null or doc_id in (2, 3)").count() == 3, name
        assert stage(spark, odd.select(columns).limit(0), FOLDER).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), FOLDER).count() == 0


def test_lines_of_other_scripts_beside_a_notice(spark):
    foreign = "\n".join(["слова без латиницы"] * 20 + ["λέξεις χωρίς", "文字 だけ", ""])
    docs = spark.createDataFrame([(1, foreign + "Released under the MIT License."), (2, foreign), (3, "MIT License\n\n" + foreign)], "doc_id long, text string")
    assert {r.doc_id for r in licenses.scan(docs, licenses.fit(docs, background=5)).collect()} <= {1, 3}


def test_helper_columns_of_the_input_are_kept(spark):
    rows = [(n, "a\nb\nc\nd" if n < 3 else f"own {n}\nb\nx{n}", n, "t", [n], True, "k") for n in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _TEXT string, _gone array<long>, _kept boolean, _bucket string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {(r.doc_id, r._id, r._TEXT, r.n_removed) for r in out.collect()} == {(n, n, "t", 4 if n in (1, 2) else 0) for n in range(6)}
    with_columns = docs.withColumn("n_chars", F.length("text").cast("long"))
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.keep_one_copy):
        assert stage(spark, with_columns, FOLDER).columns == with_columns.columns


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    assert jaccard.join(none).count() == repeats.remove_repeats(none).count() == line_dedup.dedup_lines(none).count() == 0
    assert lm_score.score(odd, lm_score.fit(none, labels.limit(0))).count() == odd.count()
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}
    assert licenses.scan(none, licenses.fit(none, background=5)).count() == 0


def test_pipeline_drops_copies_and_packs_the_rest(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    packed = corpus_pipeline.run(spark, FOLDER)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert kept < set(rows) and len(kept) > 0.6 * len(rows)  # a quarter of all rated documents is toxic or poor
    texts = [rows[n] for n in kept if len(rows[n]) > 60]
    assert len(set(texts)) == len(texts)


def test_all_queries():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_every_rated_document_calibrates_whatever_their_number(monkeypatch):
    """Up to 4,000 ratings all documents took part in the calibration, beyond that one in five."""
    judged = []
    monkeypatch.setattr(quality, "fit_arrays", lambda rows: quality.Model(np.zeros(quality.BUCKETS), np.zeros(quality.DENSE), np.array([-4.0, -2.0])))
    monkeypatch.setattr(quality, "threshold", lambda p, grade: judged.append((len(p), len(grade))) or 0.5)
    for n in (3, 3_999, 4_001, 12_000):
        quality.fit_and_calibrate([(np.array([i % 7]), np.zeros(quality.DENSE), i % 3) for i in range(n)])
        assert judged.pop() == (n, n)
