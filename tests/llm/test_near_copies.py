"""One row of each group of near copies; groups around an original; shared prefix shingles over borders of partitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reasonmill.llm import jaccard
from reasonmill.llm.blocks import bound_batches
from reasonmill.session import ship_package


@pytest.fixture(autouse=True)
def ready(spark):
    ship_package(spark)
    bound_batches(spark)


def text(seed, n=40):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 99999, n))


def test_one_row_of_each_group(spark):
    rows = [
        (5, text(1), "a"), (5, text(1), "b"), (5, text(2), "c"),  # repeated id: one row of each text
        (None, text(1), "d"), (None, text(3), "e"), (None, text(3), "f"),  # no id: members like others
        (7, text(2), "g"), (8, "", "h"), (9, None, "i"), (10, "", "j"), (None, None, "k"),  # no shingles: no copies
        (11, text(4), "l"), (12, text(4).upper(), "m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _times string")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    expected = [(5, text(1)), (5, text(2)), (None, text(3)), (8, ""), (9, None), (10, ""), (None, None), (11, text(4))]
    assert sorted(kept, key=str) == sorted(expected, key=str)
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_copies_around_an_original_meet_it_and_not_each_other(spark):
    words = text(5, 200).split()
    rng = np.random.default_rng(6)
    rows = [(500, " ".join(words))]
    for n in range(60):  # three changed words: each is near the original, two of them seldom near each other
        changed = list(words)
        for at in rng.choice(200, 3, replace=False):
            changed[at] = f"new{n}x{at}"
        rows.append((n, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rooted = jaccard.join(docs).collect()
    assert {r.component_id for r in rooted} == {0}
    docs = docs.withColumn("mark", jaccard.mark("doc_id", "text"))
    summaries = jaccard.written(jaccard.classes(docs), "classes")
    links = {(r.a, r.b) for r in jaccard.class_links(docs, summaries).collect()}
    assert 60 <= len(links) < 60 * 4


def test_shared_prefix_shingles_over_batches():
    rng = np.random.default_rng(7)
    for size in (1, 2, 7, 1000):
        rows = sorted((int(t), int(k)) for t, k in rng.integers(0, 60, (150, 2)) // [[1, 30]])
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in part], pa.int64()), pa.array([k for _, k in part], pa.int64()),
                 pa.array([0] * len(part), pa.int32()), pa.array([9] * len(part), pa.int64())],
                names=["token", "key", "pos", "size"])
            for part in (rows[n:n + size] for n in range(0, len(rows), size))
        ]
        out = [p for b in jaccard._shared(iter(batches)) for p in zip(b["token"].to_pylist(), b["key"].to_pylist(), strict=True)]
        keys = {t: {k for u, k in rows if u == t} for t, _ in rows}
        border = {rows[0][0], rows[-1][0]}
        assert out == sorted({(t, k) for t, k in rows if len(keys[t]) > 1 or t in border})
