"""Fill-in-middle against a plain version, and the round trip from output and form to the text."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from reasonmill.llm import fim
from reasonmill.llm.blocks import bound_batches

SCHEMA = "doc_id long, text string, n int, form string, output int, _id string"


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pieces = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = pieces
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts_equal_the_plain_version(spark):
    bound_batches(spark)
    texts = [
        None, "", " ", "a", "日本 語\U0001f600x", "line\r\nline\n\n", "a<P>b", "x <M", "<", "<S", "<S<P<M", " and ", "é ß\x00",
        "word, " * 60_000, "z" * 300_000, "。" * 100_000, "same", "same",
    ]
    rows = [(n, t) for n in range(0, 400, len(texts)) for n, t in enumerate(texts, n)] + [(None, "no id"), (-5, "minus id")]
    df = spark.createDataFrame([(*r, 1, "f", 2, "i") for r in rows], SCHEMA).repartition(3)
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.withColumn("back", fim.restored()).collect()
    assert all(r.back == r.text for r in back)
    got = sorted(((r.doc_id is None, r.doc_id, tuple(r)[2:7]) for r in back), key=repr)
    assert got == sorted(((i is None, i, plain(i, t)) for i, t in rows), key=repr)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_empty_table_and_rates(spark):
    df = spark.createDataFrame([(n, f"text number {n}") for n in range(50)], "doc_id long, text string")
    assert fim.digests(fim.transform(df.limit(0))).count() == 0
    assert fim.transform(df, fim.Rates(plain=100)).where("form <> 'plain' or output <> text").count() == 0
    assert fim.transform(df, fim.Rates(plain=0, spm=100)).where(F.col("form") != "spm").count() == 0
