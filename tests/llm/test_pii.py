"""Personal data against plain counterparts: certain spans by Python's expressions, posteriors by a plain loop."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reasonmill.llm import pii
from reasonmill.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    spans = [(m.start(), n, m.end(), k) for n, (k, r) in enumerate(RULES.items()) for m in re.finditer(r, text or "") if passes(k, m.group())]
    counts = Counter(s[3] for s in spans)
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return (*[counts[k] for k in RULES], hashlib.sha256(listed.encode()).hexdigest())


def test_query_equals_plain_patterns_on_whole_texts(spark):
    got = {r.doc_id: r for r in queries()["op12_personal_data"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert {r.doc_id: plain(r.text) for r in docs} == {k: tuple(r)[1:6] for k, r in got.items()}


ODD = [
    None, "", "@@@ a@b a@b.c a@b.c.d_@e.f x@y.z@w.v .@-.-", "1.2.3.4.5.6.7.8 999.1.2.3.4 0255.0.0.1 1.2.3 256.1.1.1.1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "4111111111111111 4111111111111111", "12 34 56 78 90 12 34",
    "+1 (017) 555-7713 +49 30 1234567890123456 +4 5+49 (0) 30 123-456. +33.1.23.45.67.89", "日本 \U0001f600 a@b.cd é+1 212 555 0100\n4111 1111 1111 1111",
    "1" * 50_000, "1 " * 30_000, "a" * 50_000 + "@b.c", "a.b-" * 20_000, "a@b.c " * 3_000, "1.1.1.1." * 4_000, "+1" + " " * 40_000 + "x",
    "+1" + "2" * 30_000 + " ", "a@" + "b." * 20_000 + "c",
]


def test_odd_and_very_long_texts(spark):
    df = spark.createDataFrame([(n, t, 1, "s") for n, t in enumerate(ODD)] + [(None, ODD[7], 1, "s")] * 2, "doc_id long, text string, spans int, _id string")
    got = pii.digests(pii.detect(df.repartition(4))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted([(n, *plain(t)) for n, t in enumerate(ODD)] + [(None, *plain(ODD[7]))] * 2, key=repr)
    assert pii.digests(pii.detect(df.limit(0))).count() == 0
    assert [r.spans for r in pii.digests(pii.detect(df.where("doc_id < 2"))).collect()] == ["", ""]


def test_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["@", ".", "a", "b", "-", "_", " ", "1", "2", "77", "+", "(", ")", "é"]) for _ in range(400)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(pii.decided(pii.candidates(df), pii.Classifier(0.0, [0.0] * pii.FEATURES))).collect()}
    assert {n: plain(t) for n, t in enumerate(texts)} == {n: tuple(r)[1:6] for n, r in got.items()}


def plain_rounds(seen, rounds):
    """Expectation-maximisation over {cells: n}, cell by cell."""
    share = {c: 1 / (1 + math.exp(-sum(x % 3 - 1 for x in c))) for c in seen}
    n_labelers = len(pii.LABELERS)
    for _ in range(rounds):
        yes, no = defaultdict(float), defaultdict(float)
        for cells, n in seen.items():
            for c in cells:
                yes[c] += n * share[cells]
                no[c] += n * (1 - share[cells])
        for cells in seen:
            first = cells[0] // (3 * n_labelers) * 3 * n_labelers
            all_yes, all_no = sum(yes[first + v] for v in range(3)), sum(no[first + v] for v in range(3))
            odds = math.log((all_yes + 2) / (all_no + 2))
            for c in cells:
                odds += math.log((yes[c] + 1 + c % 3) / (all_yes + 6)) - math.log((no[c] + 3 - c % 3) / (all_no + 6))
            share[cells] = 1 / (1 + math.exp(-odds))
    return share


def test_posteriors_equal_a_plain_loop(spark):
    rng, n = random.Random(3), len(pii.LABELERS)
    seen = {}
    for _ in range(60):
        kind, good = rng.randrange(len(pii.KINDS)), rng.random() < 0.5
        votes = [rng.choice((0, 1, 1, 2) if rng.random() < 0.3 else ((2,) if good else (0,))) for _ in range(n)]
        cells = tuple(kind * n * 3 + k * 3 + v for k, v in enumerate(votes))
        seen[cells] = seen.get(cells, 0) + rng.randrange(1, 90)
    table = spark.createDataFrame([(list(c), k) for c, k in seen.items()], "cells array<int>, n long")
    got = {tuple(r.cells): r.p for r in pii.posteriors(table, 10).collect()}
    want = plain_rounds(seen, 10)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


TEXTS = {
    "secret": "my token = \"{}\" here", "phone": "call me: ({:03d}) 555-0199 today", "email": "write to joe{} at mail{} dot com please",
    "name": "signed by Herr Karl Weber{} yours",
}


def test_added_spans_are_the_planted_ones(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for n in range(240):
        kind = ("secret", "phone", None, "card")[n % 4]
        if kind == "secret":
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            text = f"some words token = \"{value}\" and more"
            want[n] = f"secret:{text.index(value)}:{text.index(value) + 40}"
        elif kind == "phone":
            value = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
            text = f"please call {value} soon"
            want[n] = f"phone:{text.index(value)}:{text.index(value) + len(value)}"
        elif kind == "card":
            text, want[n] = f"order {rng.randrange(10**9, 10**10)}x checksum", ""
        else:
            text, want[n] = "clean words and 12.5 percent of 2024-05-06 at home", ""
        rows.append((n, text))
    got = {r.doc_id: r.spans for r in pii.digests(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == want


@pytest.mark.parametrize(("text", "ok"), [("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765432", True), ("DE89 3704 0044 0532 0130 01", False)])
def test_account_numbers(spark, text, ok):
    assert spark.range(1).select(pii.iban_check(F.lit(text))).first()[0] is ok


def test_sums_in_blocks(spark):
    values = [n * 7 % 13 for n in range(1000)]
    got = spark.createDataFrame([(values,)], "v array<long>").select(pii.running(F.col("v"))).first()[0]
    assert got == [sum(values[:n + 1]) for n in range(1000)]
