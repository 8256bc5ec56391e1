"""The operators on small inputs: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonmill.llm import (
    decontaminate, jaccard, langid, licenses, line_dedup, lm_score, neighbours, packing, quality, repeats,
)
from reasonmill.llm.blocks import bound_batches
from reasonmill.llm.tables import components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    bound_batches(spark)
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- near copies -------------------------------------------------------------------------------------------


def shingle_set(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[n:n + 5]) for n in range(len(words) - 4))


def linked_components(sets, similarity=80):
    shared, parent = Counter(), {n: n for n in sets}
    where = defaultdict(list)
    for n in sorted(sets):
        for shingle in sets[n]:
            where[shingle].append(n)
    for members in where.values():
        shared.update((a, b) for k, a in enumerate(members) for b in members[k + 1:])

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for (a, b), both in shared.items():
        if 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {n: (len(sets[n]), root(n)) for n in sets}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}


def test_jaccard_join_equals_brute_force(docs, texts):
    assert joined(docs) == linked_components({n: shingle_set(t) for n, t in texts.items()})


def test_jaccard_join_finds_chains_and_links_just_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in rng.integers(0, 9999, 60)]
    rows, current = [], list(words)
    for n in range(14):  # each one is near the one before; the ends of the chain are not near each other
        rows.append((n, " ".join(current)))
        current = list(current)
        current[(n * 4) % 60] = f"x{n}"
    rows += [(100 + n, " ".join(words[n:])) for n in range(20)]
    expected = linked_components({n: shingle_set(t) for n, t in rows})
    assert len({v[1] for v in expected.values()}) < len(rows)
    assert joined(frame(spark, rows)) == expected


def test_bitmap_bound_is_never_below_the_intersection():
    rng = np.random.default_rng(1)
    for _ in range(100):
        pool = rng.integers(0, 1 << 63, 600).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in range(2))
        most = jaccard.bound(jaccard._bitmap(a), jaccard._bitmap(b), len(a), len(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_components_of_chains_and_stars(spark):
    chain = [(n, n + 1) for n in range(40)]
    star = [(100, n) for n in range(101, 140)]
    df = spark.createDataFrame(chain + star, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    assert roots == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 140)}}


# ---- repeated strings --------------------------------------------------------------------------------------


def cut(rows, length=repeats.LENGTH):
    seen = Counter(b[i:i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for doc, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check_cut(spark, rows):
    got = sorted((tuple(r) for r in repeats.remove_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == cut([(n, (t or "").encode()) for n, t in rows])


def test_removed_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    alphabet = [f"{a}{b}é " for a in "abcde" for b in "xyz"]
    prose = lambda n: "".join(rng.choice(alphabet, n))
    passage, short = prose(90), prose(45)
    rows = [(n, prose(60) + passage + prose(int(rng.integers(0, 80)))) for n in range(5)]
    rows += [(10, short + "q" + prose(99)), (11, prose(80) + short), (12, "a" * 450), (13, "ab " * 150), (14, "a" * 199)]
    rows += [(20, None), (21, ""), (22, rows[0][1]), (22, rows[0][1]), (23, rows[1][1][:-1] + "!"), (None, prose(100))]
    check_cut(spark, rows)


# ---- lines -------------------------------------------------------------------------------------------------


def test_later_line_windows_go_and_positions_merge(spark):
    rows = [(1, "a\nb\nc\nd\nx"), (2, "y\na\nb\nc\nd\nz"), (3, "a\nb"), (4, None), (5, ""), (6, "b\nc\nd"), (6, "b\nc\nd"), (7, "q\nq\nq\nq\nq")]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect() if r.text is not None)
    assert got == [
        (1, "a\nb\nc\nd\nx", 5, 0), (2, "y\nz", 6, 4), (3, "a\nb", 2, 0), (5, "", 1, 0), (6, "", 3, 3), (6, "", 3, 3),
        (7, "q", 5, 4),
    ]


# ---- packing -----------------------------------------------------------------------------------------------


def test_packing_is_gapless_within_capacity_and_keeps_every_id(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids) and all(r.length == packing.CAPACITY for r in parts[1:])
        for r in parts:
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_holds_every_constraint(rule):
    limits = packing.Limits(tokens=100, documents=4, attention=6000, rule=rule)
    histogram = {n: (n * 7) % 13 for n in range(1, 78)}
    histogram = {n: c for n, c in histogram.items() if c}
    bins, ranks = defaultdict(list), defaultdict(set)
    for length, low, high, first, _ in packing.plan(histogram, limits):
        for rank in range(low, high):
            assert rank not in ranks[length]
            ranks[length].add(rank)
            bins[first + rank - low].append(length)
    assert {n: len(r) for n, r in ranks.items()} == histogram
    for inside in bins.values():
        assert sum(inside) <= 100 and len(inside) <= 4 and sum(n * n for n in inside) <= 6000
    with pytest.raises(ValueError):
        packing.plan({90: 1}, limits)


# ---- neighbours --------------------------------------------------------------------------------------------


def test_neighbours_reach_recall_and_measure_exactly(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids, x = np.array(list(rows)), np.array(list(rows.values()))
    found = defaultdict(list)
    for r in neighbours.search(df).collect():
        found[r.query_id].append(r)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - rows[q]) ** 2).sum(axis=1))
        best = [n for n in np.lexsort((ids, d)) if ids[n] != q][:10]
        got = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(abs(r.score - np.sqrt(((rows[r.vec_id] - rows[q]) ** 2).sum())) < 1e-12 for r in got)
        hits, total = hits + len({ids[n] for n in best} & {r.vec_id for r in got}), total + 10
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert got[0][3] == 0.0 and abs(got[2][3] - 5**0.5) < 1e-12
    assert neighbours.search(df.limit(0)).collect() == []


# ---- decontamination ---------------------------------------------------------------------------------------


def test_reordered_passages_are_found(spark):
    item = [f"t{n}" for n in range(40)]
    other = " ".join(f"z{n}" for n in range(30))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    rows = [
        (1, f"{other} {' '.join(item)} {other}"), (2, f"{' '.join(item[20:])}, {other} {' '.join(item[:20])}"),
        (3, other), (4, f"{other} {' '.join(item[:12])}"), (5, None), (6, ""), (7, " ".join(item).upper()),
    ]
    found = {r.doc_id: (r.item_id, r.n_tiles) for r in decontaminate.contamination(frame(spark, rows), bench).collect()}
    assert found == {1: (1, 1), 2: (1, 2), 7: (1, 1)}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.clean(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination(frame(spark, rows), bench.limit(0)).count() == 0


def test_benchmark_in_several_blocks_finds_the_same(spark, docs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = list(decontaminate.item_blocks(bench))
    parts = list(decontaminate.item_blocks(bench, block_bytes=1500))
    assert len(whole) == 1 < len(parts)
    assert sorted(i for p in parts for i in p.ids.tolist()) == sorted(whole[0].ids.tolist())


# ---- classifiers and models --------------------------------------------------------------------------------


def test_licences_are_named_and_prose_is_unknown(spark, docs):
    rows = [(1, "prose\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."),
            (3, "He has a licence to drive."), (4, None), (5, ""), (2, "Licensed under the Apache License, Version 2.0.")]
    found = licenses.scan(frame(spark, rows), licenses.fit(docs, background=100))
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found.collect()) == [
        (1, 1, "mit"), (2, 0, "apache-2.0"), (2, 0, "apache-2.0")]


def test_wrapped_licences_and_headings_are_found(spark, docs):
    mit = """# Copyright (c) 2020 Somebody
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
    gpl = """/* prose about the program stands before it
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */"""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    long = "\n".join(["many other words of prose stand here"] * 30)
    rows = [(1, mit), (2, gpl.format(3)), (3, gpl.format(2)), (4, bsd), (5, f"{long}\n{bsd}\n{long}"),
            (6, "MIT License\n\nmore"), (7, "BSD 3-Clause License"), (8, "GNU General Public License, version 2."),
            (9, "This library is licensed under the GNU Lesser General Public License, version 3."),
            (10, "He asked why the MIT License was read aloud in class."), (11, f"{bsd}\n{long}\n{bsd}")]
    found = licenses.scan(frame(spark, rows), licenses.fit(docs, background=100)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [
        (1, 2, "mit"), (2, 1, "gpl-3.0"), (3, 1, "gpl-2.0"), (4, 0, "bsd-3-clause"), (5, 30, "bsd-3-clause"), (6, 0, "mit"),
        (7, 0, "bsd-3-clause"), (8, 0, "gpl-2.0"), (11, 0, "bsd-3-clause"), (11, 32, "bsd-3-clause")]


def test_quality_separates_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.hash("doc_id"), F.lit(3)) == 0
    model = quality.fit(docs, labels.where(~held))
    assert (np.diff(model.thresholds) > 0).all()
    scored = quality.score(docs, model).join(labels.where(held), "doc_id").collect()
    good = np.array([r.p_top for r in scored if r.quality == 1 and not r.toxic])
    bad = np.array([r.p_top for r in scored if r.toxic or not r.quality])
    assert (good[:, None] > bad[None, :]).mean() > 0.85
    assert (good >= model.least).mean() > 0.9
    assert all(0 <= r.p_top <= r.expected_grade <= 2 for r in scored)


def test_quality_threshold_rejects_toxic_and_poor_and_minds_no_outlier(spark):
    rng = np.random.default_rng(3)
    # A few wrongly rated good texts do not pull the threshold down to the bad ones.
    p = np.concatenate([rng.uniform(0.7, 1, 980), rng.uniform(0, 0.01, 20), rng.uniform(0, 0.3, 300), rng.uniform(0, 0.4, 300)])
    grade = np.repeat([2, 2, 0, 1], [980, 20, 300, 300])
    assert 0.39 < quality.threshold(p, grade) <= 0.71
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.hash("doc_id"), F.lit(3)) == 0
    model = quality.fit(docs, labels.where(~held))
    scored = quality.score(docs.select("doc_id", "text"), model).join(labels.where(held), "doc_id").select("p_top", "quality", "toxic").collect()
    parts = {"good": [], "toxic": [], "poor": []}
    for r in scored:
        parts["toxic" if r.toxic else "good" if r.quality else "poor"].append(r.p_top >= model.least)
    share = {k: float(np.mean(v)) for k, v in parts.items()}
    print("shares selected", model.least, share, {k: len(v) for k, v in parts.items()})
    assert share["toxic"] < 0.2 and share["poor"] < 0.2 and share["good"] > 0.9


def test_quality_without_labels_selects_everything(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select(docs.select("doc_id", "text"), none).count() == docs.count()


def test_language_models_are_distributions_and_predict_held_out(docs, spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    names, score, entropy, accepted = model.predict(["thation of the erand", None, "12 34 !", "le des eauxment pour la"])
    assert names[1:3] == ["und", "und"] and (score[1:3] == 0).all() and (score <= 1).all()
    rows = langid.identify(docs.where(langid.held_out()), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.93
    # Probabilities of all known characters after one context, and of an unknown one, sum to at most one.
    level = model.levels[0]
    context = langid.grams(np.array([32, 32, 101], np.uint32).repeat([1, 1, 2]), 4)[:1]
    keys = (context << np.uint64(16)) | level.keys
    total = np.exp(model._log(keys & np.uint64(2**64 - 1), langid.ORDER)).sum(axis=0)
    assert (total <= 1 + 1e-4).all() and (total > 0.9).all()


def test_matched_models_prefer_their_own_text(spark):
    target = [(n, "alpha beta gamma delta " * 6) for n in range(5)]
    rest = [(n, "one two three four " * 6) for n in range(10, 20)]
    rows = frame(spark, target + rest + [(30, None), (31, " ")])
    labels = spark.createDataFrame([(n, 1, 0) for n in range(5)] + [(10, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = lm_score.fit(rows, labels, size=8)
    got = {r.doc_id: r for r in lm_score.score(rows, model).collect()}
    assert got[0].score < 0 < got[10].score and got[0].n_tokens == 24
    assert got[30].score is None and got[31].target_loss is None
    before = np.array([3])
    single = np.exp(model.singles[:9] + model.rest[before])
    key = (np.uint64(3) << np.uint64(32)) | np.arange(9, dtype=np.uint64)
    at = np.searchsorted(model.keys, key)
    p = np.array([np.exp(model.pairs[a]) if a < len(model.keys) and model.keys[a] == k else s for a, k, s in zip(at, key, single, strict=True)])
    assert np.allclose(p.sum(axis=0), 1)


def test_lm_scores_do_not_depend_on_the_broadcast_head(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = docs.unionByName(docs.limit(20), allowMissingColumns=True)  # repeated rows are scored each
    scores = []
    for bits in (20, 10, 0):
        model = lm_score.fit(odd, labels, size=500, head_bits=bits)
        assert len(model.keys) <= 1 << bits
        rows = lm_score.score(odd, model).collect()
        scores.append(sorted((r.doc_id, r.n_tokens, r.target_loss or 0.0, r.background_loss or 0.0) for r in rows))
    assert len(scores[0]) == odd.count() and model.tail.count() > 1000
    assert np.allclose(scores[0], scores[1], atol=1e-7) and np.allclose(scores[0], scores[2], atol=1e-7)


def test_lm_losses_equal_plain_counting(spark, docs):
    import collections
    import math

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
             for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    count = collections.Counter(w for words in texts.values() for w in words)
    names = {w: w for w in count}  # a vocabulary that holds every word
    ids = [(d, words) for d, words in texts.items() if words]
    sides = []
    for some in ([w for d, w in ids if d in good], [w for _, w in ids]):
        single = collections.Counter(names[w] for words in some for w in words)
        pair = collections.Counter(p for words in some for p in zip([None, *words[:-1]], words, strict=True))
        after = collections.Counter()
        for (h, _), n in pair.items():
            after[h] += n
        sides.append((single, pair, after))
    scale = [1.0, sum(sides[0][0].values()) / sum(sides[1][0].values())]
    model = lm_score.fit(docs, labels, size=len(count), head_bits=8)
    got = {r.doc_id: r for r in lm_score.score(docs, model).collect()}
    m = lm_score.SMOOTHING
    for d, words in ids[:60]:
        want = []
        for (single, pair, after), k in zip(sides, scale, strict=True):
            total = sum(single.values()) * k
            loss = 0.0
            for h, w in zip([None, *words[:-1]], words, strict=True):
                p = (single[w] * k + 1) / (total + len(count) + 1)
                loss -= math.log((pair[h, w] * k + m * p) / (after[h] * k + m))
            want.append(loss / len(words))
        assert got[d].n_tokens == len(words)
        assert math.isclose(got[d].target_loss, want[0], abs_tol=1e-6) and math.isclose(got[d].background_loss, want[1], abs_tol=1e-6)


def test_lm_scores_know_every_word(spark, docs):
    """Words outside the broadcast head keep their own counts, also in texts that the model has not seen."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    more = docs.select("doc_id", "text").unionByName(frame(spark, [
        (10**6, "zzyzx quux zzyzx"), (10**6 + 1, " ".join(r.text or "" for r in docs.orderBy("doc_id").limit(3).collect())[::3])]))
    scores = []
    for size in (1 << 20, 500, 0):
        model = lm_score.fit(docs, labels, size=size, head_bits=12)
        rows = lm_score.score(more, model).collect()
        scores.append(sorted((r.doc_id, r.n_tokens, r.target_loss or 0.0, r.background_loss or 0.0) for r in rows))
    assert len(scores[0]) == more.count()
    assert np.allclose(scores[0], scores[1], atol=1e-6) and np.allclose(scores[0], scores[2], atol=1e-6)
