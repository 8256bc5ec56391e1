"""Texts of derived traces, written in Arrow batches: a trace is a row of numbers of its nodes, and every node is one of
some ten thousand texts that differ in few small values. As array expressions the same took longer than reading the
traces, because lambdas are interpreted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NODES, CITING = 9, 3  # the most observations and inferences of a trace
CONFIDENCES = ("high", "medium", "moderate", "low")


@lru_cache(maxsize=4)
def _texts(sensors: tuple[str, ...], windows: tuple[str, ...], patterns: tuple[str, ...], syntheses: tuple[str, ...],
           activities: tuple[str, ...]) -> tuple[pa.Array, list[int]]:
    """All node texts, and where those of observations, inferences, syntheses and activity lines begin."""
    heads = lambda word: [f"[{w} | id: {word[0]}" for w in (word, word.lower())]
    ends = ("\n", "\r\n")
    observations = [
        f"{head}{num}]\nsensor: {s}\ntemporal: {w} \npattern: {p}\nconfidence: {conf}\n\n".replace("\n", end)
        for num, s, w, p, conf, head, end in product(
            range(NODES + 1), sensors, windows, patterns, CONFIDENCES, heads("OBSERVATION"), ends)
    ]
    names = [*(s.lower() for s in sensors), "nothing"]
    says = [
        *(f"the {s} signal moves" for s in names), *(f"Motion in {s.replace('_', ' ')} here" for s in names),
        "motion along z", "calm and still",
    ]
    inferences = [
        f"{head}{num}]\nbased_on: O{a}, O{b}{lost}\ninference: {text}\nconfidence: high\n\n".replace("\n", end)
        for num, a, b, lost, text, head, end in product(
            range(CITING + 1), range(1, 9), range(1, 9), ("", ", O99"), says, heads("INFERENCE"), ends)
    ]
    conclusions = [
        f"[SYNTHESIS]\nbased_on: I{n}\n{text}\n\n".replace("\n", end) for n, text, end in product((1, 9), syntheses, ends)
    ]
    lines = [line.replace("\n", end) for line, end in product(activities, ends)]
    parts = (observations, inferences, conclusions, lines)
    return pa.array([t for part in parts for t in part]), np.cumsum([0, *map(len, parts[:-1])]).tolist()


def _code(*digits: tuple[np.ndarray, int]) -> np.ndarray:
    """One number of several, each below its size."""
    out = np.zeros_like(digits[0][0])
    for value, size in digits:
        out = out * size + value
    return out


def _observations(h: np.ndarray, i: np.ndarray, s: np.ndarray, w: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sensor, window, pattern and confidence of the nodes; the shifts are added to what the order says."""
    graded = np.broadcast_to(np.where(i <= 3, 0, np.where(i <= 6, 2, 3)), h.shape)
    return (h + s) % 6, (h // 6 + w) % 7, (h // 42 + q) % 3, np.where(h % 5 == 0, 1, graded)


def batches(
    rows: Iterator[pa.RecordBatch], sensors: Sequence[str], windows: Sequence[str], patterns: Sequence[str],
    syntheses: Sequence[str], classes: Sequence[str],
) -> Iterator[pa.RecordBatch]:
    """Evaluation rows of ``(k, c, p)``, none of them NULL or negative. The rules are those of ``orders_relation``."""
    named = [" ".join(w[:1].upper() + w[1:].lower() for w in c.split(" ")) for c in classes]
    activities = (
        *(f"[ACTIVITY]: {c}" for c in named),
        *(f"[Activity] : {c.replace(' ', '_')}{tail}" for c, tail in product(named, ("", " today"))),
        "[ACTIVITY]: Break_Dancing\n[ACTIVITY]: walking",
    )
    texts, begin = _texts(tuple(sensors), tuple(windows), tuple(patterns), tuple(syntheses), activities)
    n_classes = len(classes)
    i = np.arange(1, NODES + 1)
    for batch in rows:
        k, c, p = (batch.column(x).to_numpy()[:, None] for x in "kcp")
        h = k * 7 + c * 13 + p + i * 37
        head, end = (k % 3 == 0).astype(np.int64), (k % 5 == 0).astype(np.int64)

        def side(n, num, nodes, m, swapped, syn, has_syn, syn_text, line, has_line):  # noqa: ANN001
            s, w, q, conf = nodes
            there = i <= n
            observations = _code((num, NODES + 1), (s, 6), (w, 7), (q, 3), (conf, 4), (head, 2), (end, 2))
            j = np.arange(1, CITING + 1)
            a = (k + swapped) % 8 + 1
            cited = np.full(a.shape, len(sensors))  # of observations with the same number the last counts
            for x in range(NODES):
                cited = np.where((num[:, x:x + 1] == a) & there[:, x:x + 1], s[:, x:x + 1], cited)
            t = (k + c + swapped) % 4
            says = np.where(t < 2, t * (len(sensors) + 1) + cited, 2 * len(sensors) + t)
            inferences = _code(
                (np.broadcast_to(j, a.shape), CITING + 1), (a - 1, 8), ((c + 3 * swapped) % 8, 8),
                (((k + swapped) % 10 == 0).astype(np.int64), 2), (says, 2 * len(sensors) + 4), (head, 2), (end, 2))
            conclusion = _code((syn, 2), (syn_text, 3), (end, 2))
            places = np.concatenate([
                observations + begin[0], inferences + begin[1], conclusion + begin[2], line * 2 + end + begin[3]], axis=1)
            wanted = np.concatenate([there, j <= m, has_syn, has_line], axis=1)
            ends = np.concatenate(([0], np.cumsum(wanted.sum(axis=1)))).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), texts.take(pa.array(places[wanted]))), "")

        cls, none = p % 6, np.zeros_like(k)
        n = (p + k) % 9
        j = np.arange(1, CITING + 1)
        plain = np.broadcast_to(i, h.shape)
        always = np.ones(k.shape, bool)
        reference = side(
            n, plain, _observations(h, i, none, none, none), (k + c) % 4, np.broadcast_to(j, (len(k), CITING)),
            (k % 11 == 0).astype(np.int64), k % 13 != 0, k % 3, cls, always)
        guess = np.where(c % 4 == 0, (p + 1) % 6, cls)
        line = np.where(c % 17 == 0, 3 * n_classes, n_classes + guess * 2 + (c % 2 == 0))
        generated = side(
            np.maximum(n - k % 3, 0) + c % 2, np.where((k % 41 == 0) & (i > 1), i - 1, plain),
            _observations(h, i, ((i + c) % 7 == 0).astype(np.int64), ((i + k) % 5 == 0).astype(np.int64), ((i + k + c) % 4 == 0).astype(np.int64)),
            (k + c + (c % 5 == 0)) % 4, np.where((k % 4 == 0) & (j <= 2), 3 - j, j),
            (k % 7 == 0).astype(np.int64), (k + c) % 17 != 0, c % 3, line, k % 13 != 1)
        c = c[:, 0]
        reference = pc.if_else(pa.array(c % 19 == 1), "  \n ", reference)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k").cast(pa.string()), pa.array(list(classes)).take(pa.array(cls[:, 0])),
             pc.if_else(pa.array(c % 19 == 0), pa.scalar(None, pa.string()), reference),
             pc.if_else(pa.array(c % 23 == 0), " ", generated)],
            names=["sample_id", "gt_activity", "ground_truth_reasoning", "generated"])


RESPONSES = (
    "yes, the same\nboth agree", "hard to tell", "NO\nthey differ", "I would say YES", "unclear", "Nothing in common", "YES",
    "perhaps", "no",
)
CHANNELS = np.array((0, 1, 2, 0, 3, 1))  # sensors that are one and the same have one number


def verdicts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdict rows of ``(k, c, p)``, none of them NULL or negative, by the rules of ``derived.verdict_rows``."""
    number, citing = np.arange(1, NODES + 1), np.arange(1, CITING + 1)
    (a, b), (x, y) = ((np.repeat(z, len(z)), np.tile(z, len(z))) for z in (number, citing))  # pairs, row by row
    for batch in rows:
        k, c, p = (batch.column(x).to_numpy()[:, None] for x in "kcp")
        none = np.zeros_like(k)
        h = k * 7 + c * 13 + p + number * 37
        gt_s, gt_w, gt_q, _ = _observations(h, number, none, none, none)
        pred_s, pred_w, pred_q, _ = _observations(
            h, number, ((number + c) % 7 == 0).astype(np.int64), ((number + k) % 5 == 0).astype(np.int64),
            ((number + k + c) % 4 == 0).astype(np.int64))
        n = (p + k) % 9
        gt_c = np.where(number <= n, CHANNELS[gt_s], -1).astype(np.int8)
        pred_c = np.where(number <= np.maximum(n - k % 3, 0) + c % 2, CHANNELS[pred_s], -2).astype(np.int8)
        row, pair = np.nonzero(gt_c[:, a - 1] == pred_c[:, b - 1])
        i, j, of = a[pair], b[pair], k[row, 0]
        agree = (gt_q[row, i - 1] == pred_q[row, j - 1]) & (np.abs(gt_w[row, i - 1] - pred_w[row, j - 1]) <= 1)
        unsure = (7 * i + j + of) % 29 == 0
        told = agree | unsure | ((i + 2 * j + of) % 31 != 0)  # a judge that failed leaves no answer
        parts = [(row[told], i[told] - 1, j[told] - 1, np.where(agree, 0, np.where(unsure, 1, 2))[told])]
        row, pair = np.nonzero((x <= (k + c) % 4) & (y <= (k + c + (c % 5 == 0)) % 4))
        i, j, of = x[pair], y[pair], k[row, 0]
        base = of + c[row, 0]
        alike = ((base + i) % 4 == (base + np.where((of % 4 == 0) & (j <= 2), 3 - j, j)) % 4) & ((of + i + j) % 3 != 0)
        parts.append((row, i - 1, j - 1, np.where(alike, 3, np.where((i + j + of) % 7 == 0, 4, 5))))
        row = np.flatnonzero((k % 13 != 0) & ((k + c) % 17 != 0))
        of = k[row, 0]
        parts.append((row, 0 * row, 0 * row, np.where(of % 3 == c[row, 0] % 3, 6, np.where(of % 9 == 0, 7, 8))))
        row, i, j, response = (np.concatenate(z) for z in zip(*parts, strict=True))
        order = np.argsort(row, kind="stable")
        kinds = np.repeat((0, 1, 2), [len(part[0]) for part in parts])
        yield pa.RecordBatch.from_arrays(
            [batch.column("k").cast(pa.string()).take(pa.array(row[order])),
             pa.array(("observation", "inference", "synthesis")).take(pa.array(kinds[order])),
             pa.array(i[order], pa.int32()), pa.array(j[order], pa.int32()), pa.array(RESPONSES).take(pa.array(response[order]))],
            names=["sample_id", "kind", "i", "j", "response"])
