"""Quality classifier: ordinal regression with cumulative links over hashed text features.

Grades are ordered. One weight vector is shared by all of them, and increasing thresholds cut its scale:
P(grade <= j) = sigmoid(threshold_j - w.x). So one score gives the expected grade and the tail probability
P(grade >= g) that selects. Features: the distinct words of a text (runs of letters, lower case, hashed), scaled by their
number, and densities of marks, capitals, digits and words said again. Graded ratings here: 0 toxic, 1 poor, 2 good.

The fit takes a bounded sample of rated documents (``sample``, by hash of the id); scoring covers all documents. The
selecting probability is calibrated on all of these documents, each judged by a fit that did not see it: of all up to one
half it has the least sum of the share of well rated documents lost and the mean share of toxic and of poor ones let
through, ties to the one nearest one half. With fewer than ``LEAST_HELD`` well rated or others kept out, it is one half.

Defined results: NULL and empty texts have only the feature of having no word, and are selected; equal texts get equal
scores; unrated documents are scored like others; of several ratings the least counts; without any rated document all
weights are zero and everything is selected. Columns named like an output column are replaced, others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.blocks import LOWER, Block, blocks

BUCKETS = 1 << 16
DENSE = 9
HELD = 5  # parts of the rated documents, each kept out of one of the fits that calibrate
LEAST_HELD = 20
SAMPLE = 12_000
GRADES = 3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NOT_LETTER = ~_LETTER
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[n for n in range(33, 127) if not (48 <= n < 58 or 65 <= n < 91 or 97 <= n < 123)]] = True


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every distinct word of each text, where each text's begin, and the dense features."""
    hashes, bounds = block.word_hashes(space=_NOT_LETTER, lower=LOWER)
    texts = np.repeat(np.arange(len(block)), np.diff(bounds)).astype(np.uint64)
    keys = np.unique((texts << np.uint64(32)) | (hashes % np.uint64(BUCKETS)))
    owner = (keys >> np.uint64(32)).astype(np.int64)
    size = np.maximum(np.diff(block.offsets), 1).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[block.data])))
        return (total[block.offsets[1:]] - total[block.offsets[:-1]]) / size

    # How many words only say again the word before them.
    words, first = block.word_hashes()
    again = np.concatenate(([0], np.cumsum(np.concatenate(([False], words[1:] == words[:-1])) if len(words) else [])))
    stutter = (again[first[1:]] - again[first[:-1]]) / np.maximum(np.diff(first), 1)
    marks, capitals, digits = share(_MARK), share(_UPPER), share(_DIGIT)
    dense = np.stack([
        np.minimum(marks * 5, 1), marks > 0.06, marks > 0.15, np.minimum(capitals * 2, 1), capitals > 0.3, digits > 0.2,
        np.minimum(stutter * 2, 1), stutter > 0.2, np.diff(bounds) == 0,
    ], axis=1).astype(float)
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(owner, np.arange(len(block) + 1)), dense


def _scale(distinct: np.ndarray) -> np.ndarray:
    """Value of each distinct word of a text: with it a score does not grow with the length."""
    return 4 / np.sqrt(np.maximum(distinct, 16))


@dataclass
class Model:
    words: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray  # one less than grades, increasing

    least: float = 0.5  # calibrated probability of the top grade from which a text is selected

    def logits(self, block: Block) -> np.ndarray:
        buckets, bounds, dense = features(block)
        sums = np.concatenate(([0.0], np.cumsum(self.words[buckets])))
        return (sums[bounds[1:]] - sums[bounds[:-1]]) * _scale(np.diff(bounds)) + dense @ self.dense

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. grades - 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))


def fit_arrays(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 200, penalty: float = 2e-4,
               least: int = 8) -> Model:
    """Adam on the mean cumulative-link loss. Words in fewer than ``least`` rated texts keep weight zero; grades
    weigh by the root of their number."""
    model = Model(np.zeros(BUCKETS), np.zeros(DENSE), np.linspace(-4.0, -2.0, GRADES - 1))
    if not rows:
        return model
    grade = np.array([r[2] for r in rows])
    flat = np.concatenate([r[0] for r in rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    dense = np.stack([r[1] for r in rows])
    common = np.bincount(flat, minlength=BUCKETS) >= least
    keep = common[flat]
    flat, owner = flat[keep], owner[keep]
    value = _scale(np.array([len(r[0]) for r in rows]))[owner]
    weight = 1 / np.sqrt(np.maximum(np.bincount(grade, minlength=GRADES), 1))[grade]
    weight /= weight.sum()
    # The thresholds are a first one and positive steps, so their order holds by construction.
    params = np.concatenate([model.words, model.dense, [model.thresholds[0]], np.log(np.diff(model.thresholds))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        words, d = params[:BUCKETS], params[BUCKETS:BUCKETS + DENSE]
        t = params[BUCKETS + DENSE] + np.concatenate(([0.0], np.cumsum(np.exp(params[BUCKETS + DENSE + 1:]))))
        z = np.bincount(owner, words[flat] * value, len(rows)) + dense @ d
        below = 1 / (1 + np.exp(np.clip(z[:, None] - t[None, :], -30, 30)))  # P(grade <= j)
        edges = np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))])
        each = np.arange(len(z))
        p = np.maximum(edges[each, grade + 1] - edges[each, grade], 1e-9)
        slope = np.hstack([np.zeros((len(z), 1)), below * (1 - below), np.zeros((len(z), 1))])
        up, down = slope[each, grade + 1] / p, slope[each, grade] / p
        dz = weight * (up - down)
        dt = np.zeros(GRADES + 1)
        np.add.at(dt, grade + 1, -weight * up)
        np.add.at(dt, grade, weight * down)
        dt = dt[1:GRADES]
        gradient = np.concatenate([
            np.bincount(flat, dz[owner] * value, BUCKETS) + penalty * words, dense.T @ dz + penalty * 0.1 * d,
            [dt.sum()], np.exp(params[BUCKETS + DENSE + 1:]) * np.cumsum(dt[::-1])[::-1][1:],
        ])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        params[:BUCKETS][~common] = 0
    t = params[BUCKETS + DENSE] + np.concatenate(([0.0], np.cumsum(np.exp(params[BUCKETS + DENSE + 1:]))))
    return Model(params[:BUCKETS], params[BUCKETS:BUCKETS + DENSE], t)


def threshold(p: np.ndarray, grade: np.ndarray) -> float:
    """Probability from which to select, given those of documents of known grade, by both kinds of error."""
    good, bad = grade == GRADES - 1, [p[grade == g] for g in range(GRADES - 1) if (grade == g).any()]
    if good.sum() < LEAST_HELD or sum(map(len, bad)) < LEAST_HELD:
        return 0.5
    at = np.unique(np.concatenate([p[p < 0.5], [0.5]]))
    lost = np.searchsorted(np.sort(p[good]), at, side="left") / good.sum()
    through = np.mean([1 - np.searchsorted(np.sort(x), at, side="left") / len(x) for x in bad], axis=0)
    cost = lost + through
    best = at[cost <= cost.min() + 1e-12]
    return float(best[np.argmin(np.abs(best - 0.5))])


def fit_and_calibrate(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Model of all rows, with a threshold from all rows, each judged by a model that did not see it: every ``HELD``-th in
    turn, however many there are. ``rows`` are sorted by grade, so each grade is kept out in proportion."""
    p, grade = [np.zeros(0)], []
    for part in range(HELD):
        held = rows[part::HELD]
        if held:
            other = fit_arrays([x for n, x in enumerate(rows) if n % HELD != part])
            z = [other.words[np.asarray(w, np.int64)].sum() * _scale(np.array(len(w))) + np.dot(d, other.dense) for w, d, _ in held]
            p.append(other.tails(np.array(z))[:, -1])
            grade += [g for _, _, g in held]
    model = fit_arrays(rows)
    model.least = threshold(np.concatenate(p), np.array(grade, np.int64))
    return model


def rating(quality: Column, toxic: Column) -> Column:
    """Graded rating of a document: 0 toxic, 1 poor, 2 good; NULL if either mark is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_column: str = "text") -> Model:
    """Model from about ``sample`` rated documents; labels are (doc_id, quality, toxic), several per document average
    to their least."""
    rated = labels.select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade")).where(
        "grade is not null and doc_id is not null"
    ).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    total = max(rated.count(), 1)
    # A share by hash keeps the sample bounded (up to chance) and the same in every run.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / total))
    chosen = F.broadcast(rated.where(part))  # about ``sample`` rows of two numbers
    texts = docs.select("doc_id", F.col(text_column).alias("text")).where("text is not null").join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            buckets, bounds, dense = features(block)
            each = [np.unique(buckets[a:b]).tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(each, pa.list_(pa.int32())), pa.array(dense.tolist(), pa.list_(pa.float64())),
                 block.rows.column("grade")], names=["words", "dense", "grade"])

    rows = texts.mapInArrow(run, "words array<int>, dense array<double>, grade int")

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(batch)), key=lambda n: (batch.grade[n], len(batch.words[n]), tuple(batch.words[n][:8])))
        model = fit_and_calibrate([(batch.words[n], batch.dense[n], int(batch.grade[n])) for n in order])
        at = np.flatnonzero(model.words)
        return pd.DataFrame({"at": [at], "words": [model.words[at]], "dense": [model.dense], "thresholds": [model.thresholds], "least": [model.least]})

    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(  # the bounded sample, in one task
        solve, "at array<int>, words array<float>, dense array<double>, thresholds array<double>, least double"
    ).collect()
    if not fitted:
        return fit_arrays([])
    words = np.zeros(BUCKETS)
    words[fitted[0]["at"]] = fitted[0]["words"]
    return Model(words, np.array(fitted[0]["dense"]), np.array(fitted[0]["thresholds"]), fitted[0]["least"])


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with expected_grade and p_top, the probability of the highest grade."""
    docs = docs.drop("expected_grade", "p_top")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_column):
            tails = shared.value.tails(shared.value.logits(block))
            yield pa.RecordBatch.from_arrays(
                [*block.rows.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])],
                names=[*block.rows.schema.names, "expected_grade", "p_top"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, expected_grade double, p_top double")


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scored documents whose probability of the top grade reaches the calibrated one. An empty text has nothing to
    judge and stays."""
    model = fit(docs, labels, sample)
    scored = score(docs, model)
    return scored.where((F.col("p_top") >= model.least) | F.col("text").isNull() | (F.trim("text") == ""))
