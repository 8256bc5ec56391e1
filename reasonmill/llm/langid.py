"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Characters are letters of lower-cased texts; everything else is one blank. For each order up to four, one sorted array of
hashed n-grams serves all languages, with a column of log probabilities per language that are already interpolated down
to the lower orders; contexts have an array of back-off weights. A text gets its length-normalised cross-entropy under
every model, and the lowest wins. The score is the posterior under a temperature fitted on documents that the models
did not count; a text whose best cross-entropy is above what 99 of 100 such documents reach is marked as not accepted.

The models learn from a bounded sample of the labelled documents (``per_language`` for each, by hash of the id);
prediction reads whole texts of all documents and nothing but the text.

Defined results: NULL texts and texts without a letter get ``und`` and score 0, as does every text when nothing was
learned; ties go to the first language in alphabetical order; equal texts get equal results; a NULL doc_id is not
learned from and is not held out. Columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.blocks import bound_batches, mix, signed, unsigned

ORDER = 4
PER_LANGUAGE = 2_000
UNDEFINED = "und"
_BLANK = 32
_CHARS = 1 << 20  # characters of one block


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that nothing learns from: crc32 of the id as text, modulo five, is zero."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letters(text: str | None) -> np.ndarray:
    """Code points of a text: lower-cased letters, and one blank around every run of them; empty without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.unique(raw)
    bad = np.array([c for c in known if not chr(c).isalpha()], np.uint32)
    plain = np.where(np.isin(raw, bad), np.uint32(_BLANK), raw)
    if not (plain != _BLANK).any():
        return np.zeros(0, np.uint32)
    plain = np.concatenate(([_BLANK], plain, [_BLANK])).astype(np.uint32)
    return plain[np.concatenate(([True], (plain[1:] != _BLANK) | (plain[:-1] != _BLANK)))]


def grams(chars: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each character from the ``ORDER``-th on: all orders then stand
    side by side for one place. Up to four characters of sixteen bits the hash is exact."""
    out = np.zeros(max(len(chars) - ORDER + 1, 0), np.uint64)
    folded = np.where(chars > 0xFFFF, mix(chars.astype(np.uint64)) & np.uint64(0xFFFF), chars.astype(np.uint64))
    for k in range(order, 0, -1):
        out = (out << np.uint64(16)) | folded[ORDER - k:len(folded) - k + 1]
    return out


@dataclass
class Level:
    """One order: n-grams with a log probability for each language, contexts with a back-off weight for each."""

    keys: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted


@dataclass
class Model:
    languages: tuple[str, ...]
    levels: list[Level] = field(default_factory=list)
    unseen: np.ndarray | None = None
    temperature: float = 1.0
    ceiling: float = np.inf

    def _log(self, grams4: np.ndarray, order: int) -> np.ndarray:
        """Log probability of the last character of distinct n-grams, given the ones before, per language."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(grams4), len(self.languages)))
        level = self.levels[order - 1]
        mask = np.uint64((1 << 16 * order) - 1)
        key = grams4 & mask
        at, there = level.find(level.keys, key)
        out = level.logs[at].astype(np.float64)
        rest = np.flatnonzero(~there)
        if len(rest):
            lower = self._log(key[rest], order - 1)
            if order > 1:
                at, known = level.find(level.contexts, key[rest] >> np.uint64(16))
                lower = lower + np.where(known[:, None], level.backoff[at], 0.0)
            out[rest] = lower
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy per character (nats) of each text under each language; NaN without a letter."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        chars = [letters(t) for t in texts]
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(chars[begin])
            while end < len(texts) and size + len(chars[end]) <= _CHARS:
                size += len(chars[end])
                end += 1
            pads = [np.concatenate((np.full(ORDER - 1, _BLANK, np.uint32), c)) if len(c) else c for c in chars[begin:end]]
            keys = [grams(c, ORDER) for c in pads]
            counts = np.array([len(k) for k in keys])
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            if len(distinct):
                logs = self._log(distinct, ORDER)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                for n in range(len(self.languages)):
                    sums = np.concatenate(([0.0], np.cumsum(logs[back, n])))
                    some = np.flatnonzero(counts)
                    out[begin + some, n] = -(sums[bounds[some + 1]] - sums[bounds[some]]) / counts[some]
            begin = end
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is accepted."""
        if not self.languages:
            none = np.zeros(len(texts))
            return [UNDEFINED] * len(texts), none, none, none.astype(bool)
        entropy = self.entropies(texts)
        known = ~np.isnan(entropy[:, 0])
        filled = np.where(known[:, None], entropy, 0.0)
        best = filled.argmin(axis=1)
        least = filled.min(axis=1)
        odds = np.exp(-(filled - least[:, None]) / self.temperature)
        names = [self.languages[b] if k else UNDEFINED for b, k in zip(best, known, strict=True)]
        return names, np.where(known, 1 / odds.sum(axis=1), 0.0), np.where(known, least, 0.0), known & (least <= self.ceiling)


def build(languages: tuple[str, ...], keys: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> Model:
    """Models from the counts of n-grams of the highest order: (n-gram, language, count), each pair once."""
    model = Model(languages)
    width = len(languages)
    per_order: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: []}
    for n in range(width):
        mine = owners == n
        order = np.argsort(keys[mine])
        per_order[ORDER].append((keys[mine][order], counts[mine][order].astype(float)))
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before an n-gram
        mask = np.uint64((1 << 16 * order) - 1)
        per_order[order] = [
            (lambda u: (u[0], u[1].astype(float)))(np.unique(higher & mask, return_counts=True))
            for higher, _ in per_order[order + 1]
        ]
    letters_seen = len(np.unique(np.concatenate([k for k, _ in per_order[1]]))) + 1
    model.unseen = np.full(width, -np.log(letters_seen))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in per_order[order]]))
        contexts = np.unique(union >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
        level = Level(union, np.zeros((len(union), width), np.float32), contexts, np.zeros((len(contexts), width), np.float32))
        lower = np.exp(model._log(union, order - 1))
        for n, (have, count) in enumerate(per_order[order]):
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            of, _ = level.find(contexts, have >> np.uint64(16)) if order > 1 else (np.zeros(len(have), int), None)
            total = np.bincount(of, count, len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            share = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)  # mass for the lower order
            at, _ = level.find(union, have)
            own, _ = level.find(contexts, union >> np.uint64(16)) if order > 1 else (np.zeros(len(union), int), None)
            p = share[own] * lower[:, n]
            p[at] += np.maximum(count - discount, 0) / np.maximum(total[of], 1)
            level.logs[:, n] = np.log(np.maximum(p, 1e-12))
            level.backoff[:, n] = np.log(np.maximum(share, 1e-6))
        if order == 1:
            model.unseen = level.backoff[0].astype(float) - np.log(letters_seen)
        model.levels.append(level)
    return model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            chars = letters(text)
            if len(chars):
                by.setdefault(lang, []).append(grams(np.concatenate((np.full(ORDER - 1, _BLANK, np.uint32), chars)), ORDER))
        for lang, parts in by.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(signed(keys)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Models from labelled documents that are not held out; a tenth of the sample calibrates instead of counting."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model(())
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()])
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = known.where((dealt < share * 1_000_000) & F.col("text").isNotNull())
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0
    languages = tuple(sorted(sizes))
    rows = sample.where(~calibrating).select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # the distinct n-grams of a bounded sample
    owner = {k: n for n, k in enumerate(languages)}
    if not rows.num_rows:
        return Model(())
    model = build(languages, unsigned(rows.column("gram").to_numpy()),
                  np.array([owner[k] for k in rows.column("lang").to_pylist()]), rows.column("n").to_numpy())
    return _calibrated(model, sample.where(calibrating).select("lang", "text"))


def _calibrated(model: Model, sample: DataFrame) -> Model:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy = shared.value.entropies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(entropy.tolist(), pa.list_(pa.float64()))], names=["lang", "entropy"])

    rows = [r for r in sample.mapInArrow(run, "lang string, entropy array<double>").collect() if not np.isnan(r.entropy[0])]
    if not rows:
        return model
    entropy = np.array([r.entropy for r in rows])
    true = np.array([model.languages.index(r.lang) for r in rows])
    apart = entropy - entropy.min(axis=1, keepdims=True)
    losses = {t: (apart[np.arange(len(true)), true] / t + np.log(np.exp(-apart / t).sum(axis=1))).mean()
              for t in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)}
    model.temperature = min(losses, key=losses.get)
    model.ceiling = float(np.quantile(entropy.min(axis=1), 0.99))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score, cross_entropy and accepted."""
    docs = docs.drop("lang_pred", "score", "cross_entropy", "accepted")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang, score, entropy, accepted = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(accepted)],
                names=[*batch.schema.names, "lang_pred", "score", "cross_entropy", "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, cross_entropy double, accepted boolean")
