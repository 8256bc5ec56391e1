"""Text overlap of one pair: longest common subsequence, METEOR, term recall, and cosine of token vectors.

The two sequence scores need loops over tokens and run as Arrow functions on whole column batches; the rest are
native expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reasonmill.functions.expr import harmonic_mean, let, share
from reasonmill.functions.stem import porter
from reasonmill.schema import as_column

# --- fixed values: published METEOR weights, and the length from which the overlap score stems a token
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
STEM_FROM = 4
# --- end of fixed values


def word_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit("[a-z0-9]+"), F.lit(0))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence, a whole row of the table at a time as the bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for n, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << n)
    full = (1 << len(a)) - 1
    open_ = full
    for token in b:
        match = open_ & where.get(token, 0)
        open_ = ((open_ + match) | (open_ - match)) & full
    return len(a) - open_.bit_count()


def _coded(*columns: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """Lists of texts as lists of codes, and the text of each code."""
    flat = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    codes, out, at = flat.indices, [], 0
    for c in columns:
        ends = c.offsets.to_numpy() - c.offsets[0].as_py()
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), codes.slice(at, int(ends[-1]))))
        at += int(ends[-1])
    return out, flat.dictionary


def _renamed(dictionary: pa.Array, form: Callable[[str], str]) -> tuple[np.ndarray, int]:
    """For each code that of its form, and the number of forms."""
    again = pa.array([form(t) for t in dictionary.to_pylist()], pa.string()).dictionary_encode()
    return again.indices.to_numpy().astype(np.int64), len(again.dictionary)


def _padded(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray, width: int, blank: int) -> np.ndarray:
    """The lists of some rows as a matrix, position by position."""
    out = np.full((width, len(rows)), blank)
    sizes = ends[rows + 1] - ends[rows]
    each = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[place, each] = flat[ends[rows][each] + place]
    return out


LOCKSTEP_TOKENS = 512  # longer lists are compared pair by pair
_CELLS = 1 << 20


def lcs_lengths(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, n_codes: int) -> np.ndarray:
    """``lcs_length`` of many pairs of code lists. Short ones go in step: the bits of a pair are some 64-bit words, and
    each token of the second lists is one operation on the words of all pairs."""
    n_a, n_b = np.diff(a_ends), np.diff(b_ends)
    out = np.zeros(len(n_a), np.int64)
    words = (n_a + 63) // 64
    short = (n_a > 0) & (n_b > 0) & (n_a <= LOCKSTEP_TOKENS) & (n_b <= LOCKSTEP_TOKENS) & ((n_codes + 1) * words <= _CELLS // 16)
    for n in np.flatnonzero((n_a > 0) & (n_b > 0) & ~short).tolist():
        out[n] = lcs_length(a[a_ends[n]:a_ends[n + 1]].tolist(), b[b_ends[n]:b_ends[n + 1]].tolist())
    for size in np.unique(words[short]).tolist():
        alike = np.flatnonzero(short & (words == size))
        alike = alike[np.argsort(n_b[alike], kind="stable")]
        step = max(_CELLS // ((n_codes + 1) * size), 1)
        for first in range(0, len(alike), step):
            rows = alike[first:first + step]
            each = np.arange(len(rows))
            where = np.zeros((size, n_codes + 1, len(rows)), np.uint64)
            for n, codes in enumerate(_padded(a, a_ends, rows, int(n_a[rows].max()), n_codes)):
                where[n >> 6, codes, each] |= np.uint64(1 << (n & 63))
            where[:, n_codes] = 0
            open_ = np.full((size, len(rows)), ~np.uint64(0))
            for codes in _padded(b, b_ends, rows, int(n_b[rows].max()), n_codes):
                carry = np.uint64(0)
                for w in range(size):
                    old, mask = open_[w], where[w, codes, each]
                    total = old + (old & mask)
                    over = total < old
                    total = total + carry
                    carry = (over | (total < carry)).astype(np.uint64)
                    open_[w] = total | (old & ~mask)
            out[rows] = size * 64 - np.bitwise_count(open_).sum(axis=0, dtype=np.int64)
    return out


def _ends(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)


_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_VISIBLE = np.ones(256, bool)
_VISIBLE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False


def _runs(texts: pa.Array, kept: np.ndarray) -> pa.Array:
    """Runs of kept bytes of each text; no run crosses texts."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = kept[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    starts[first] = inside[first]
    starts = np.flatnonzero(starts)
    place = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), runs)


def _tokens(texts: pa.Array) -> pa.Array:
    """``word_tokens`` of a batch."""
    # Lower case of this letter is two characters, which Arrow's own does not say.
    lower = pc.utf8_lower(pc.replace_substring(texts.cast(pa.string()).fill_null(""), "\u0130", "i\u0307"))
    return _runs(lower, _ALNUM)


_OVERLAP = T.StructType([T.StructField(n, T.IntegerType()) for n in ("common", "n_ref", "n_gen")])


def _overlap(reference: pa.Array, generated: pa.Array, form: Callable[[str], str]) -> pa.Array:
    (a, b), names = _coded(_tokens(reference), _tokens(generated))
    forms, n_forms = _renamed(names, form)
    (a, a_ends), (b, b_ends) = _ends(a), _ends(b)
    common = lcs_lengths(forms[a], a_ends, forms[b], b_ends, n_forms)
    counts = [pa.array(n, pa.int32()) for n in (common, np.diff(a_ends), np.diff(b_ends))]
    return pa.StructArray.from_arrays(counts, names=_OVERLAP.names)


@F.arrow_udf(_OVERLAP)
def _overlap_of_words(reference: pa.Array, generated: pa.Array) -> pa.Array:
    return _overlap(reference, generated, str)


@F.arrow_udf(_OVERLAP)
def _overlap_of_stems(reference: pa.Array, generated: pa.Array) -> pa.Array:
    return _overlap(reference, generated, lambda t: porter(t) if len(t) >= STEM_FROM else t)


def rouge_l(reference: Column | str, generated: Column | str, stem: bool = True) -> Column:
    """F-measure of the longest common subsequence; 0 when either side has no token."""
    texts = [F.make_valid_utf8(as_column(t)) for t in (reference, generated)]
    return let((_overlap_of_stems if stem else _overlap_of_words)(*texts), lambda o: harmonic_mean(
        F.coalesce(share(o["common"], o["n_gen"]), F.lit(0.0)), F.coalesce(share(o["common"], o["n_ref"]), F.lit(0.0))))


def _align(hyp: list[tuple[int, str]], ref: list[tuple[int, str]]):
    """Pairs of equal words, taken from the end of both lists, and what stays unmatched on either side."""
    places: dict[str, list[int]] = {}
    for n, word in ref:
        places.setdefault(word, []).append(n)
    matched, rest = [], []
    for n, word in reversed(hyp):
        stack = places.get(word)
        if stack:
            matched.append((n, stack.pop()))
        else:
            rest.append(n)
    used = {r for _, r in matched}
    return matched, rest[::-1], [n for n, _ in ref if n not in used]


def meteor_score(reference: str, generated: str) -> float:
    """Exact matches, then matches of stems; no synonym stage, as that needs a lexical database. One pair, word by word."""
    ref, hyp = reference.lower().split(), generated.lower().split()
    exact, hyp_rest, ref_rest = _align(list(enumerate(hyp)), list(enumerate(ref)))
    stems, _, _ = _align([(n, porter(hyp[n])) for n in hyp_rest], [(n, porter(ref[n])) for n in ref_rest])
    matches = sorted(exact + stems)
    follows = sum(
        h2 == h1 + 1 and r2 == r1 + 1 for (h1, r1), (h2, r2) in zip(matches, matches[1:], strict=False)
    )
    return _weighed(len(matches), follows, len(hyp), len(ref))


def _weighed(matches: int, follows: int, n_hyp: int, n_ref: int) -> float:
    if not matches:
        return 0.0
    precision, recall = matches / n_hyp, matches / n_ref
    mean = precision * recall / (METEOR_ALPHA * precision + (1 - METEOR_ALPHA) * recall)
    return mean * (1 - METEOR_GAMMA * ((matches - follows) / matches) ** METEOR_BETA)


def _aligned(hyp: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_align`` of many pairs: places in both of equal keys, each from the end, first with first."""
    keys = np.concatenate([hyp, ref])
    side = np.repeat([0, 1], [len(hyp), len(ref)])
    order = np.argsort(keys, kind="stable")[::-1]  # of a key the references from the end, then the others
    ordered, of_ref = keys[order], side[order] == 1
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    n_refs = np.bincount(group[of_ref], minlength=group[-1] + 1 if len(keys) else 0)
    rank = np.arange(len(keys)) - np.flatnonzero(new)[group]
    taken = ~of_ref & (rank - n_refs[group] < n_refs[group])
    at = np.flatnonzero(taken)
    return order[at], order[at - n_refs[group[at]]] - len(hyp)


def _words(texts: pa.Array) -> pa.Array:
    """Lower-cased and split at blanks, as Python does it."""
    texts = texts.cast(pa.string()).fill_null("")
    if pc.all(pc.string_is_ascii(texts)).as_py():
        return _runs(pc.ascii_lower(texts), _VISIBLE)
    return pa.array([t.lower().split() for t in texts.to_pylist()], pa.list_(pa.string()))


def meteor_scores(reference: pa.Array, generated: pa.Array) -> list[float]:
    """``meteor_score`` of many pairs; the words of all of them are aligned in two sorts."""
    (ref, hyp), names = _coded(_words(reference), _words(generated))
    stems, n_stems = _renamed(names, porter)
    (ref, ref_ends), (hyp, hyp_ends) = _ends(ref), _ends(hyp)
    n_ref, n_hyp = np.diff(ref_ends), np.diff(hyp_ends)
    ref_pair, hyp_pair = (np.repeat(np.arange(len(n)), n) for n in (n_ref, n_hyp))
    match = np.full(len(hyp) + 1, -2)
    h, r = _aligned(hyp_pair * len(names) + hyp, ref_pair * len(names) + ref)
    match[h] = r
    used = np.zeros(len(ref), bool)
    used[r] = True
    hyp_rest, ref_rest = np.flatnonzero(match[:-1] < 0), np.flatnonzero(~used)
    h, r = _aligned(*(pair[rest] * n_stems + stems[words[rest]] for pair, rest, words in (
        (hyp_pair, hyp_rest, hyp), (ref_pair, ref_rest, ref))))
    match[hyp_rest[h]] = ref_rest[r]
    found = match[:-1] >= 0
    follows = found[:-1] & (match[1:-1] == match[:-2] + 1) & (hyp_pair[1:] == hyp_pair[:-1])
    count = lambda pairs: np.bincount(pairs, minlength=len(n_hyp)).tolist()
    return [
        _weighed(*x) for x in zip(count(hyp_pair[found]), count(hyp_pair[:-1][follows]), n_hyp.tolist(), n_ref.tolist(), strict=True)
    ]


@F.arrow_udf(T.DoubleType())
def _meteor(reference: pa.Array, generated: pa.Array) -> pa.Array:
    return pa.array(meteor_scores(reference, generated), pa.float64())


def meteor(reference: Column | str, generated: Column | str) -> Column:
    """0 when either text is NULL or blank, as for the other overlap scores."""
    return _meteor(as_column(reference), as_column(generated))


def term_recall(reference: Column | str, generated: Column | str, terms: Sequence[str]) -> Column:
    """Share of the terms in the reference that the generated text has too; NULL if the reference has none."""
    ref, gen = F.lower(as_column(reference)), F.lower(as_column(generated))
    # One expression a term, not a lambda over a list of them, which is interpreted.
    has = [[F.coalesce(F.contains(text, F.lit(t)).cast("int"), F.lit(0)) for t in terms] for text in (ref, gen)]
    total = lambda counts: reduce(lambda x, y: x + y, counts, F.lit(0))
    return share(total([x * y for x, y in zip(*has, strict=True)]), total(has[0]))


BEST_MATCHES = T.StructType(
    [
        T.StructField("left", T.ArrayType(T.DoubleType())),
        T.StructField("right", T.ArrayType(T.DoubleType())),
    ]
)


def _unit_rows(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


@F.arrow_udf(BEST_MATCHES)
def best_cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    """Two blocks of vectors: the greatest cosine of each vector with any vector of the other block."""
    out = []
    for a, b in zip(left, right, strict=True):
        cosine = _unit_rows(a.values) @ _unit_rows(b.values).T
        out.append({"left": cosine.max(axis=1).tolist(), "right": cosine.max(axis=0).tolist()})
    return pa.array(
        out, pa.struct([("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))])
    )
