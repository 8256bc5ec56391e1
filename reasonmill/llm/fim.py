"""Fill-in-middle transformation: units of a text, two cuts drawn from its id, and the pieces in a new order.

Every Arrow batch goes through one pyarrow.compute pipeline: texts are split into unit lists, the lists flattened with
the index of their parent, the ordinal of each unit in its text computed, units filtered by role (prefix, middle,
suffix), lists of each role rebuilt and joined to one string per text. Rows never meet, so nothing is shuffled; a batch
is bounded by bytes and worked on in slices of about ``SLICE`` bytes, so memory is bounded by the longest text.

A unit is a run of ASCII letters or one other code point. The draws are the first four 8-digit groups of the SHA-256 of
``1:`` and the decimal id, so a row keeps its form on any cluster and in any order.

Defined results: a NULL text counts as ''; a NULL id is drawn as the empty string after ``1:``; an empty text and a text
that holds a sentinel are plain; repeated rows give equal results; an empty table gives none. Further columns are not
carried, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNIT = "([A-Za-z]+|[^A-Za-z])"
SLICE = 1 << 20
OUTPUT = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Rates:
    """Percentages: texts kept plain, and texts in suffix-prefix-middle order among the others."""

    plain: int = 10
    spm: int = 20


def _separator(texts: pa.Array) -> str:
    """A private-use code point that no text of the slice holds; there are more of them than texts that fit a slice."""
    for planes in (range(0xE000, 0xF900), range(0xF0000, 0xFFFFE)):
        for code in planes:
            mark = chr(code)
            if not pc.any(pc.match_substring(texts, mark)).as_py():
                return mark
    raise ValueError("no free separator")


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """The units of each text."""
    mark = _separator(texts)
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement="\\1" + mark)
    lists = pc.split_pattern(marked, mark)  # each list ends with an empty string
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values, parents, ordinals = _flat(lists)
    keep = ordinals < counts[parents] - 1
    return _rebuilt(values, parents, pa.array(keep), len(texts))


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values, index of the parent and ordinal in it."""
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    firsts = np.cumsum(lengths, dtype=np.int64) - lengths
    return values, parents, np.arange(len(values)) - firsts[parents]


def _rebuilt(values: pa.Array, parents: np.ndarray, keep: pa.Array, n: int) -> pa.ListArray:
    """Lists of the kept values under their old parents."""
    counts = np.bincount(parents[keep.to_numpy(zero_copy_only=False)], minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.filter(keep))


def _pieces(lists: pa.ListArray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: units before ``low``, before ``high``, and the others."""
    values, parents, ordinals = _flat(lists)
    lows, highs = low[parents], high[parents]
    roles = (ordinals < lows, (ordinals >= lows) & (ordinals < highs), ordinals >= highs)
    return [pc.binary_join(_rebuilt(values, parents, pa.array(r), len(lists)), "") for r in roles]


def _transformed(texts: pa.Array, draws: np.ndarray, rates: Rates) -> list[pa.Array]:
    lists = unit_lists(texts)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first, second = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    prefix, middle, suffix = _pieces(lists, np.minimum(first, second), np.maximum(first, second))
    marked = [pc.match_substring(texts, s) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(pc.or_(*marked[:2]), marked[2]), pa.array((n == 0) | (draws[:, 2] % 100 >= 100 - rates.plain)))
    spm = pa.array(draws[:, 3] % 100 < rates.spm)
    form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
    joined = {
        PSM: pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
        SPM: pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
    }
    output = pc.if_else(plain, texts, pc.if_else(spm, joined[SPM], joined[PSM]))
    nothing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, nothing, pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return [pa.array(n), form, *chars, output]


def _batches(batches: Iterator[pa.RecordBatch], rates: Rates) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            draws = np.stack([part.column(f"_h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1)
            columns = _transformed(part.column("_text").cast(pa.string()), draws, rates)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_text"), *columns],
                names=["_id", "_text", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def draw(id_column: str, k: int) -> Column:
    """The k-th 8-digit group of the digest of the id, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, rates: Rates = Rates(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) of every row; the id and the text keep their names."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
        *[draw(id_column, k).alias(f"_h{k}") for k in range(1, 5)],
    )
    out = rows.mapInArrow(lambda batches: _batches(batches, rates), f"_id {kind}, _text string, {OUTPUT}")
    return out.withColumnsRenamed({"_id": id_column, "_text": text_column})


def restored(output: str = "output", form: str = "form") -> Column:
    """The text before the transformation, from the output and its form alone. No sentinel overlaps another or itself, so
    its first place after the one before it is where the transformation put it."""
    whole = F.col(output)
    first, second = F.when(F.col(form) == PSM, PREFIX).otherwise(SUFFIX), F.when(F.col(form) == PSM, SUFFIX).otherwise(PREFIX)
    body = F.substr(whole, F.length(first) + 1)
    head = F.when(F.col(form) == PSM, F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(head) + F.length(second) + 1)
    tail = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(tail) + len(MIDDLE) + 1)
    rebuilt = F.when(F.col(form) == PSM, F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
    return F.when(F.col(form) == PLAIN, whole).otherwise(rebuilt)


def digests(transformed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts, and the SHA-256 of the output and of the text restored from it."""
    return transformed.select(
        id_column, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
