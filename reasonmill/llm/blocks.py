"""Whole texts in blocks of bytes: words, shingles and their hashes, computed with NumPy inside Arrow tasks.

A task never holds more than one Arrow batch, which Spark cuts by bytes, and works on blocks of about ``BLOCK`` bytes
(one text is never cut, so a longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK = 2 << 20
BATCH_BYTES = "8m"
SHINGLE = 5

# Odd multipliers of the rolling hashes and of the finaliser (all arithmetic is modulo 2^64).
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Blanks of the word rule: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as by rows, unless the user has chosen a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf._jconf.contains(key):
        spark.conf.set(key, BATCH_BYTES)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits; a bijection, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK // 4, 0 if have is None else 2 * len(have))
        for name, base in (("up", int(BASE)), ("down", _inverse(int(BASE)))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums P of the rolling hash: the hash of [s, e) is (P[e] - P[s]) * BASE^-s."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


class Block:
    """Some whole texts: their bytes one after another, and where each begins."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text_bytes(self, n: int) -> bytes:
        return self.data[self.offsets[n]:self.offsets[n + 1]].tobytes()

    def words(self, space: np.ndarray = SPACE, lower: np.ndarray = LOWER) -> tuple[np.ndarray, ...]:
        """Start and end of every word, and the index of the first word of each text (one more at the end)."""
        blank = space[self.data]
        begins = np.zeros(len(self.data) + 1, bool)
        begins[self.offsets] = True
        before = np.empty_like(blank)
        before[:1] = True
        before[1:] = blank[:-1]
        after = np.empty_like(blank)
        after[-1:] = True
        after[:-1] = blank[1:]
        starts = np.flatnonzero(~blank & (before | begins[:-1]))
        ends = np.flatnonzero(~blank & (after | begins[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, space: np.ndarray = SPACE, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, bounds = self.words(space)
        return span_hash(rolling(lower[self.data]), starts, ends), bounds


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; NULL is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[Block]:
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield Block(
                batch.slice(first, last - first), data[offsets[first]:offsets[last]],
                offsets[first:last + 1] - offsets[first],
            )
            first = last


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and where the runs of each text begin. A text with fewer words has one run,
    of all its words; one without words has none."""
    counts = np.diff(bounds)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(runs)))
    texts = np.repeat(np.arange(len(counts)), runs)
    at = bounds[:-1][texts] + (np.arange(out_bounds[-1]) - out_bounds[:-1][texts])
    length = np.minimum(counts, size)[texts]
    out = length.astype(np.uint64)
    for j in range(size):
        inside = length > j
        step = np.where(inside, words[np.minimum(at + j, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else out[:0]
        out = np.where(inside, out * WORD_BASE + step, out)
    return mix(out), out_bounds


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)
