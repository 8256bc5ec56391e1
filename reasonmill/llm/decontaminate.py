"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, A-Z lower-cased. A text and a test item meet when they share a seed of five words,
found by running Karp-Rabin hashes. Then the longest match of both that is not yet marked is marked as a tile, again and
again, until none of five words is left; matches may come in any order, so reordered passages count. A text is
contaminated by an item when tiles cover at least ``COVERAGE`` of the item's words.

The items are a stated query set: they are broadcast in blocks of bounded size, and every block scans all texts, so a
larger benchmark takes more passes, not more memory. A scan needs no shuffle.

Defined results: NULL and empty texts and texts of fewer than five words are clean; items of fewer than five words or
NULL are not looked for, one without an id is reported with a NULL id; equal items and equal texts are each reported; ties between matches of one length go to the
first place in the item, then in the text; an empty benchmark leaves everything clean. Other columns pass unread.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.blocks import LOWER, SHINGLE, Block, blocks, shingles

COVERAGE = 0.5
BLOCK_BYTES = 8 << 20  # of item texts in one broadcast

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return block.word_hashes(space=_BREAK, lower=LOWER)


@dataclass
class Items:
    """Test items of one block: their words, and the places of every seed, sorted by hash."""

    ids: pa.Array  # NULL where an item has no id
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    first: np.ndarray  # of each seed in ``places``, one more at the end
    places: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        texts = pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in rows], pa.string())], names=["text"])
        block = next(blocks(iter([texts]), size=1 << 62), None)
        if block is None:
            empty = np.zeros(0, np.int64)
            return cls(pa.array([], pa.int64()), empty.astype(np.uint64), np.zeros(1, np.int64), empty.astype(np.uint64), np.zeros(1, np.int64), empty)
        words, bounds = _tokens(block)
        seeds, at = _seeds(words, bounds)
        order = np.argsort(seeds, kind="stable")
        distinct, first = np.unique(seeds[order], return_index=True)
        return cls(pa.array([i for i, _ in rows], pa.int64()), words, bounds, distinct, np.append(first, len(seeds)), at[order])


def _seeds(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words, and the word where each begins."""
    hashes, runs = shingles(words, bounds)
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), np.diff(runs))
    at = bounds[:-1][text] + np.arange(len(hashes)) - runs[:-1][text]
    whole = counts[text] >= SHINGLE
    return hashes[whole], at[whole]


def tiles(text_at: np.ndarray, item_at: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiling (text place, item place, words) from the places of shared seeds."""
    diagonal = text_at - item_at
    order = np.lexsort((item_at, diagonal))
    d, i = diagonal[order], item_at[order]
    starts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1))))
    lengths = np.diff(np.append(starts, len(d))) + SHINGLE - 1
    # Maximal matches, longest first.
    queue = [(-int(n), int(i[s]), int(i[s] + d[s])) for s, n in zip(starts, lengths, strict=True)]
    heapq.heapify(queue)
    used_text: set[int] = set()
    used_item: set[int] = set()
    found = []
    while queue:
        length, item, text = heapq.heappop(queue)
        free = [item + k not in used_item and text + k not in used_text for k in range(-length)]
        if all(free):
            found.append((text, item, -length))
            used_item.update(range(item, item - length))
            used_text.update(range(text, text - length))
            continue
        run = 0
        for k, ok in enumerate([*free, False]):  # what is left of it goes back, if long enough
            if ok:
                run += 1
            else:
                if run >= SHINGLE:
                    heapq.heappush(queue, (-run, item + k - run, text + k - run))
                run = 0
    return found


def matches(block: Block, items: Items, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, coverage, tiles, longest tile) of the contaminated texts of a block."""
    words, bounds = _tokens(block)
    seeds, at = _seeds(words, bounds)
    if not len(seeds) or not len(items.seeds):
        return
    found = np.minimum(np.searchsorted(items.seeds, seeds), len(items.seeds) - 1)
    hit = np.flatnonzero(items.seeds[found] == seeds)
    if not len(hit):
        return
    found, at = found[hit], at[hit]
    per = items.first[found + 1] - items.first[found]
    text_at = np.repeat(at, per)
    item_at = items.places[np.repeat(items.first[found], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)]
    text = np.searchsorted(bounds, text_at, side="right") - 1
    item = np.searchsorted(items.bounds, item_at, side="right") - 1
    order = np.lexsort((item, text))
    text, item, text_at, item_at = text[order], item[order], text_at[order], item_at[order]
    edge = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]))))
    for a, b in zip(edge, [*edge[1:], len(text)], strict=True):
        size = items.bounds[item[a] + 1] - items.bounds[item[a]]
        # Tiles cannot cover more than the words below any seed, so few distinct seeds need no tiling.
        if min(len(np.unique(item_at[a:b])) * SHINGLE, size) < coverage * size:
            continue
        tiled = tiles(text_at[a:b], item_at[a:b])
        share = sum(t[2] for t in tiled) / size
        if share >= coverage:
            yield int(text[a]), int(item[a]), float(share), len(tiled), max(t[2] for t in tiled)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes``, dealt by hash; each is read on its own."""
    named = benchmark.select("item_id", "text").where("text is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(size) // block_bytes)
    for k in range(n):
        part = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else named
        yield Items.of(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of every contaminated document and the item it holds."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int"
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                rows = list(matches(block, shared.value, coverage))
                ids = block.rows.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, shared.value.ids.take(pa.array([r[1] for r in rows], pa.int64())),
                     *(pa.array([r[n] for r in rows], kind) for n, kind in ((2, pa.float64()), (3, pa.int32()), (4, pa.int32())))],
                    names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that no test item contaminates."""
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text_column):
                bad = {r[0] for r in matches(block, shared.value, coverage)}
                yield block.rows.take(pa.array([n for n in range(len(block)) if n not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
