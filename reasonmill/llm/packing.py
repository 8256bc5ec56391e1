"""Best-fit packing of token pieces under three capacities: tokens, documents and attention cost.

A text becomes ids plus an end id. Only longer ones are cut, into pieces of the token capacity, of which the first may
be shorter. A piece needs (length, 1, length squared) of (capacity, documents, attention). Pieces of one length are
alike, so the plan is made on the histogram of lengths, which has at most ``capacity`` entries whatever the input:
lengths from large to small go to the open bins that fit under every constraint, and among those to the ones with the
least weighted norm of what is left (or the largest weighted dot product of need and residual). Bins with the same
residual are one group with a count, so a step fills many bins at once. Then every piece finds its bin by its rank among
the pieces of its length: ranks come from counts per task, so no task sees all pieces of a length.

Defined results: NULL text is an empty text and yields the end id alone; equal rows are packed separately; an empty
table gives no rows; a piece that alone exceeds the attention capacity is an error of the parameters and raises.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reasonmill.llm.tables import written

CAPACITY = 1024
PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _local long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"  # or "dot"

    def need(self, length: int) -> np.ndarray:
        """Share of each capacity that a piece takes."""
        return np.array([length / self.tokens, 1 / self.documents, length * length / self.attention])


def byte_bpe(vocabulary: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of a tokenizer file without special tokens being added. Where the rank file of the same vocabulary lies
    beside it, the ranks are used: they give the same ids some six times faster (tests compare the two)."""
    import base64

    ranks_file = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if os.path.exists(ranks_file):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [coder.encode_to_numpy(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str | None, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    import public_tokenizers

    encode = byte_bpe(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    end = np.array([end_id], np.uint32)
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    known: dict[str, list[tuple[int, int, int]]] = {}
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]
        known.clear()  # equal texts of one batch are encoded once
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            cut = known.get(text)
            if cut is None:
                ids = np.concatenate([np.asarray(encode([text])[0], np.uint32), end]).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                cut = known[text] = [
                    (a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(edges[:-1], edges[1:], strict=True)
                ]
            for n, (start, length, crc) in enumerate(cut):
                for column, value in zip(rows, (doc, n, start, length, crc), strict=True):
                    column.append(value)
        lengths = np.array(rows[3], np.int64)
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        local = np.empty(len(lengths), np.int64)
        local[order] = np.arange(len(ordered)) - np.searchsorted(ordered, ordered) + seen[ordered]
        seen += np.bincount(lengths, minlength=capacity + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
             pa.array(lengths), pa.array(rows[4], pa.int64()), pa.array(np.full(len(lengths), task, np.int64)),
             pa.array(local)],
            names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")],
        )


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = CAPACITY,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces with their ids' checksum; _task and _local number the pieces of a length within the task that made them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, vocabulary, end_id, capacity)

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, PIECE_SCHEMA)


Slot = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> list[Slot]:
    """Slots (length, first rank, end rank, first sequence, offset): the piece of rank r of the length goes to the
    sequence ``first sequence + r - first rank``.

    A group is a number of bins with the same contents, each content being (length, first rank); the residual shares of
    all groups are one matrix. A length that is too rare for all bins of a group splits it.
    """
    weights = np.array(limits.weights)
    bins: list[int] = []
    contents: list[list[tuple[int, int]]] = []
    residual = np.zeros((0, 3))
    slack = 1e-9
    for length in sorted(histogram, reverse=True):
        count, rank, need = histogram[length], 0, limits.need(length)
        if (need > 1 + slack).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity by itself")
        while count:
            fits = np.flatnonzero((residual + slack >= need).all(axis=1))
            if len(fits):
                left = residual[fits] - need
                score = left * left @ weights if limits.rule == "norm" else -(residual[fits] * need) @ weights
                at = int(fits[np.argmin(score)])
                taken = min(bins[at], count)
                if taken < bins[at]:  # the other bins stay as they are, as a group of their own
                    bins.append(bins[at] - taken)
                    contents.append([(n, first + taken) for n, first in contents[at]])
                    residual = np.vstack([residual, residual[at]])
                    bins[at] = taken
                contents[at].append((length, rank))
                residual[at] -= need
                count, rank = count - taken, rank + taken
            else:
                # New bins take as many of this length as a bin can; the last one takes what is over.
                per = int(np.floor((1 / need).min() + slack))
                new, per = (count // per, per) if count >= per else (1, count)
                bins.append(new)
                contents.append([(length, rank + k * new) for k in range(per)])
                residual = np.vstack([residual, np.ones(3) - need * per])
                count, rank = count - new * per, rank + new * per
    slots, sequence = [], 0
    for n, inside in zip(bins, contents, strict=True):
        offset = 0
        for length, first in inside:
            slots.append((length, first, first + n, sequence, offset))
            offset += length
        sequence += n
    return sorted(slots)


_RANK_BITS = 48


def _placed(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (slots[:, 0] << _RANK_BITS) + slots[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("_rank").to_numpy()
        at = np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1
        sequence = slots[at, 3] + rank - slots[at, 1]
        keep = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(sequence), pa.array(slots[at, 4])],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str | None = None, end_id: int = 2,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, end_id, limits.tokens, id_column, text_column), "pieces")
    counts = cut.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    # One row per task and length: the window of a length has as many rows as there are tasks.
    before = Window.partitionBy("length").orderBy("_task")
    starts = written(counts.select("_task", "length", "_n", (F.sum("_n").over(before) - F.col("_n")).alias("_before")), "ranks")
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    slots = np.array(plan(histogram, limits), np.int64).reshape(-1, 5)
    ranked = cut.join(starts.drop("_n"), ["_task", "length"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(lambda batches: _placed(batches, slots), schema)
