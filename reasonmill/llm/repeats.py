"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of ``TRIGGER`` bytes makes about every 64th place of a text a rare trigger, and every 32nd one that counts
where no rare one is in reach; triggers cut the text into phrases
that depend on the bytes alone, so repeated text is parsed alike wherever it stands. Every window of ``LENGTH`` bytes
belongs to the first trigger in it, as the end of a phrase (a suffix of the dictionary) followed by what the parse says
next. Windows of one trigger differ only in how much of the phrase they take.

1. An occurrence of a trigger has a group (the bytes that all its windows share) and a context (all bytes of them).
   Groups are counted; what occurs once holds no repeated window and goes. This leaves the phrases that repeat.
2. Occurrences with equal contexts are one entry of the dictionary: if it has two, all its windows repeat.
3. Only groups with several contexts are looked at window by window, one occurrence per context.
4. Windows without a trigger are rare in prose; each is an entry by itself.

Equality at a fixed length needs the classes of equal suffixes, not their order, so classes are found by hash and shuffle
where a suffix array would sort them: no task sees the dictionary or the parse as a whole. (Two 64-bit hashes stand for a
context, one besides its group for a window.) Texts are identified by hash, so exact copies are one text with a count.

Defined results: NULL is empty; texts shorter than ``LENGTH`` have no window and keep all; equal rows are copies of each
other, so all of them lose what they share; an empty table gives no rows; ids may be NULL or repeat; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.blocks import MIX_1, MIX_2, Block, blocks, mix, powers, rolling, signed, span_hash
from reasonmill.llm.tables import only_near, written

LENGTH = 200
TRIGGER = 12
RIGHT = 24
PIECE = 1 << 19  # a block has some twenty numbers a byte beside it
_RARE, _OFTEN = np.uint64(58), np.uint64(59)  # a trigger is where the six, or five, upper bits of the hash are zero
_REACH = LENGTH - RIGHT  # a trigger has windows that begin at most this far before it
_NEAR = _REACH // 2  # and those that begin nearer than this are a band of their own
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROWS = "g long, c long, n int, k long, at long"


def _group(prefix: np.ndarray, at: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Hash of the bytes that all windows of a trigger's band share."""
    return span_hash(prefix, at - np.where(far, _NEAR, 0), at + np.where(far, RIGHT, LENGTH - _NEAR))


class Parse:
    """Occurrences of triggers and bare windows of a block: text, place of the trigger, first and last window start."""

    def __init__(self, block: Block):
        data, offsets = block.data, block.offsets
        prefix = self.prefix = rolling(data)
        places = max(len(data) - TRIGGER + 1, 0)
        _, down = powers(max(len(data), 1))
        hashes = (prefix[TRIGGER:TRIGGER + places] - prefix[:places]) * down[:places]
        upper = hashes * MIX_2
        at = np.flatnonzero(upper >> _OFTEN == 0)
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + TRIGGER <= offsets[text + 1]
        at, text = at[inside], text[inside]
        rare = upper[at] >> _RARE == 0
        # Windows belong to the first rare trigger they hold, without one to the first frequent one.
        begin, end = offsets[text], offsets[text + 1]
        none = len(data) + LENGTH
        rare_at = np.where(rare, at, -1)
        before = np.concatenate(([-1], np.maximum.accumulate(rare_at)[:-1])) if len(at) else at
        after = np.minimum.accumulate(np.where(rare, at, none)[::-1])[::-1]
        after = np.where(after < end, after, none)
        previous = np.concatenate(([-1], at[:-1]))[:len(at)]
        low = np.maximum(np.maximum(np.where(rare, before, previous) + 1, at - _REACH), begin)
        high = np.minimum(np.where(rare, at, np.minimum(at, after - _REACH - 1)), end - LENGTH)
        # Two bands by the distance of the trigger, so that the group key is long in both.
        at, text = np.tile(at, 2), np.tile(text, 2)
        low, high = np.concatenate([np.maximum(low, at[:len(low)] - _NEAR + 1), low]), np.concatenate(
            [high, np.minimum(high, at[:len(high)] - _NEAR)])
        some = low <= high
        at, text, low, high = at[some], text[some], low[some], high[some]
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high + 1, -1)
        starts = np.zeros(len(data) + 1, np.int64)  # where windows begin
        long = np.flatnonzero(np.diff(offsets) >= LENGTH)
        np.add.at(starts, offsets[long], 1)
        np.add.at(starts, offsets[long + 1] - LENGTH + 1, -1)
        bare = np.flatnonzero((np.cumsum(starts) > 0) & (np.cumsum(change) == 0))
        g = _group(prefix, at, at - high >= _NEAR)
        shape = ((at - low) << 8 | (high - low)).astype(np.uint64)
        c = mix(span_hash(prefix, low, high + LENGTH) + shape * MIX_1)
        half = LENGTH // 2
        bare_c = mix(span_hash(prefix, bare, bare + half) * MIX_1 + span_hash(prefix, bare + half, bare + LENGTH))
        self.g = np.concatenate([g, span_hash(prefix, bare, bare + LENGTH)])
        self.c = np.concatenate([c, bare_c])
        self.text = np.concatenate([text, np.searchsorted(offsets, bare, side="right") - 1])
        self.low, self.high = np.concatenate([low, bare]), np.concatenate([high, bare])
        self.at = np.concatenate([at, bare])
        identity = mix(self.g ^ mix(self.c ^ mix(self.text.astype(np.uint64))))
        _, self.first, self.entry, self.counts = np.unique(
            identity, return_index=True, return_inverse=True, return_counts=True)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every distinct entry of each text; texts that this task has had are left out."""
    seen: set[int] = set()
    for block in blocks(batches, size=PIECE):
        keys = block.rows.column("k").to_numpy()
        fresh = np.zeros(len(block), bool)
        for n, key in enumerate(keys.tolist()):
            fresh[n] = key not in seen
            if len(seen) < 1 << 20:
                seen.add(key)
        p = Parse(block)
        use = fresh[p.text[p.first]] if len(p.first) else np.zeros(0, bool)
        rows, text = p.first[use], p.text[p.first[use]]
        low = p.low[rows] - block.offsets[text]
        packed = low << 16 | (p.at[rows] - p.low[rows]) << 8 | (p.high[rows] - p.low[rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(p.g[rows])), pa.array(signed(p.c[rows])), pa.array(np.minimum(p.counts[use], 2).astype(np.int32)),
             pa.array(keys[text]), pa.array(packed)], names=["g", "c", "n", "k", "at"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of the wanted occurrences."""
    for block in blocks(batches, size=PIECE):
        prefix = rolling(block.data)
        wanted = block.rows.column("wanted")
        at = wanted.values.to_numpy()[wanted.offsets[0].as_py():wanted.offsets[-1].as_py()]
        text = np.repeat(np.arange(len(block)), np.diff(wanted.offsets.to_numpy()))
        low = (at >> 16) + block.offsets[text]
        count = (at & 255) + 1
        place, high = low + (at >> 8 & 255), low + (at & 255)
        group = _group(prefix, place, place - high >= _NEAR)
        each = np.repeat(np.arange(len(at)), count)
        start = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(group[each])), pa.array(signed(span_hash(prefix, start, start + LENGTH))),
             block.rows.column("k").take(pa.array(text[each])), pa.array(start - block.offsets[text[each]])],
            names=["g", "h", "k", "start"])


def removed(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows that begin in the given inclusive ranges."""
    out: list[list[int]] = []
    for low, high in sorted(starts):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + LENGTH)
        else:
            out.append([low, high + LENGTH])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without its repeated bytes; what repeats within the text is found here again."""
    for block in blocks(batches, size=PIECE):
        p = Parse(block)
        within = np.flatnonzero(p.counts[p.entry] > 1) if len(p.first) else np.zeros(0, int)
        ranges: list[list[tuple[int, int]]] = [
            [(s >> 8, (s >> 8) + (s & 255)) for s in spans] for spans in block.rows.column("spans").to_pylist()
        ]
        for n in within.tolist():
            base = int(block.offsets[p.text[n]])
            ranges[p.text[n]].append((int(p.low[n]) - base, int(p.high[n]) - base))
        rows = []
        for n, spans in enumerate(ranges):
            raw, runs = block.text_bytes(n), removed(spans)
            edges = [0, *(e for run in runs for e in run), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays(
            [block.rows.column("k"), *(pa.array([r[n] for r in rows], kind) for n, kind in
             enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))],
            names=["k", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def spans_by_text(texts: DataFrame) -> DataFrame:
    """(k, spans): for every text that shares windows with another one, or has some twice, the starts of repeated
    windows as first start * 256 + number of further ones. ``texts`` is (k, text)."""
    occurrences = texts.mapInArrow(_occurrences, ROWS)
    groups = occurrences.select("g", "n").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    repeated = written(occurrences.join(groups, "g").distinct(), "phrases")
    contexts = written(
        repeated.groupBy("g", "c").agg(F.sum("n").alias("total"), F.min("k").alias("k"), F.min("at").alias("at")), "contexts")
    whole = repeated.join(contexts.where("total > 1").select("g", "c"), ["g", "c"]).select(
        "k", ((F.shiftright("at", 16) * 256) + F.col("at").bitwiseAND(F.lit(255))).alias("span"))
    several = contexts.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    # One occurrence per context; the first by (text, place), which the two minima alone would not name.
    members = repeated.join(several, "g", "left_semi").join(
        contexts.where("total > 1").select("g", "c", F.col("k").alias("k_1")), ["g", "c"], "left"
    ).where("k_1 is null or k = k_1")
    wanted = members.groupBy("g", "c", "k").agg(F.min("at").alias("at")).groupBy("k").agg(F.collect_list("at").alias("wanted"))
    wanted = written(wanted, "wanted")  # the occurrences of one text in a row: bounded by its length
    near = only_near(texts, wanted, "k").join(wanted, "k").dropDuplicates(["k"])
    windows = written(near.mapInArrow(_windows, "g long, h long, k long, start long"), "windows")
    again = windows.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1").select("g", "h")
    single = windows.join(again, ["g", "h"]).select("k", (F.col("start") * 256).alias("span"))
    return whole.unionByName(single).distinct().groupBy("k").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, on request with kept_text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text"))
    long = rows.where(F.octet_length("text") >= LENGTH).select("k", "text")
    copies = written(long.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit(True).alias("copied")), "copies")
    spans = written(spans_by_text(long), "spans")
    partly = spans.join(copies, "k", "left_anti")
    cut = only_near(long, partly, "k").join(partly, "k").mapInArrow(
        _cut, "k long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    if not keep_text:
        cut = cut.drop("kept_text")
    cut = written(cut.dropDuplicates(["k"]), "cut")
    base = rows.select("doc_id", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"),
                       *([F.col("text")] if keep_text else []))
    joined = base.join(copies, "k", "left").join(cut, "k", "left")
    gone = F.coalesce("copied", F.lit(False))
    return joined.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit("")).otherwise(F.coalesce("kept_text", "text")).alias("kept_text")] if keep_text else []),
    )
