"""Cross-entropy difference: how much better a target model predicts a text than a background model does.

Both are bigram models over words (as in the shingle operators) with one vocabulary: every word of all documents, and one
unknown word for what no document holds. The background counts all documents, the target those rated well (quality 1,
toxic 0). The models are matched: same order, same bigrams, same smoothing, and background counts scaled to the target's
number of tokens. p(w | h) = (c(h, w) + m p(w)) / (c(h) + m), with add-one unigrams below.

Counts cover every text, and all words and bigrams stay in the model, so it grows with the corpus. Only its head is
broadcast: the ``size`` most frequent words, and the bigrams of those that rank high, at most ``2^head_bits``. Every other
token goes to a bucket, where those of one bigram meet, as do all bigrams that end with one word outside the head: a
bucket counts them and sends back what they add to each text. So tokens are dealt once and sums of texts once; no table of
bigrams is written or joined. A bigram or word that is not in the head is a small share of all tokens, so no key is hot. The
sizes of the head change no result.

Tokens travel by block of texts and bucket, packed: a bigram as the place of its second word and 40 bits of a hash, a word
outside the head as 47 bits and the word before it as 48. The bucket, chosen by other bits of the hash, tells apart more. A
block is named by a hash of its rows; if some are read again in another order, the sums don't add up and the job fails.

Defined results: a NULL text and one without words has no tokens and NULL losses; rows are scored each by itself; a
rating without document and a document without rating are ignored by the target; without any target the target model is
uniform over the vocabulary; ties in frequency go to the smaller hash. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.blocks import WORD_BASE, Block, blocks, mix, signed, unsigned, utf8
from reasonmill.llm.tables import written

VOCABULARY = 1 << 15  # words of the head
HEAD_BITS = 20
SMOOTHING = 50.0
# What buckets add to a loss is summed in whole steps of this size, so that the order of a sum is no matter.
STEP = 2.0**-26
_FLUSH = 1 << 20
_WORD = 1 << 62
_ROWS = 1 << 15  # texts of a block at most
_TOKENS = 1 << 21  # tokens of the corpus for one bucket
_CELLS = 1 << 16
_BITS = 1 << 27
_PREVIOUS, _OUTSIDE = 5, 6  # bytes that a bigram's hash and a word outside the head are known by within a bucket


class Counts:
    """Counts of keys within a task, handed on whenever there are many."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        some, n = np.unique(keys, return_counts=True)
        self.keys, back = np.unique(np.concatenate([self.keys, some]), return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, n]), len(self.keys)).astype(np.int64)

    def flush(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(signed(self.keys)), pa.array(self.counts)], names=["key", "n"])
        self.__init__()
        return out


def word_ids(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """61 bits of the hash of every word, as an even number from 2^62, and where texts begin."""
    hashes, bounds = block.word_hashes()
    return ((hashes >> np.uint64(3)) << np.uint64(1)) | np.uint64(_WORD), bounds


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[np.ndarray, int]:
    """Ids of the most frequent words, these first, and the number of all different words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for block in blocks(batches):
            counts.add(word_ids(block)[0])
            if len(counts.keys) > _FLUSH:
                yield counts.flush()
        yield counts.flush()

    words = written(docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    top = words.orderBy(F.desc("n"), "key").limit(size).toArrow()
    return unsigned(top.column("key").to_numpy()), words.count()


@dataclass
class Bigrams:
    """The bigrams of some texts. ``now`` and ``before`` are places of head words (0: not of the head; before the first
    word: len + 1); ``bounds`` says where texts begin."""

    ids: np.ndarray
    now: np.ndarray
    before: np.ndarray
    previous: np.ndarray  # hash of the word before
    last: np.ndarray  # whether a word ends its text
    bounds: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def bigrams(block: Block, words: np.ndarray) -> Bigrams:
    ids, bounds = word_ids(block)
    if len(words):
        at = np.minimum(np.searchsorted(words, ids), len(words) - 1)
        now = np.where(words[at] == ids, at + 1, 0)
    else:
        now = np.zeros(len(ids), np.int64)
    before = np.concatenate(([0], now[:-1]))[:len(now)]
    id_before = np.concatenate((np.zeros(1, np.uint64), ids[:-1]))[:len(ids)]
    some = np.diff(bounds) > 0
    starts = bounds[:-1][some]
    before[starts] = len(words) + 1
    id_before[starts] = 1  # no word has it
    last = np.zeros(len(ids), bool)
    last[bounds[1:][some] - 1] = True
    return Bigrams(ids, now, before, mix(id_before), last, bounds)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers: a bit each for those above 0, then the low bytes of these, then the next ones, as far as any has some."""
    some = np.ascontiguousarray(values, np.uint64)
    above = some > 0
    some = some[above]
    width = (int(some.max(initial=0)).bit_length() + 7) // 8
    return np.packbits(above).tobytes() + some.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    bits = (n + 7) // 8
    above = np.unpackbits(np.frombuffer(data, np.uint8, bits), count=n).astype(bool)
    if len(data) > bits:
        planes = np.frombuffer(data, np.uint8, offset=bits).reshape(-1, int(above.sum()))
        some = np.zeros((planes.shape[1], 8), np.uint8)
        some[:, :len(planes)] = planes.T
        out[above] = some.view(np.int64)[:, 0]
    return out


def _steps_up(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^21 that don't fall between two bounds: their increases, in bytes of 7 bits, and the bounds of these."""
    up = np.diff(values.astype(np.int64), prepend=0)
    starts = bounds[:-1][np.diff(bounds) > 0]
    up[starts] = values[starts]
    width = 1 + (up >= 1 << 7) + (up >= 1 << 14)
    ends = np.concatenate(([0], np.cumsum(width)))
    out = np.empty(ends[-1], np.uint8)
    for k in range(3):
        some = width > k
        out[ends[:-1][some] + k] = up[some] >> 7 * k & 127 | (width[some] > k + 1) << 7
    return out, ends[bounds]


def _from_steps_up(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``bounds`` are those of the numbers."""
    ends = np.flatnonzero(data < 128)
    width = np.diff(ends, prepend=-1)
    up = np.zeros(len(ends), np.int64)
    for k in range(3):
        some = width > k
        up[some] |= (data[ends[some] - width[some] + 1 + k].astype(np.int64) & 127) << 7 * k
    total = np.cumsum(up)
    n = np.diff(bounds)
    starts = bounds[:-1][n > 0]
    return total - np.repeat(total[starts] - up[starts], n[n > 0])


def _low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]


def _from_bytes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view(np.uint64)[:, 0]


def _widths(n: int, most: int) -> np.ndarray:
    """How many second words, the most frequent first, make a bigram of the head with the start of a text, with each of
    ``n`` words, the most frequent first, and with any other word (0). Half of ``most`` is a square, so that no bigram of
    frequent words is left to one bucket; as the product of two ranks bounds how frequent a pair is, the rest is even in that."""
    rank = np.arange(1, n + 2)
    side = int((most // 2) ** 0.5)
    low, high = 0, most + 1  # of the products

    def widths(product: int) -> np.ndarray:
        return np.minimum(np.maximum(product // rank, np.where(rank <= side, side, 0)), n)

    while high - low > 1:
        product = (low + high) // 2
        low, high = (product, high) if widths(product).sum() <= most else (low, product)
    return np.append(widths(low), 0)


def _cells(docs: DataFrame, words: np.ndarray, rank: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Counts in rated and in all texts: bigrams of the head, a row a first word; words of the head by place; ends of texts
    by the place of their last word. Place 0 is any other word. ``rank`` is that of the word at a place, from 1."""
    shared = docs.sparkSession.sparkContext.broadcast((words, rank, widths))
    places, pairs = len(words) + 2, int(widths.sum())
    size = pairs + 2 * places

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank, widths = shared.value
        starts_of_rows = np.cumsum(widths) - widths
        total = np.zeros((2, size), np.int64)
        for block in blocks(batches):
            b = bigrams(block, words)
            good = block.rows.column("good").to_numpy(zero_copy_only=False).astype(bool)[b.texts]
            first, second = rank[b.before], rank[b.now] - 1
            pair = (b.now > 0) & (second < widths[first])
            for cell, rated in (((starts_of_rows[first] + second)[pair], good[pair]), (pairs + b.now, good),
                                ((pairs + places + b.now)[b.last], good[b.last])):
                total[0] += np.bincount(cell[rated], minlength=size)
                total[1] += np.bincount(cell, minlength=size)
        starts = range(0, size, _CELLS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(starts), pa.int64()), *[pa.array([_planes(total[k, s:s + _CELLS]) for s in starts], pa.binary()) for k in (0, 1)]],
            names=["start", "t", "b"])

    def add(table: pa.Table) -> pa.Table:
        start = table.column("start")[0].as_py()
        total = np.zeros((2, min(_CELLS, size - start)), np.int64)
        for k, name in enumerate("tb"):
            for data in table.column(name):
                total[k] += _from_planes(data.as_py(), total.shape[1])
        some = np.flatnonzero(total[1])
        return pa.table({"cell": start + some, "t": total[0, some], "b": total[1, some]})

    rows = docs.mapInArrow(count, "start long, t binary, b binary").groupBy("start").applyInArrow(
        add, "cell long, t long, b long").toArrow()
    out = np.zeros((size, 2))
    out[rows.column("cell").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in "tb"], axis=1)
    return out


_PART = """bucket int, block long, counted boolean, heads binary, head_texts binary, others binary, other_texts binary,
    sent int, ids array<long>, tokens array<long>, target array<double>, background array<double>"""
_ANSWER = """block long, n int, texts binary, target_steps binary, background_steps binary,
    sent int, ids array<long>, tokens array<long>, target array<double>, background array<double>"""
_BASE = ["sent", "ids", "tokens", "target", "background"]


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of the rows of ``values`` between the bounds."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = pa.py_buffer((bounds * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


@dataclass
class Model:
    """Shared vocabulary and bigrams; a column each for target (0) and background (1). ``docs`` are the counted texts, which
    hold the rest of the model: other bigrams and words."""

    words: np.ndarray  # ids of the head words
    keys: np.ndarray
    pairs: np.ndarray  # log p of each bigram of the head
    singles: np.ndarray  # log p of each head word; first that of an unknown word
    rest: np.ndarray  # log of the share that the unigram gets after each head word; first that after an unknown word
    totals: np.ndarray  # tokens
    scale: np.ndarray
    n_words: int
    smoothing: float
    buckets: int
    docs: DataFrame | None = None
    rated: DataFrame | None = None  # the same, with ``good``

    def single(self, count: np.ndarray) -> np.ndarray:
        return np.log((count * self.scale + 1) / (self.totals * self.scale + self.n_words + 1))

    def after(self, count: np.ndarray) -> np.ndarray:
        return np.log(self.smoothing / (count * self.scale + self.smoothing))

    def above(self, count: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How much a bigram lies above the unigram that it would fall back to."""
        return np.log(count * self.scale / self.smoothing + np.exp(low)) - low

    @property
    def width(self) -> int:
        """Bytes of a bigram whose second word is of the head: the hash, then the place."""
        return _PREVIOUS + max(1, (len(self.words).bit_length() + 7) // 8)

    def known(self, b: Bigrams) -> tuple[np.ndarray, np.ndarray]:
        """Whether each bigram is of the head, and the sum of its losses up to each token, without what buckets add."""
        log = self.rest[b.before]
        log[b.now > 0] += self.singles[b.now[b.now > 0]]
        known = np.zeros(len(b.ids), bool)
        if len(self.keys):
            key = (b.before.astype(np.uint64) << np.uint64(32)) | b.now.astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            log[known] = self.pairs[at[known]]
        return known, np.vstack([np.zeros((1, 2)), np.cumsum(-log, axis=0)])

    def part(self, block: Block, counted: bool, scored: bool) -> pa.RecordBatch:
        """The tokens of a block that buckets must count or score, a row a bucket; one row takes along the losses so far."""
        b = bigrams(block, self.words)
        known, losses = self.known(b)
        good = np.zeros(len(block), bool)
        if counted:
            good = block.rows.column("good").to_numpy(zero_copy_only=False).astype(bool)
        texts = b.texts << 1 | good[b.texts]
        pair = mix(b.previous * WORD_BASE + b.ids)
        columns, rows = [], np.zeros(self.buckets, np.int64)
        for some, spread, low in (
            (~known & (b.now > 0), pair, None), (b.now == 0, mix(b.ids), b.last),
        ):
            bucket = ((spread[some] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.uint32)
            if self.buckets <= 1 << 16:
                bucket = bucket.astype(np.uint16)  # sorted in linear time
            order = np.flatnonzero(some)[np.argsort(bucket, kind="stable")]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=self.buckets))))
            if low is None:
                place = b.now[order].astype(np.uint64) << np.uint64(8 * _PREVIOUS)
                data = _low_bytes(pair[order] & np.uint64((1 << 8 * _PREVIOUS) - 1) | place, self.width)
            else:
                data = np.hstack([_low_bytes(b.ids[order] | low[order], _OUTSIDE), _low_bytes(b.previous[order], _OUTSIDE)])
            columns += [_cut(data, bounds), _cut(*_steps_up(texts[order], bounds))]
            rows += np.diff(bounds)
        name, base = 0, [pa.nulls(self.buckets, t) for t in (pa.int32(), *[pa.list_(t) for t in (pa.int64(),) * 2 + (pa.float64(),) * 2])]
        if scored:
            ids = block.rows.column("doc_id")
            stamp = hashlib.blake2b(block.data, digest_size=8)
            stamp.update(block.offsets)
            stamp.update(repr(ids.to_pylist()).encode())
            name = int.from_bytes(stamp.digest(), "little")
            bearer = name % self.buckets
            sums = losses[b.bounds[1:]] - losses[b.bounds[:-1]]
            rows[bearer] += 1
            one = [int((rows > 0).sum()), ids, np.diff(b.bounds), sums[:, 0], sums[:, 1]]
            base = [pa.concat_arrays([x[:bearer], pa.array([y], x.type), x[bearer + 1:]]) for x, y in zip(base, one, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(self.buckets, dtype=np.int32)), pa.array(np.full(self.buckets, np.uint64(name)).view(np.int64)),
             pa.array(np.full(self.buckets, counted)), *columns, *base],
            names=[f.strip().split()[0] for f in _PART.split(",")],
        ).filter(pa.array(rows > 0))

    def read(self, table: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]:
        """Of one bucket, for bigrams that end with a head word and for other words: row and text of each token, what it
        adds in steps, and the different keys with what these add."""
        counted = table.column("counted").to_numpy()

        def column(name: str) -> tuple[np.ndarray, np.ndarray]:
            return utf8(table.column(name).combine_chunks())

        def tokens(name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            data, bounds = column(name)
            row = np.repeat(np.arange(table.num_rows), np.diff(bounds) // width)
            text = _from_steps_up(column(f"{name.removesuffix('s')}_texts")[0], bounds // width)
            return data, row, text >> 1, np.stack([counted[row] & (text & 1 > 0), counted[row]], axis=1)

        def counts(at: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(at, weights[:, k], n) for k in (0, 1)], axis=1)

        def steps(log: np.ndarray) -> np.ndarray:
            return np.rint(log / STEP).astype(np.int64)

        data, row, text, one = tokens("heads", self.width)
        keys, at = np.unique(_from_bytes(data, self.width), return_inverse=True)
        place = (keys >> np.uint64(8 * _PREVIOUS)).astype(np.int64)
        add = steps(self.above(counts(at, len(keys), one), self.singles[place]))
        heads = row, text, add[at], keys, add

        data, row, text, one = tokens("others", 2 * _OUTSIDE)
        data = data.reshape(-1, 2 * _OUTSIDE)
        ids = _from_bytes(data[:, :_OUTSIDE].ravel(), _OUTSIDE)
        last = (ids & np.uint64(1)) > 0
        words, at = np.unique(ids & ~np.uint64(1), return_inverse=True)
        previous, before = np.unique(_from_bytes(data[:, _OUTSIDE:].ravel(), _OUTSIDE), return_inverse=True)
        both, pair = np.unique(at * max(1, len(previous)) + before, return_inverse=True)
        word = both // max(1, len(previous))
        n = counts(at, len(words), one)
        low = self.single(n)
        rest = steps(self.after(n - counts(at, len(words), one * last[:, None])))
        above, low_steps = steps(self.above(counts(pair, len(both), one), low[word])), steps(low)
        add = above[pair] + low_steps[at] + np.where(last[:, None], 0, rest[at])
        others = row, text, add, both, above + low_steps[word]
        return heads, others

    def answer(self, table: pa.Table) -> pa.Table:
        """What one bucket adds to the losses of each text, a row a block."""
        parts = self.read(table)
        named = table.column("block").to_numpy() != 0
        scored = np.flatnonzero(named)
        at = np.concatenate([(row * _ROWS + text)[named[row]] for row, text, *_ in parts])
        some, back = np.unique(at, return_inverse=True)
        sums = np.stack([
            np.bincount(back, np.concatenate([add[named[row], k] for row, _, add, *_ in parts]), len(some)).astype(np.int64)
            for k in (0, 1)])
        folded = ((sums << 1) ^ (sums >> 63)).view(np.uint64)
        bounds = np.searchsorted(some, np.append(scored, table.num_rows) * _ROWS)
        out = table.take(pa.array(scored))
        return pa.table([
            out.column("block"), pa.array(np.diff(bounds).astype(np.int32)), _cut(*_steps_up(some % _ROWS, bounds)),
            *[pa.array([_planes(folded[k, s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for k in (0, 1)], *[out.column(c) for c in _BASE],
        ], names=["block", "n", "texts", "target_steps", "background_steps", *_BASE])

    def parts(self, docs: DataFrame, counted: bool, scored: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(replace(self, docs=None, rated=None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                for s in range(0, len(block), _ROWS):
                    bounds = block.offsets[s:s + _ROWS + 1]
                    yield shared.value.part(
                        Block(block.rows.slice(s, _ROWS), block.data[bounds[0]:bounds[-1]], bounds - bounds[0]), counted, scored)

        return docs.mapInArrow(run, _PART)

    @property
    def tail(self) -> DataFrame:
        """(bucket, key, target, background): in steps, what bigrams outside the head add; keys tell apart those of a bucket."""
        shared = self.docs.sparkSession.sparkContext.broadcast(replace(self, docs=None, rated=None))

        def run(table: pa.Table) -> pa.Table:
            (*_, a, x), (*_, b, y) = shared.value.read(table)
            add = np.concatenate([x, y])
            key = np.concatenate([signed(a), -1 - b])
            bucket = pa.repeat(table.column("bucket")[0], len(key))
            return pa.table([bucket, pa.array(key), *[pa.array(add[:, k]) for k in (0, 1)]],
                            names=["bucket", "key", "target", "background"])

        return self.parts(self.rated, True, False).groupBy("bucket").applyInArrow(
            run, "bucket int, key long, target long, background long")


def _rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, good), without dealing texts by id: a broadcast bit map of hashed ids finds the texts that may be rated
    well, and the few ids that only share a bit are looked up by a join of ids alone."""
    docs = docs.select("doc_id", "text")
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_BITS))
    number, bit = F.bitmap_bucket_number(place).alias("number"), F.bitmap_bit_position(place).alias("bit")
    bits = good.select(number, bit).groupBy("number").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def marked(some: DataFrame) -> DataFrame:
        byte = "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
        near = F.expr(f"doc_id is not null and bits is not null and (shiftright({byte}, cast(bit % 8 as int)) & 1) = 1")
        return some.select("*", number, bit).join(F.broadcast(bits), "number", "left").select(*some.columns, near.alias("near"))

    alike = written(marked(docs.select("doc_id")).where("near").select("doc_id").distinct().join(good, "doc_id", "left_anti"), "alike")
    return marked(docs).join(alike.withColumn("alike", F.lit(True)), "doc_id", "left").select(
        "doc_id", "text", (F.col("near") & F.col("alike").isNull()).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, size: int = VOCABULARY, head_bits: int = HEAD_BITS,
        smoothing: float = SMOOTHING) -> Model:
    order, n_words = vocabulary(docs, size)
    words = np.sort(order)
    rated = _rated(docs, labels)
    places, end = len(words) + 2, len(words) + 1
    place = np.append(end, np.searchsorted(words, order) + 1)  # by rank; 0 is before the first word
    rank = np.full(places, len(words) + 1)
    rank[place] = np.arange(len(place))
    widths = _widths(len(words), 1 << head_bits)
    cells = _cells(rated, words, rank, widths)
    n_pairs = int(widths.sum())
    singles, ends = cells[n_pairs:].reshape(2, places, 2)
    totals = singles.sum(axis=0)
    scale = np.array([1.0, totals[0] / totals[1] if totals[0] and totals[1] else 1.0])
    after = singles - ends
    after[end] = ends.sum(axis=0)
    singles[0] = after[0] = 0
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(totals[1]) // _TOKENS + 1)
    none = np.zeros(0, np.uint64)
    model = Model(words, none, np.zeros((0, 2)), singles, after, totals, scale, n_words, smoothing, buckets, docs, rated)
    model = replace(model, singles=model.single(singles), rest=model.after(after))
    some = np.flatnonzero(cells[:n_pairs, 1])
    starts = np.cumsum(widths) - widths
    first = np.searchsorted(starts, some, side="right") - 1
    before, now = place[first], place[some - starts[first] + 1]
    low = model.singles[now]
    pairs = model.above(cells[some], low) + low + model.rest[before]
    keys = (before.astype(np.uint64) << np.uint64(32)) | now.astype(np.uint64)
    at = np.argsort(keys)
    return replace(model, keys=keys[at], pairs=pairs[at])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score); score is the difference, lower is nearer the target.

    The texts that the model has counted are counted and scored at once; others meet them in the buckets."""
    if docs is model.docs and (id_column, text_column) == ("doc_id", "text"):
        wanted = model.rated.withColumn("doc_id", F.col("doc_id").cast("long"))
        parts = model.parts(wanted, True, True)
    else:
        wanted = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        parts = model.parts(wanted, False, True).unionAll(model.parts(model.rated, True, False))
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, docs=None, rated=None))

    def answer(table: pa.Table) -> pa.Table:
        return shared.value.answer(table)

    def total(table: pa.Table) -> pa.Table:
        sent = table.column("sent").drop_null()
        copies = len(sent)  # equal blocks have one name; all get the same sums
        if not copies or table.num_rows != copies * sent[0].as_py():
            raise RuntimeError("the texts came in another order when they were read again; write them first")
        base = table.filter(table.column("sent").is_valid()).select(_BASE[1:])
        ids, tokens, *losses = (pc.list_flatten(base.column(c)).combine_chunks() for c in _BASE[1:])
        n = len(ids) // copies
        sums = np.zeros((2, n), np.int64)
        counts = table.column("n").to_numpy()
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = _from_steps_up(utf8(table.column("texts").combine_chunks())[0], ends)
        for k, name in enumerate(("target_steps", "background_steps")):
            steps = table.column(name)
            for r, count in enumerate(counts):
                x = _from_planes(steps[r].as_py(), int(count))
                sums[k, at[ends[r]:ends[r + 1]]] += (x >> 1) ^ -(x & 1)
        tokens = tokens.to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = [(x.to_numpy() - np.tile(sums[k] // copies, copies) * STEP) / tokens for k, x in enumerate(losses)]
        empty = tokens == 0
        out = [pa.array(x, mask=empty) for x in (*mean, mean[0] - mean[1])]
        return pa.table([ids, pa.array(tokens), *out], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return parts.groupBy("bucket").applyInArrow(answer, _ANSWER).groupBy("block").applyInArrow(
        total, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
