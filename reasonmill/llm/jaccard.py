"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

1. Every text becomes a sorted array of 64-bit shingle hashes. Texts with equal sets are one class (key and size).
2. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of either, in any order common to all. The
   order used puts frequent shingles last (by a count sketch of fixed size over the whole corpus, ties by hash), so
   passages that many texts share rarely make texts meet. Shingles of prefixes are counted; those that meet nothing go.
3. Classes that share a prefix shingle and a size band make a tile. First every class of a tile meets only one, the one
   with the fewest rarer shingles before the shared one (a star): a text that was copied with changes has none, its
   copies have those of their changes, so a tile of g near copies costs g pairs, not g squared, and they meet the
   original. Pairs are bounded from above by the bit counts of hashed bitmaps, then decided by exact intersection of the
   sorted arrays. Links merge components.
4. Then only pairs of classes that share a prefix shingle and are still in different components remain, and of these the
   ones whose places leave room: at the first shingle that two sets share, at place i of n and j of m in the common
   order, they share at most min(n - i, m - j). They are bounded and decided in the same way, so no link between
   components is lost.

Defined results: words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a text of fewer than five words
is one shingle; NULL and empty texts have no shingle, link with nothing and are their own component; equal rows link; a
NULL doc_id takes part like others and has component NULL only if nothing else is in it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.blocks import blocks, shingles, signed
from reasonmill.llm.tables import components, only_near, unused, written

SIMILARITY = 80  # per cent
SKETCH_BITS = 20
SLICES = 64  # parts in which the sketches of all tasks are added up
NARROWEST, WIDEST = 9, 16  # bits of a bitmap: two to the power of


def _sets(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the sorted distinct shingle hashes of each text."""
    for block in blocks(batches, column):
        words, bounds = block.word_hashes()
        hashes, runs = shingles(words, bounds)
        yield block.rows, [np.unique(hashes[a:b]) for a, b in zip(runs[:-1], runs[1:], strict=True)]


def _key(s: np.ndarray) -> int:
    """Stands for a set, together with its size: a sum of hashes under two mixings."""
    with np.errstate(over="ignore"):
        low = np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15))
        total = s.sum() ^ (low >> np.uint64(7)) ^ (low << np.uint64(29))
    return int(np.uint64(total).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, sets in _sets(batches):
        if sets:
            flat = np.concatenate(sets)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    width = len(counts) // SLICES
    for n in range(SLICES):
        part = counts[n * width:(n + 1) * width]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["slice", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the parts of one slice, batch by batch; its logarithm in quarters fits a byte."""
    number, total = 0, None
    for batch in batches:
        for n, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(raw, "<i8")
            number, total = n, part.copy() if total is None else total + part
    if total is not None:
        level = np.minimum(np.log2(total + 1.0) * 4, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """How frequent the shingles of each hash range are: a sketch of fixed size over all texts, one byte an entry."""
    parts = docs.select("text").mapInArrow(_sketch, "slice long, counts binary")
    added = parts.groupBy("slice").applyInArrow(_add_up, "slice long, levels binary")
    levels = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for row in added.collect():  # SLICES rows, a megabyte in all
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


def _summaries(batches: Iterator[pa.RecordBatch], levels: np.ndarray, similarity: int) -> Iterator[pa.RecordBatch]:
    """Key and size of the set of every row; the prefix and the bitmap of each set once a task at least."""
    seen: set[int] = set()
    for rows, sets in _sets(batches):
        keys, tokens, bitmaps = [], [], []
        for s in sets:
            key = _key(s) if len(s) else None
            keys.append(key)
            if key is None or key in seen:  # equal sets have equal prefixes: one of a task will do
                tokens.append(np.zeros(0, np.uint64))
                bitmaps.append(None)
                continue
            if len(seen) < 1 << 20:
                seen.add(key)
            length = len(s) - -(-similarity * len(s) // 100) + 1
            order = np.argsort(levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
            tokens.append(s[order[:length]])
            bitmaps.append(_bitmap(s))
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("mark"), pa.array(keys, pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(tokens)))),
             pa.array(bitmaps, pa.binary())],
            names=["doc_id", "mark", "key", "size", "tokens", "bitmap"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (token, key): the first of each, where a token has several keys. Tokens at the borders of a
    partition stay, since their other keys may be in the next one. One row at most is held back."""
    names = ("token", "key", "pos", "size")
    held, known = None, True  # the last row so far; whether it is out already or its token is known to be shared
    for batch in batches:
        columns = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            columns = [np.concatenate(([h], c)).astype(c.dtype) for h, c in zip(held[0], columns, strict=True)]
        if not len(columns[0]):
            continue
        token, key = columns[:2]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        columns = [c[new] for c in columns]
        token = columns[0]
        begins = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        lengths = np.diff(np.concatenate((begins, [len(token)])))
        several = lengths > 1
        several[0] |= known
        keep = np.repeat(several, lengths)
        known = bool(several[-1])
        if held is not None and held[1]:
            keep[0] = False
        held = ([c[-1] for c in columns], known)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=list(names))
    if held is not None and not held[1]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(held[0], (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
            names=list(names))


def _bitmap(s: np.ndarray) -> bytes:
    bits = min(max(int(np.ceil(np.log2(2 * len(s) + 1))), NARROWEST), WIDEST)
    out = np.zeros(1 << bits, bool)
    out[(s & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A wide bitmap as it would be with fewer bits."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No set pair with these bitmaps has a larger intersection: a bit that only one has is a shingle it has alone."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = _fold(x, size), _fold(y, size)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def _linked(n: int, n_a: int, n_b: int, similarity: int) -> bool:
    return 100 * n >= similarity * (n_a + n_b - n)


def _bounded(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for a link."""
    for batch in batches:
        columns = [batch.column(n) for n in ("bitmap_a", "bitmap_b", "size_a", "size_b")]
        room = []
        for n in range(batch.num_rows):
            n_a, n_b = columns[2][n].as_py(), columns[3][n].as_py()
            most = bound(columns[0][n].as_buffer(), columns[1][n].as_buffer(), n_a, n_b)
            room.append(_linked(most, n_a, n_b, similarity))
        keep = pa.array(room, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _decide(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """Pairs that link, by exact intersection."""
    for batch in batches:
        left, right = ([s for _, some in _sets(iter([batch]), c) for s in some] for c in ("text_a", "text_b"))
        keep = pa.array([
            _linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)
            for a, b in zip(left, right, strict=True)
        ], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _near(pairs: DataFrame, marks: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of classes whose bitmaps leave room for a link."""
    def side(x: str) -> DataFrame:
        return marks.select(F.col("key").alias(x), F.col("bitmap").alias(f"bitmap_{x}"), F.col("size").alias(f"size_{x}"))

    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    return wide.mapInArrow(lambda batches: _bounded(batches, similarity), "a long, b long")


def _verified(near: DataFrame, marks: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of classes that link. Only texts of classes in pairs are fetched, by id and hash of a row of the
    class; the text of b goes with the pair to where that of a is."""
    place = marks.select("key", "id", "mark")
    b = near.join(place.withColumnRenamed("key", "b"), "b")
    a = near.select("a").distinct().join(place.withColumnRenamed("key", "a"), "a")
    wanted = written(b.select("a", "b", "id", "mark").unionByName(a.withColumn("b", F.lit(None).cast("long"))), "wanted")
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "text")
    texts = only_near(rows, wanted, "mark").groupBy("id", "mark").agg(F.any_value("text").alias("text"))
    found = wanted.join(texts, ["id", "mark"])
    members = found.where("b is not null").select("a", "b", F.col("text").alias("text_b"))
    centres = found.where("b is null").select("a", F.col("text").alias("text_a"))
    return members.join(centres, "a").mapInArrow(lambda batches: _decide(batches, similarity), "a long, b long")


def classes(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, mark, key, size, tokens, bitmap): the class of equal shingle sets of every row; key is NULL for an empty
    set. Prefix tokens and bitmap stand with some row of each class."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))
    return docs.mapInArrow(
        lambda batches: _summaries(batches, levels.value, similarity),
        "doc_id long, mark long, key long, size long, tokens array<long>, bitmap binary",
    )


def class_links(docs: DataFrame, summaries: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Links (a, b) between classes that connect exactly the classes which links of similar texts connect."""
    marks = written(
        summaries.where("bitmap is not null").select("key", "size", "mark", "bitmap", F.coalesce("doc_id", F.lit(0)).alias("id"))
        .dropDuplicates(["key"]), "marks")
    prefixes = summaries.select("key", "size", F.posexplode("tokens").alias("pos", "token")).select("token", "key", "pos", "size")
    # Ranges split a shingle that very many texts have in their prefixes.
    ordered = prefixes.repartitionByRange("token", "key").sortWithinPartitions("token", "key")
    meeting = written(ordered.mapInArrow(_shared, "token long, key long, pos int, size long"), "meeting")
    # Bands of sizes: sets of one band may be similar, and only those of the next one besides.
    tiles = meeting.withColumn("band", F.floor(F.log(100 / similarity, F.col("size"))))
    rank = F.col("pos").cast("long") * F.lit(1 << 32) + F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    centres = tiles.groupBy("token", "band").agg(F.min_by("key", rank).alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = tiles.join(centres.drop("n"), ["token", "band"]).where("key <> a").groupBy("a", F.col("key").alias("b")).count()
    stars = written(stars, "stars")
    near = written(_near(stars.select("a", "b"), marks, similarity), "near")
    # A copy often shares many prefix shingles with several centres; the nearest one is enough to begin with.
    nearest = near.join(stars, ["a", "b"]).groupBy("b").agg(F.max_by("a", "count").alias("a")).select("a", "b")
    links = written(_verified(nearest, marks, docs, similarity), "links")
    roots = components(links, name="class-components")
    links = written(links.unionByName(_verified(_between(near, roots), marks, docs, similarity)), "links")
    rest = written(_mixed_pairs(meeting, components(links, name="class-components"), similarity), "rest")
    return links.unionByName(_verified(written(_near(rest, marks, similarity), "near"), marks, docs, similarity))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("r_a"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("r_b"))
    apart = F.coalesce("r_a", "a") != F.coalesce("r_b", "b")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(apart).select("a", "b")


def _mixed_pairs(meeting: DataFrame, roots: DataFrame, similarity: int) -> DataFrame:
    """Pairs in different components that share a prefix shingle at places that allow a link."""
    rooted = meeting.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    rest = written(rooted.join(mixed.select("token"), "token", "left_semi"), "mixed")

    def side(x: str) -> DataFrame:
        return rest.select(
            "token", F.col("key").alias(x), F.col("root").alias(f"r_{x}"), F.col("size").alias(f"n_{x}"),
            (F.col("size") - F.col("pos")).alias(f"left_{x}"))

    least = F.lit(similarity) * (F.col("n_a") + F.col("n_b"))  # 100 + similarity times the intersection of a link
    room = (F.col("left_a") * (100 + similarity) >= least) & (F.col("left_b") * (100 + similarity) >= least)
    apart = (F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b"))
    return side("a").join(side("b"), "token").where(apart & room).select("a", "b").distinct()


def members(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, mark, size, root) of every row of (doc_id, text): root is that of its component, NULL for an empty set."""
    rows = docs.withColumn("mark", mark("doc_id", "text"))
    summaries = written(classes(rows, similarity), "classes")
    roots = components(class_links(rows, summaries, similarity), name="components")
    return summaries.select("doc_id", "mark", "key", "size").join(
        roots.withColumnRenamed("node", "key"), "key", "left"
    ).select("doc_id", "mark", "size", F.coalesce("root", "key").alias("root"))


def mark(id_column: Column | str, text_column: Column | str) -> Column:
    """A hash that, with the id, stands for a row."""
    id_column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.xxhash64(id_column.isNull(), text_column)


def join(docs: DataFrame, similarity: int = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its component's smallest doc_id."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rooted = members(docs, similarity)
    smallest = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(smallest, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, similarity: int = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (NULL last), of these the one with
    the smallest text hash, and any one of rows that share both. Rows without shingles are no copies and stay."""
    id_name, mark_name, times = unused(docs, "_id", "_mark", "_times")
    row_id = F.col(id_column).cast("long")
    rooted = members(docs.select(row_id.alias("doc_id"), F.col(text_column).alias("text")), similarity)
    counted = written(rooted.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times")), "counted")
    first = counted.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "times")).alias("first"))
    empty = counted.where("root is null").select("doc_id", "mark", F.lit(1).cast("long").alias("times"))
    kept = first.select("first.doc_id", "first.mark", "first.times").unionByName(empty).select(
        F.coalesce("doc_id", F.lit(0)).alias(id_name), F.col("mark").alias(mark_name), F.col("times").alias(times))
    kept = written(kept, "kept")
    keyed = docs.withColumn(id_name, F.coalesce(row_id, F.lit(0))).withColumn(mark_name, mark(row_id, text_column))
    rows = keyed.join(kept.hint("shuffle_hash"), [id_name, mark_name])
    # Only rows that share id and text need a choice.
    repeated = rows.where(F.col(times) > 1).dropDuplicates([id_name, mark_name])
    return rows.where(F.col(times) == 1).unionByName(repeated).select(docs.columns)
