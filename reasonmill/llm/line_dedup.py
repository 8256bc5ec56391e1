"""Line dedup: overlapping windows of three lines, hashed, found globally, and covered positions merged.

Native: DataFrame functions only. Lines are what is between line feeds. Every three consecutive lines of a text are a
window; two windows are equal when their lines are, byte for byte (two 64-bit hashes stand for them). Of equal windows
the first by (doc_id, hash of the text, position) stays; the lines of all later ones are covered, and covered lines go.

Defined results: a NULL text and a text of fewer lines have no window and stay as they are; rows equal in doc_id and
text are one document, and each of them gets its result; a NULL doc_id comes first; blank lines count like others. A
text whose lines all went is ''. Input columns named like an output column are replaced; other names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.llm.tables import unused, written

WINDOW = 3
_SEED = 7919


def _windows(lines: Column) -> Column:
    """Position and the two hashes of each window."""
    def window(i: Column) -> Column:
        three = [F.get(lines, i + n) for n in range(WINDOW)]
        return F.struct(i.alias("_pos"), F.xxhash64(*three).alias("_h1"), F.xxhash64(F.lit(_SEED), *three).alias("_h2"))

    return F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), window)


def later_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, _text, _pos) of every window that is not the first of its kind; _text is the hash of the text."""
    text = F.col(text_column)
    lined = docs.select(
        F.col(id_column).alias("_id"), F.xxhash64(text).alias("_text"), F.split(text, "\n", -1).alias("_lines")
    ).where(F.size("_lines") >= WINDOW)
    found = lined.select("_id", "_text", F.inline(_windows(F.col("_lines"))))
    # Counting needs the hashes alone, with partial sums; only windows that repeat go on with their places.
    repeated = found.groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where("_n > 1").select("_h1", "_h2")
    candidates = written(found.join(repeated, ["_h1", "_h2"]), "line-windows")
    place = F.struct("_id", "_text", "_pos")
    firsts = candidates.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"))
    return candidates.join(firsts, ["_h1", "_h2"]).where(place != F.col("_first")).select("_id", "_text", "_pos")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with shortened texts, and the columns n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    covered = F.flatten(F.transform(F.collect_set("_pos"), lambda p: F.sequence(p, p + (WINDOW - 1))))
    spans = later_windows(docs, id_column, text_column).groupBy("_id", "_text").agg(
        F.sort_array(F.array_distinct(covered)).alias("_gone")  # positions of one text: bounded by its own lines
    )
    id_, text, gone_ = unused(docs, "_id", "_text", "_gone")
    joined = docs.join(
        spans.toDF(id_, text, gone_).hint("shuffle_hash"),  # the narrow side is hashed, so the texts are not sorted
        F.col(id_column).eqNullSafe(F.col(id_)) & (F.xxhash64(text_column) == F.col(text)), "left",
    )
    lines, gone = F.split(text_column, "\n", -1), F.coalesce(gone_, F.array().cast("array<int>"))
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    between = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda n: F.slice(lines, F.get(edges, n - 1) + 2, F.get(edges, n) - F.get(edges, n - 1) - 1),
    )
    short = F.when(F.size(gone) == 0, F.col(text_column)).otherwise(F.array_join(F.flatten(between), "\n"))
    return joined.select(
        *[(short if c == text_column else F.col(c)).alias(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
    )
