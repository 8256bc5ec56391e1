"""Scores of judged samples without their names: what scores need of a node are integers that say which names are equal.

A text becomes such integers right where it is parsed, so samples are small when they meet their verdicts, and all samples
of a batch are scored together by array operations. Only groups in which YES pairs compete go to the solver, once for
each different one. The scores are those of ``matches.match_counts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from reasonmill.functions.assign import PAIR_BASE, best_assignment
from reasonmill.functions.matches import VERDICTS, column_of, key_starts, lists
from reasonmill.functions.parse import parsed
from reasonmill.functions.text import BLANKS
from reasonmill.functions.vocab import ANY_WINDOW, FAR_APART, WINDOW_SCALE, sensor_names

RANKS = 4  # code of a verdict: place * RANKS + rank
SKIPPED = ("no_gt_reasoning", "no_pred_text", "gt_parse_fail", "pred_parse_fail")
# Nodes of a sample as one binary of int32: first how many observations and citations both sides have and whether both have a
# synthesis; then of each observation the group, the window and the id, and of each citation the number of the inference and
# the id. A group is the place of the first reference observation with that sensor, -1 without one.
HEAD, PARTS = 5, (3, 3, 2, 2)
NODE_FIELDS = (T.StructField("skip_reason", T.StringType()), T.StructField("nodes", T.BinaryType()))
SAID_FIELDS = (T.StructField("label", T.StringType()), T.StructField("rest", T.StringType()))
OPEN_FIELD = T.StructField(
    "open_names", T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("n", T.LongType())]))
)
_NUMBERS = ("n_gt_obs", "n_pred_obs", "n_gt_inf", "n_pred_inf", "obs_hits", "inf_hits", "temporal_hits", "covered", "channels")
_MEANS = ("iprov_abs", "iprov_clean", "iprov_penalised")
_ASKED = ("n_requests", "n_relaxed_requests")
COUNT_FIELDS = (
    *(T.StructField(c, T.IntegerType()) for c in _NUMBERS), *(T.StructField(c, T.DoubleType()) for c in _MEANS),
    T.StructField("synthesis_judge", T.StringType()), *(T.StructField(c, T.LongType()) for c in _ASKED),
)
_ARROW = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
Vocabulary = tuple[Sequence[str], Sequence[str]]  # sensors, and classes with the longest first
_MOST = 1 << 20  # pairs and verdicts that are worked on together, unless one sample has more
_ERROR, _NO, _YES = (VERDICTS.index(v) for v in ("ERROR", "NO", "YES"))


# ---- nodes -------------------------------------------------------------------------------------------------


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _codes(*texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Equal texts have equal codes, over all the arrays."""
    coded = pa.concat_arrays(texts).dictionary_encode()
    return np.split(coded.indices.to_numpy(), np.cumsum([len(t) for t in texts])[:-1]), coded.dictionary


def _side(graphs: pa.Array) -> dict:
    """Fields of all observations and citations, with the rows they belong to."""
    ends, observations = lists(graphs.field("observations"))
    inf_ends, inferences = lists(graphs.field("inferences"))
    based, cited = lists(inferences.field("based_on"))
    sizes = np.diff(inf_ends)
    inference, row = np.repeat(np.arange(len(inferences)), np.diff(based)), np.repeat(np.arange(len(graphs)), sizes)
    return {
        "n": np.diff(ends), "row": np.repeat(np.arange(len(graphs)), np.diff(ends)), "cited": cited,
        "citations": based[inf_ends], "number": (np.arange(len(inferences)) - inf_ends[row])[inference],
        **{name: observations.field(name) for name in ("id", "sensor", "temporal")},
    }


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def binaries(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Runs of numbers as binaries."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the binaries of a column and the numbers between them; NULL ones are empty."""
    size = np.dtype(kind).itemsize
    ends = _ends(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // size)
    column = column.drop_null()
    if not len(column):
        return ends, np.zeros(0, kind)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return ends, np.frombuffer(data, np.uint8)[first : first + ends[-1] * size].view(kind)


def _packed_nodes(counts: Sequence[np.ndarray], parts: Sequence[tuple[np.ndarray, ...]]) -> pa.Array:
    sizes = [n * len(fields) for n, fields in zip(counts, parts, strict=False)]
    ends = _ends(HEAD + sum(sizes))
    out = np.empty(ends[-1], np.int32)
    out[ends[:-1, None] + np.arange(HEAD)] = np.stack(counts, axis=1)
    at = ends[:-1] + HEAD
    for size, fields in zip(sizes, parts, strict=True):
        out[_spread(at, size)] = np.stack(fields, axis=1).ravel()
        at = at + size
    return binaries(ends, out)


def _unpacked_nodes(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Ends and fields of observations and citations of both sides, and whether both sides have a synthesis."""
    ends, values = _numbers(column, np.int32)
    head = values[ends[:-1, None] + np.arange(HEAD)].astype(np.int64)
    out, at = [], ends[:-1] + HEAD
    for n, width in zip(head.T, PARTS, strict=False):
        out.append((_ends(n), values[_spread(at, n * width)].reshape(-1, width).astype(np.int64)))
        at = at + n * width
    return out, head[:, -1] == 1


def _labels(lines: pa.Array, of: np.ndarray, classes: Sequence[Sequence[str]]) -> pa.Array:
    """``text.predicted_activity`` of activity lines, each by the classes ``of`` its row; NULL where case is not plain ASCII."""
    coded = lines.dictionary_encode()
    there = lines.is_valid().to_numpy(zero_copy_only=False)
    texts = coded.dictionary.to_pylist()
    each, inverse = np.unique(of[there] * max(1, len(texts)) + coded.indices.drop_null().to_numpy(), return_inverse=True)

    def named(line: str, known: Sequence[str]) -> str | None:
        label = line.strip(BLANKS).lower().replace("_", " ")
        return next((c for c in known if c in label), label or "unknown") if line.isascii() else None

    found = pa.array([named(texts[x % len(texts)], classes[x // len(texts)]) for x in each.tolist()], pa.string())
    at = np.zeros(len(lines), np.int64)
    at[there] = inverse
    return found.take(pa.array(at, mask=~there))


def _canonical(raw: np.ndarray, raw_names: list[str], of: np.ndarray, names: Sequence[Callable]) -> np.ndarray:
    """Codes of the canonical names of sensors, each by the vocabulary ``of`` its row; -1 for an empty name."""
    each, inverse = np.unique(of.astype(np.int64) * max(1, len(raw_names)) + raw, return_inverse=True)
    seen: dict[str, int] = {"": -1}
    codes = [seen.setdefault(names[x // len(raw_names)](raw_names[x % len(raw_names)])[0], len(seen)) for x in each.tolist()]
    return np.array(codes, np.int64)[inverse] if len(each) else np.zeros(0, np.int64)


def _groups(gt: dict, pred: dict, gt_name: np.ndarray, pred_name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = int(max(gt_name.max(initial=0), pred_name.max(initial=0))) + 1
    place = np.arange(len(gt_name)) - _ends(gt["n"])[gt["row"]]
    named, asked = np.flatnonzero(gt_name >= 0), np.flatnonzero(pred_name >= 0)
    keys, first, inverse = np.unique(gt["row"][named] * spread + gt_name[named], return_index=True, return_inverse=True)
    gt_group, pred_group = np.full(len(gt_name), -1), np.full(len(pred_name), -1)
    gt_group[named] = place[named][first][inverse]
    if len(keys):
        wanted = pred["row"][asked] * spread + pred_name[asked]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        pred_group[asked] = np.where(keys[at] == wanted, place[named][first][at], -1)
    return gt_group, pred_group


def coded_batches(
    batches: Iterable[pa.RecordBatch], carried: tuple[str, ...], vocabularies: Mapping[str, Vocabulary],
    open_sensors: Sequence[str] | None,
) -> Iterator[pa.RecordBatch]:
    """Rows of ``(carried, _gt, _pred, _no_gt, _no_pred, _of)`` to ``(carried, label, rest, NODE_FIELDS)``.

    ``_of`` names the vocabulary of a row, which is that of "" for other names. ``label`` is the class that the activity line
    of a plain generated text names, ``rest`` the whole text where there is no such line. Sensor strings that are not
    among ``open_sensors`` are counted for the batch, and its first row has the counts.
    """
    places = {name: n for n, name in enumerate(vocabularies)}
    names, classes = [sensor_names(s) for s, _ in vocabularies.values()], [c for _, c in vocabularies.values()]
    is_open = None if open_sensors is None else sensor_names(open_sensors)
    for batch in batches:
        if not batch.num_rows:
            continue
        (gt_graphs, _), (pred_graphs, plain) = parsed(batch.column("_gt"), False, True), parsed(batch.column("_pred"), True, True)
        gt, pred = _side(gt_graphs), _side(pred_graphs)
        of = batch.column("_of").dictionary_encode()
        known = np.array([places.get(x, places[""]) for x in of.dictionary.to_pylist()] + [places[""]])
        of = known[of.indices.fill_null(len(known) - 1).to_numpy()]
        (gt_raw, pred_raw), raw_names = _codes(gt["sensor"], pred["sensor"])
        raw_names = raw_names.to_pylist()
        name = _canonical(np.concatenate([gt_raw, pred_raw]), raw_names, of[np.concatenate([gt["row"], pred["row"]])], names)
        groups = _groups(gt, pred, name[: len(gt_raw)], name[len(gt_raw) :])
        (_, *windows), _ = _codes(pa.array([*WINDOW_SCALE, ANY_WINDOW]), gt["temporal"], pred["temporal"])
        ids, _ = _codes(gt["id"], pred["id"], gt["cited"], pred["cited"])
        no_gt, no_pred = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_no_gt", "_no_pred"))
        why = np.select([no_gt, no_pred, gt["n"] == 0, pred["n"] == 0], [0, 1, 2, 3], 4)
        both = pc.and_(gt_graphs.field("synthesis").is_valid(), pred_graphs.field("synthesis").is_valid())
        label = _labels(pc.if_else(pa.array(plain), pred_graphs.field("activity"), pa.scalar(None, pa.string())), of, classes)
        out = {
            **{c: batch.column(c) for c in carried},
            "label": label, "rest": pc.if_else(label.is_null(), batch.column("_pred"), pa.scalar(None, pa.string())),
            "skip_reason": pa.array([*SKIPPED, None]).take(pa.array(why)),
            "nodes": _packed_nodes(
                (gt["n"], pred["n"], np.diff(gt["citations"]), np.diff(pred["citations"]), both.to_numpy(zero_copy_only=False)),
                ((groups[0], windows[0], ids[0]), (groups[1], windows[1], ids[1]), (gt["number"], ids[2]), (pred["number"], ids[3]))),
        }
        if is_open is not None:
            use = ~(no_gt | no_pred)
            n = np.bincount(np.concatenate([gt_raw[use[gt["row"]]], pred_raw[use[pred["row"]]]]), minlength=len(raw_names))
            counts = [{"raw": raw, "n": int(x)} for raw, x in zip(raw_names, n, strict=True) if x and not is_open(raw)[1]]
            kind = pa.list_(pa.struct([("raw", pa.string()), ("n", pa.int64())]))
            out["open_names"] = pa.array([counts] + [None] * (batch.num_rows - 1), kind)
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


# ---- verdicts ----------------------------------------------------------------------------------------------


def _rank(response: bytes) -> int:
    """``text.verdict_of`` as a rank, in Python."""
    first = response.partition(b"\n")[0].decode(errors="replace").strip(BLANKS).upper()
    if first.startswith("YES"):
        return _YES
    if first.startswith("NO"):
        return _NO
    return _YES if "YES" in first else _NO if "NO" in first else _ERROR


def packed_batches(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(keys, _place, response)``, responses in bytes, to ``(keys, _codes)``: neighbours of one key become one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        response = batch.column("response").fill_null(b"").dictionary_encode()
        ranks = np.array([_rank(x) for x in response.dictionary.to_pylist()], np.int64)[response.indices.to_numpy()]
        starts = key_starts(table, keys)
        codes = binaries(np.append(starts, batch.num_rows), batch.column("_place").to_numpy() * RANKS + ranks)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(starts)) for k in keys), codes], names=[*keys, "_codes"])


def counted_batches(
    batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], carried: tuple[str, ...], relaxed: bool, tolerance: int
) -> Iterator[pa.RecordBatch]:
    """Samples with their counts, from rows in order of key in which a sample stands before its verdicts.

    The last key of a batch may go on in the next, so it waits for it; of its verdicts one for each pair waits.
    """
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        table = table.combine_chunks()
        starts = key_starts(table, keys)
        last = int(starts[-1]) if len(starts) else 0
        if len(starts) and any(column_of(table, k)[last].as_py() is None for k in keys):
            last, starts = table.num_rows, np.append(starts, table.num_rows)  # no verdict has such a key
        yield from _counted(table.slice(0, last), starts[:-1], carried, relaxed, tolerance)
        waiting = _merged(table.slice(last))
    if waiting is not None:
        waiting = waiting.combine_chunks()
        yield from _counted(waiting, key_starts(waiting, keys), carried, relaxed, tolerance)


def _merged(table: pa.Table) -> pa.Table:
    """Rows of one key with its verdicts in one row, one for each pair that a sample of it can have; none without a sample."""
    answer = column_of(table, "_answer").to_numpy(zero_copy_only=False)
    samples, rows = np.flatnonzero(~answer), np.flatnonzero(answer)
    if not len(samples) or len(rows) < 2:
        return table if len(samples) else table.slice(0, 0)
    nodes, _ = _unpacked_nodes(column_of(table, "nodes").take(pa.array(samples)))
    n = max(1, *(int(np.diff(ends).max()) for ends, _ in nodes))
    codes = _numbers(column_of(table, "_codes"), np.int64)[1]
    places = codes // RANKS
    codes = _highest(codes[(places % PAIR_BASE < n) & (places // PAIR_BASE % PAIR_BASE < n)])
    merged = table.take(pa.array(np.append(samples, rows[0])))
    held = pa.array([None] * len(samples) + [codes.tobytes()], pa.binary())
    return merged.set_column(merged.column_names.index("_codes"), merged.schema.field("_codes"), held)


def _highest(codes: np.ndarray) -> np.ndarray:
    """Of the codes of one place the one of the highest rank, in order."""
    codes = np.sort(codes)
    final = np.ones(len(codes), bool)
    final[:-1] = codes[1:] // RANKS != codes[:-1] // RANKS
    return codes[final]


# ---- counts ------------------------------------------------------------------------------------------------


def _counted(table: pa.Table, starts: np.ndarray, carried: tuple[str, ...], relaxed: bool, tolerance: int) -> Iterator[pa.RecordBatch]:
    answer = column_of(table, "_answer").to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(~answer)
    if not len(rows):
        return
    run = np.searchsorted(starts, np.arange(table.num_rows), "right") - 1
    code_ends, codes = _numbers(column_of(table, "_codes"), np.int64)
    run_ends = code_ends[np.append(starts, table.num_rows)]
    out = table.take(pa.array(rows))
    scoreable = column_of(out, "skip_reason").is_null().to_numpy(zero_copy_only=False)
    asked = out.filter(pa.array(scoreable))
    run = run[rows][scoreable]
    nodes, syn = _unpacked_nodes(column_of(asked, "nodes"))
    n = [np.diff(ends) for ends, _ in nodes]
    work = 1 + (run_ends[run + 1] - run_ends[run]) + n[0] * n[1] + n[2] * n[3]
    part = np.cumsum(work) // _MOST
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0]
    found = []
    for a, b in zip(cuts, cuts[1:]):
        some = [(ends[a : b + 1] - ends[a], values[ends[a] : ends[b]]) for ends, values in nodes]
        sizes = run_ends[run[a:b] + 1] - run_ends[run[a:b]]
        given = codes[_spread(run_ends[run[a:b]], sizes)], np.repeat(np.arange(b - a), sizes)
        found.append(_counts(some, syn[a:b], *given, relaxed, tolerance))
    at = pa.array(np.cumsum(scoreable) - 1, mask=~scoreable)
    columns = [column_of(out, c) for c in carried]
    for field in COUNT_FIELDS:
        kind = _ARROW[field.dataType]
        parts = [_nullable(f[field.name], kind) for f in found] or [pa.array([], kind)]
        columns.append(pa.concat_arrays(parts).take(at))
    yield from pa.Table.from_arrays(columns, names=[*carried, *(f.name for f in COUNT_FIELDS)]).to_batches()


def _nullable(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind, from_pandas=True)


def _steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``window_steps`` of coded windows."""
    n = len(WINDOW_SCALE)
    far = np.where((a < n) & (b < n), np.abs(a - b), FAR_APART)
    return np.where((a == b) | (a == n) | (b == n), 0, far)


def _product(rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places of several matrices, row by row: matrix, row, column."""
    sizes = rows * columns
    matrix = np.repeat(np.arange(len(rows)), sizes)
    place = _spread(np.zeros(len(rows), np.int64), sizes)
    return matrix, place // columns[matrix], place % columns[matrix]


def _counts(
    nodes: list[tuple[np.ndarray, np.ndarray]], syn: np.ndarray, codes: np.ndarray, owner: np.ndarray, relaxed: bool, tolerance: int
) -> dict[str, np.ndarray | pa.Array]:
    """``COUNT_FIELDS`` of samples; ``codes`` are their verdicts, each of the sample ``owner``."""
    n_samples = len(syn)
    (gt_ends, gt), (pred_ends, pred), *citing = nodes
    n, m = np.diff(gt_ends), np.diff(pred_ends)
    gt_sample, pred_sample = np.repeat(np.arange(n_samples), n), np.repeat(np.arange(n_samples), m)
    n_inf, m_inf = (_inferences(*c) for c in citing)

    # Verdicts by pair. Pairs have numbers: inferences of all samples, then observations, then syntheses.
    base = [_ends(n_inf * m_inf), _ends(n * m), np.arange(n_samples + 1)]
    base = [b + x for b, x in zip(base, (0, base[0][-1], base[0][-1] + base[1][-1]), strict=True)]
    place, rank = codes // RANKS, codes % RANKS
    kind, i, j = place // PAIR_BASE // PAIR_BASE, place // PAIR_BASE % PAIR_BASE, place % PAIR_BASE
    given = []
    for number, (rows, columns) in enumerate(((n_inf, m_inf), (n, m), (syn.astype(np.int64), syn.astype(np.int64)))):
        own = (kind == number) & (i < rows[owner]) & (j < columns[owner])
        given.append((base[number][owner[own]] + i[own] * columns[owner[own]] + j[own]) * RANKS + rank[own])
    given = _highest(np.concatenate(given))
    answered, ranks = given // RANKS, given % RANKS

    def verdict(pairs: np.ndarray) -> np.ndarray:
        if not len(answered):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(answered, pairs), len(answered) - 1)
        return np.where(answered[at] == pairs, ranks[at], -1)

    # Observations of the same sensor, in order of sample, group and row.
    spread = int(gt[:, 0].max(initial=0)) + 1
    order = np.flatnonzero(gt[:, 0] >= 0)
    order = order[np.argsort(gt_sample[order] * spread + gt[order, 0], kind="stable")]
    others = np.flatnonzero(pred[:, 0] >= 0)
    group_of = pred_sample[others] * spread + pred[others, 0]
    by_group = np.argsort(group_of, kind="stable")
    others, group_of = others[by_group], group_of[by_group]
    wanted = gt_sample[order] * spread + gt[order, 0]
    low = np.searchsorted(group_of, wanted, "left")
    sizes = np.searchsorted(group_of, wanted, "right") - low
    a, b = np.repeat(order, sizes), others[_spread(low, sizes)]
    sample, group = gt_sample[a], np.repeat(wanted, sizes)
    i, j = a - gt_ends[sample], b - pred_ends[sample]
    steps, same = _steps(gt[a, 1], pred[b, 1]), gt[a, 1] == pred[b, 1]
    ranked = verdict(base[1][sample] + i * m[sample] + j)
    if relaxed:
        ranked = np.where(steps > tolerance, _NO, ranked)
    hit = _hits(group, i, j, np.where(ranked == _YES, 0, np.where(ranked == _ERROR, 1, 2)), same)
    n_pairs, n_near = np.bincount(sample, minlength=n_samples), np.bincount(sample[steps <= tolerance], minlength=n_samples)
    obs_sample = sample[hit]
    reached = np.unique(group[hit]) // spread
    first = gt[:, 0] == np.arange(len(gt)) - gt_ends[gt_sample]

    # Counterparts of reference ids; of several observations with one id the last counts.
    ids = 1 + max(int(x[:, -1].max(initial=0)) for _, x in nodes)
    known = (obs_sample * ids + gt[a[hit], 2])[::-1]
    known, last = np.unique(known, return_index=True)
    counterpart = pred[b[hit], 2][::-1][last]
    existing = np.unique(pred_sample * ids + pred[:, 2])

    # Inferences.
    sample, i, j = _product(n_inf, m_inf)
    ranked = verdict(np.arange(len(sample)))
    inf_hit = _hits(sample, i, j, np.where(ranked == _YES, 0, np.where(ranked == _NO, 2, 1)), np.zeros(len(sample), bool))
    inf_sample = sample[inf_hit]
    cited = [_cited(*c, counts, inf_sample, x[inf_hit]) for c, counts, x in zip(citing, (n_inf, m_inf), (i, j), strict=True)]
    means = _provenance(inf_sample, cited, known, counterpart, existing, ids)
    sums = [np.bincount(inf_sample[~np.isnan(x)], x[~np.isnan(x)], n_samples) for x in means]
    defined = [np.bincount(inf_sample[~np.isnan(x)], minlength=n_samples) for x in means]
    said = np.where(syn, np.maximum(verdict(base[2][:-1]), _ERROR), len(VERDICTS))
    asked = n_inf * m_inf + syn
    count = lambda owners: np.bincount(owners, minlength=n_samples)
    return {
        "n_gt_obs": n, "n_pred_obs": m, "n_gt_inf": n_inf, "n_pred_inf": m_inf,
        "obs_hits": count(obs_sample), "inf_hits": count(inf_sample), "temporal_hits": count(obs_sample[same[hit]]),
        "covered": count(reached), "channels": count(gt_sample[first]),
        **{name: np.where(k > 0, x / np.maximum(k, 1), np.nan) for name, x, k in zip(_MEANS, sums, defined, strict=True)},
        "synthesis_judge": pa.array([*VERDICTS, "N/A"]).take(pa.array(said)),
        "n_requests": asked + n_pairs, "n_relaxed_requests": asked + n_near,
    }


def _inferences(ends: np.ndarray, citations: np.ndarray) -> np.ndarray:
    """Number of inferences of each sample: every one has citations, and the last stands last."""
    out = np.zeros(len(ends) - 1, np.int64)
    some = np.diff(ends) > 0
    out[some] = citations[ends[1:][some] - 1, 0] + 1
    return out


def _cited(ends: np.ndarray, citations: np.ndarray, counts: np.ndarray, sample: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What inference ``number`` of ``sample`` cites, for several: (which one, id)."""
    first = _ends(counts)
    of = np.repeat(np.arange(len(counts)), np.diff(ends))
    begin = _ends(np.bincount(first[of] + citations[:, 0], minlength=int(first[-1])))
    at = first[sample] + number
    sizes = begin[at + 1] - begin[at]
    return np.repeat(np.arange(len(at)), sizes), citations[_spread(begin[at], sizes), 1]


def _provenance(
    sample: np.ndarray, cited: list[tuple[np.ndarray, np.ndarray]], known: np.ndarray, counterpart: np.ndarray, existing: np.ndarray, ids: int
) -> list[np.ndarray]:
    """Agreement of the citations of matched inferences, NaN where it is undefined."""
    (gt_of, gt_id), (pred_of, pred_id) = cited
    n = len(sample)
    mapped = np.zeros(0, np.int64)
    if len(known):
        wanted = sample[gt_of] * ids + gt_id
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        found = known[at] == wanted
        mapped = np.unique(gt_of[found] * ids + counterpart[at[found]])
    theirs = np.unique(pred_of * ids + pred_id)
    of = theirs // ids
    there = np.isin(sample[of] * ids + theirs % ids, existing)
    n_both = np.bincount(np.intersect1d(mapped, theirs, assume_unique=True) // ids, minlength=n)
    n_mapped, n_theirs, n_there = np.bincount(mapped // ids, minlength=n), np.bincount(of, minlength=n), np.bincount(of[there], minlength=n)
    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), np.nan)
    plain, lost = share(n_both, n_mapped + n_theirs - n_both), n_theirs - n_there
    penalised = np.maximum(-1.0, share(n_both, n_mapped + n_there - n_both) - np.nan_to_num(share(lost, n_theirs)))
    return [plain, np.where(lost > 0, 0.0, plain), penalised]


def _hits(group: np.ndarray, i: np.ndarray, j: np.ndarray, cost: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which pairs the optimal assignment takes as hits. Pairs stand in order of group and row, and each group is complete."""
    yes = cost == 0
    if not yes.any():
        return yes
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    g, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    count = np.diff(np.append(begin, len(group)))
    row = new.copy()
    row[1:] |= i[1:] != i[:-1]
    n_rows = np.bincount(g, row).astype(np.int64)
    n_columns = count // n_rows
    open_ = np.bincount(g, cost == 1) > 0
    at = np.flatnonzero(yes)
    for nodes in (i, j):  # YES pairs that share a node
        taken = np.sort(g[at] * (int(nodes.max()) + 1) + nodes[at])
        again = taken[1:][taken[1:] == taken[:-1]]
        open_[again // (int(nodes.max()) + 1)] = True
    hit = yes & ~open_[g]
    open_ &= np.bincount(g, yes) > 0
    line = open_ & ((n_rows == 1) | (n_columns == 1))  # one pair only: a YES, if there is one of equal windows, else the first
    at = at[line[g[at]]]
    at = at[np.lexsort((at, ~same[at], g[at]))]
    hit[at[np.unique(g[at], return_index=True)[1]]] = True
    cells = (cost * 2 + same).astype(np.uint8)
    for n in np.flatnonzero(open_ & ~line).tolist():
        a, size = int(begin[n]), int(count[n])
        solve = _solved if size <= 64 else _solved.__wrapped__
        hit[a + solve(int(n_columns[n]), cells[a : a + size].tobytes())] = True
    return hit


@lru_cache(maxsize=1 << 16)
def _solved(n_columns: int, cells: bytes) -> np.ndarray:
    """Places of the hits that the solver takes of a complete group, row by row."""
    pairs = {divmod(n, n_columns): divmod(cell, 2) for n, cell in enumerate(cells)}
    return np.array([r * n_columns + c for r, c in best_assignment(pairs) if pairs[r, c][0] == 0], np.int64)
