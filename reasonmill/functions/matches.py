"""Assignment and scores of the judged pairs of a trace, over Arrow batches.

A trace has about ten pairs, each with a group, a cost and facts on both sides. Column expressions over such
lists are interpreted and took most of the time of the matching; here each batch is flattened once, and what
remains per trace is integers and short lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reasonmill.functions.assign import PAIR_BASE, best_assignment
from reasonmill.functions.vocab import window_steps

OBS, INF, SYN = "observation", "inference", "synthesis"
KINDS = (INF, OBS, SYN)  # in the order of a sorted list of pairs
VERDICTS = ("ERROR", "NO", "YES")  # by rank: of several for one pair the highest counts

_NO = VERDICTS.index("NO")
_OBS_PLACE = PAIR_BASE * PAIR_BASE  # a place is (kind * PAIR_BASE + i) * PAIR_BASE + j
_HALF_COST = {"YES": 0, "NO": 2, "ERROR": 1}

_OBS_FIELDS = (
    ("gt_id", T.StringType()), ("pred_id", T.StringType()), ("sensor", T.StringType()),
    ("temporal_match", T.BooleanType()), ("judge_verdict", T.StringType()), ("hit", T.BooleanType()),
    ("cost", T.DoubleType()),
)
_NAMES = T.ArrayType(T.StringType())
_INF_FIELDS = (
    ("gt_id", T.StringType()), ("pred_id", T.StringType()), ("judge_verdict", T.StringType()),
    ("hit", T.BooleanType()), ("cost", T.DoubleType()), ("gt_based_on", _NAMES), ("pred_based_on", _NAMES),
    ("mapped_gt_obs", _NAMES), ("hallucinated_basis", _NAMES), ("n_hallucinated_basis", T.IntegerType()),
    ("iprov_abs", T.DoubleType()), ("iprov_clean", T.DoubleType()), ("iprov_penalised", T.DoubleType()),
)
_COUNT_FIELDS = (
    ("obs_hits", T.IntegerType()), ("inf_hits", T.IntegerType()), ("temporal_hits", T.IntegerType()),
    ("covered", T.IntegerType()), ("channels", T.IntegerType()), ("iprov_abs", T.DoubleType()),
    ("iprov_clean", T.DoubleType()), ("iprov_penalised", T.DoubleType()), ("synthesis_judge", T.StringType()),
)


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _arrow(fields) -> list[pa.DataType]:
    kinds = {
        T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(),
        T.IntegerType(): pa.int32(), _NAMES: pa.list_(pa.string()),
    }
    return [kinds[kind] for _, kind in fields]


def _table(rows: list[tuple], fields) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return [pa.array(c, type=t) for c, t in zip(columns, _arrow(fields), strict=True)]


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ends of the lists of a column, with a leading start, and the values between them; NULL lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def sliced(column: pa.Array) -> Iterator[list]:
    """A column of lists as Python lists, one at a time, so that the collector has none to walk; NULL lists are empty."""
    ends, values = lists(column)
    ends, values = ends.tolist(), values.to_pylist()
    for a, b in zip(ends, ends[1:]):
        yield values[a:b]


# ---- verdicts of a sorted stream ---------------------------------------------------------------------------

PAIRS_TYPE = T.ArrayType(_struct((
    ("kind", T.StringType()), ("i", T.IntegerType()), ("j", T.IntegerType()), ("same_window", T.IntegerType()),
    ("verdict", T.StringType()),
)))


def judged_batches(
    batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], relaxed: bool, tolerance: int
) -> Iterator[pa.RecordBatch]:
    """Samples with their ``pairs``, from rows in order of key in which a sample stands before its verdicts.

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
        yield from _judged(table.slice(0, last), starts[:-1], relaxed, tolerance)
        waiting = _collapsed(table.slice(last))
    if waiting is not None:
        yield from _judged(waiting.combine_chunks(), key_starts(waiting, keys), relaxed, tolerance)


def column_of(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).combine_chunks()
    return chunks.combine_chunks() if isinstance(chunks, pa.ChunkedArray) else chunks


def key_starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Rows at which a new key begins."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows:
        new[1:] = False
    for key in keys:
        values = column_of(table, key)
        a, b = values[1:], values[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), pc.not_equal(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _collapsed(table: pa.Table) -> pa.Table:
    """Rows of one key, with one verdict left of each pair that a sample of it can have; none without a sample."""
    answer = column_of(table, "_answer").to_numpy(zero_copy_only=False)
    samples = np.flatnonzero(~answer)
    if len(samples) == 0 or len(samples) == len(answer):
        return table.take(pa.array(samples))
    n = max(pc.max(pc.list_value_length(pc.struct_field(column_of(table, side), [node, "id"]))).as_py() or 1
            for side in ("gt", "pred") for node in ("obs", "inf"))
    rows = np.flatnonzero(answer)
    places = column_of(table, "_place").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
    ranks = column_of(table, "_rank").to_numpy(zero_copy_only=False)[rows]
    able = (places % PAIR_BASE < n) & (places // PAIR_BASE % PAIR_BASE < n)
    rows, places, ranks = rows[able], places[able], ranks[able]
    order = np.lexsort((ranks, places))
    final = np.ones(len(order), bool)
    final[:-1] = places[order][1:] != places[order][:-1]
    return table.take(pa.array(np.concatenate([samples, rows[order][final]])))


def _judged(table: pa.Table, starts: np.ndarray, relaxed: bool, tolerance: int) -> Iterator[pa.RecordBatch]:
    answer = column_of(table, "_answer").to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(~answer)
    if len(rows) == 0:
        return
    out = table.take(pa.array(rows)).drop_columns(["_answer", "_place", "_rank"])
    n_samples = np.cumsum(~answer)
    run = np.searchsorted(starts, rows, "right") - 1
    ends = np.append(starts[1:], table.num_rows)
    # Samples stand first, so a key's verdicts begin where its samples end.
    upto = ends[run].tolist()
    first = starts[run]
    began = (first + n_samples[ends[run] - 1] - n_samples[first] + 1).tolist()
    places = column_of(table, "_place").to_pylist()
    ranks = column_of(table, "_rank").to_pylist()
    scoreable = column_of(out, "skip_reason").is_null().to_pylist()
    gt, pred = column_of(out, "gt"), column_of(out, "pred")
    of = lambda side, node, name: sliced(pc.struct_field(side, [node, name]))
    n_inf = lambda side: pc.fill_null(pc.list_value_length(pc.struct_field(side, ["inf", "id"])), 0).to_pylist()
    syntheses = pc.and_(pc.struct_field(gt, "syn").is_valid(), pc.struct_field(pred, "syn").is_valid()).to_pylist()
    columns = zip(
        scoreable, began, upto, of(gt, "obs", "sensor"), of(gt, "obs", "temporal"), of(pred, "obs", "sensor"),
        of(pred, "obs", "temporal"), n_inf(gt), n_inf(pred), syntheses, strict=True,
    )
    kinds, firsts, seconds, windows, verdicts, sizes = [], [], [], [], [], [0]
    for asked, a, b, names, times, others, their_times, m_gt, m_pred, syn in columns:
        if asked:
            given: dict[int, int] = {}
            for place, rank in zip(places[a:b], ranks[a:b]):
                if given.get(place, -1) < rank:
                    given[place] = rank
            for i in range(m_gt):
                for j in range(m_pred):
                    kinds.append(0)
                    firsts.append(i)
                    seconds.append(j)
                    windows.append(0)
                    verdicts.append(given.get(i * PAIR_BASE + j))
            for i, name in enumerate(names):
                if name == "":
                    continue
                for j, other in enumerate(others):
                    if name == other:
                        kinds.append(1)
                        firsts.append(i)
                        seconds.append(j)
                        windows.append(int(times[i] == their_times[j]))
                        far = relaxed and window_steps(times[i], their_times[j]) > tolerance
                        verdicts.append(_NO if far else given.get(_OBS_PLACE + i * PAIR_BASE + j))
            if syn:
                kinds.append(2)
                firsts.append(0)
                seconds.append(0)
                windows.append(0)
                verdicts.append(given.get(2 * _OBS_PLACE))
        sizes.append(len(kinds))
    taken = lambda values, codes: pa.array(values).take(pa.array(codes, pa.int32()))
    numbers = [pa.array(c, pa.int32()) for c in (firsts, seconds, windows)]
    nodes = pa.StructArray.from_arrays(
        [taken(KINDS, kinds), *numbers, taken(VERDICTS, verdicts)], names=[f.name for f in PAIRS_TYPE.elementType]
    )
    pairs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), nodes, mask=pa.array([not s for s in scoreable]))
    yield from out.append_column("pairs", pairs).to_batches()


# ---- assignment --------------------------------------------------------------------------------------------

Edge = tuple[int, int, int, int, int, "str | None"]  # group, i, j, half cost, same window, verdict


def assigned(edges: list[Edge]) -> list[Edge]:
    """Edges of the optimal assignment in order of group and row. Where the YES pairs already are a matching and no pair
    is undecided, what is left of each group is paired in order; other samples go to the solver."""
    if len(edges) < 2:
        return edges
    yes_i, yes_j, n_yes, undecided = set(), set(), 0, False
    groups: dict[int, list[Edge]] = {}
    for e in edges:
        groups.setdefault(e[0], []).append(e)
        if e[3] == 0:
            n_yes += 1
            yes_i.add(e[1])
            yes_j.add(e[2])
        elif e[3] == 1:
            undecided = True
    chosen = set()
    if undecided or len(yes_i) != n_yes or len(yes_j) != n_yes:
        for members in groups.values():
            if len({e[1] for e in members}) == 1 or len({e[2] for e in members}) == 1:
                best = min(members, key=lambda e: (e[3], e[3] != 0 or e[4] != 1, e[1], e[2]))  # the solver's order
                chosen.add((best[1], best[2]))
                continue
            chosen.update(best_assignment({(e[1], e[2]): (e[3], e[4]) for e in members}))
    else:
        for members in groups.values():
            chosen.update((e[1], e[2]) for e in members if e[3] == 0)
            rest_i = dict.fromkeys(e[1] for e in members if e[1] not in yes_i)
            rest_j = dict.fromkeys(e[2] for e in members if e[2] not in yes_j)
            chosen.update(zip(rest_i, rest_j))
    return sorted((e for e in edges if (e[1], e[2]) in chosen), key=lambda e: e[:3])


def _samples(sensors: pa.Array, pairs: Sequence[pa.Array]) -> Iterator[tuple | None]:
    """Per sample the chosen observation and inference edges and the verdict of the syntheses, if there are such."""
    columns = [lists(c)[1].to_pylist() for c in pairs]
    ends = lists(pairs[0])[0].tolist()
    given = pairs[0].is_valid().to_pylist()
    for n, names in enumerate(sliced(sensors)):
        if not given[n]:
            yield None
            continue
        obs, inf, syn = [], [], []
        for kind, i, j, same, verdict in zip(*[c[ends[n] : ends[n + 1]] for c in columns], strict=True):
            if kind == OBS:
                cost = 2 if verdict is None else _HALF_COST.get(verdict, 1)
                obs.append((names.index(names[i]), i, j, cost, same, verdict))
            elif kind == INF:
                inf.append((0, i, j, _HALF_COST.get(verdict, 1), same, verdict))
            else:
                syn.append(verdict)
        yield assigned(obs), assigned(inf), syn


def _share(part: int, whole: int) -> float | None:
    return part / whole if whole else None


def _jaccard(a: Iterable[str], b: Iterable[str]) -> float | None:
    a, b = set(a), set(b)
    return _share(len(a & b), len(a | b))


def _provenance(edge: Edge, gt_basis: list, pred_basis: list, counterpart: dict, existing: set) -> tuple:
    """Citations of an assigned pair: do both cite the same observations?"""
    gt_cited, pred_cited = list(dict.fromkeys(gt_basis[edge[1]])), list(dict.fromkeys(pred_basis[edge[2]]))
    mapped = list(dict.fromkeys(x for x in map(counterpart.get, gt_cited) if x is not None))
    lost = [x for x in pred_cited if x not in existing]
    plain = _jaccard(mapped, pred_cited)
    base = _jaccard(mapped, [x for x in pred_cited if x in existing])
    penalised = None if base is None else max(-1.0, base - (_share(len(lost), len(pred_cited)) or 0.0))
    return gt_cited, pred_cited, mapped, lost, len(lost), plain, 0.0 if lost else plain, penalised


def _obs_hits(edges: list[Edge], gt_ids: list, pred_ids: list) -> dict:
    """Counterparts of the reference observations that were hit; of several with one id the last counts."""
    return {gt_ids[e[1]]: pred_ids[e[2]] for e in edges if e[3] == 0}


# ---- Arrow functions ---------------------------------------------------------------------------------------


@F.arrow_udf(T.ArrayType(_struct(_OBS_FIELDS)))
def observation_matches(
    gt_ids: pa.Array, sensors: pa.Array, pred_ids: pa.Array, pred_sensors: pa.Array, kind: pa.Array,
    i: pa.Array, j: pa.Array, same_window: pa.Array, verdict: pa.Array,
) -> pa.Array:
    """Assigned observations, then the reference observations that none was assigned to."""
    rows, ends = [], [0]
    sides = zip(_samples(sensors, (kind, i, j, same_window, verdict)), *map(sliced, (gt_ids, sensors, pred_ids, pred_sensors)), strict=True)
    for sample, gt, names, pred, pred_names in sides:
        if sample is not None:
            taken = set()
            for _, left, right, cost, same, answer in sample[0]:
                taken.add(left)
                rows.append((gt[left], pred[right], names[left], same == 1, answer or "UNMATCHED", cost == 0, cost / 2.0))
            for n, name in enumerate(names):
                if name != "" and n not in taken:
                    why = "UNMATCHED" if name in pred_names else "NO_PRED_COVERAGE"
                    rows.append((gt[n], None, name, False, why, False, 1.0))
        ends.append(len(rows))
    return _listed(rows, ends, _OBS_FIELDS, kind)


@F.arrow_udf(T.ArrayType(_struct(_INF_FIELDS)))
def inference_matches(
    gt_ids: pa.Array, sensors: pa.Array, pred_ids: pa.Array, gt_inf: pa.Array, gt_basis: pa.Array,
    pred_inf: pa.Array, pred_basis: pa.Array, kind: pa.Array, i: pa.Array, j: pa.Array, same_window: pa.Array, verdict: pa.Array,
) -> pa.Array:
    """Assigned inferences with the provenance of each."""
    rows, ends = [], [0]
    columns = map(sliced, (gt_ids, pred_ids, gt_inf, gt_basis, pred_inf, pred_basis))
    for sample, gt, pred, g_inf, g_basis, p_inf, p_basis in zip(_samples(sensors, (kind, i, j, same_window, verdict)), *columns, strict=True):
        if sample is not None:
            counterpart, existing = _obs_hits(sample[0], gt, pred), set(pred)
            for e in sample[1]:
                head = (g_inf[e[1]], p_inf[e[2]], e[5] or "ERROR", e[3] == 0, e[3] / 2.0)
                rows.append(head + _provenance(e, g_basis, p_basis, counterpart, existing))
        ends.append(len(rows))
    return _listed(rows, ends, _INF_FIELDS, kind)


def _listed(rows: list[tuple], ends: list[int], fields, like: pa.Array) -> pa.Array:
    """One list of structs per sample, NULL where ``like`` is."""
    nodes = pa.StructArray.from_arrays(_table(rows, fields), names=[name for name, _ in fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes, mask=like.is_null())


@F.arrow_udf(_struct(_COUNT_FIELDS))
def match_counts(
    gt_ids: pa.Array, sensors: pa.Array, pred_ids: pa.Array, gt_basis: pa.Array, pred_basis: pa.Array, kind: pa.Array,
    i: pa.Array, j: pa.Array, same_window: pa.Array, verdict: pa.Array,
) -> pa.Array:
    """What the scores of a sample are made of; NULL where it has no pairs list."""
    rows = []
    columns = map(sliced, (gt_ids, sensors, pred_ids, gt_basis, pred_basis))
    for sample, gt, names, pred, g_basis, p_basis in zip(_samples(sensors, (kind, i, j, same_window, verdict)), *columns, strict=True):
        if sample is None:
            rows.append((None,) * len(_COUNT_FIELDS))
            continue
        obs, inf, syn = sample
        hits = [e for e in obs if e[3] == 0]
        counterpart, existing = _obs_hits(obs, gt, pred), set(pred)
        proofs = [_provenance(e, g_basis, p_basis, counterpart, existing)[5:] for e in inf if e[3] == 0]
        means = []
        for n in range(3):
            defined = [p[n] for p in proofs if p[n] is not None]
            means.append(_share(sum(defined), len(defined)))
        rows.append((
            len(hits), len(proofs), sum(e[4] == 1 for e in hits), len({names[e[1]] for e in hits}),
            len(set(names) - {""}), *means, (syn[0] or "ERROR") if syn else "N/A",
        ))
    return pa.StructArray.from_arrays(_table(rows, _COUNT_FIELDS), names=[name for name, _ in _COUNT_FIELDS])

