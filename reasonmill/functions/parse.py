"""Trace text to trace graph, with regular expressions over Arrow batches.

A graph has tens of short values. Cutting them with column expressions took twice what it takes to hand the
text to Python and the graph back, because expressions inside array lambdas are interpreted.

A text is plain if it is blocks from bracket to bracket, each of one of four kinds with every value on a line of its own.
Plain texts of a batch are cut together, by Arrow's own functions; the others go through the patterns one by one. Both ways
give the same graph: where a plain block matches, the pattern can only match the same characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reasonmill.functions.text import BLANKS, drop_thinking
from reasonmill.functions.vocab import sensor_names
from reasonmill.schema import as_column

_B = f"[{re.escape(BLANKS)}]"

# --- fixed values: shape of the blocks of a trace. A dot stops at line feeds only, so greedy values end where lazy ones do.
OBSERVATION_BLOCK = (
    rf"\[OBSERVATION{_B}*\|{_B}*id:{_B}*(O\d+)\]{_B}*\n"
    rf"sensor:{_B}*(.+)\ntemporal:{_B}*(.+)\n"
    rf"pattern:{_B}*(.+)\nconfidence:{_B}*(.+)(?:\n|\Z)"
)
INFERENCE_BLOCK = (
    rf"\[INFERENCE{_B}*\|{_B}*id:{_B}*(I\d+)\]{_B}*\n"
    rf"based_on:{_B}*(.+)\ninference:{_B}*(.+)\nconfidence:{_B}*(.+)(?:\n|\Z)"
)
SYNTHESIS_BLOCK = rf"\[SYNTHESIS\]{_B}*\nbased_on:{_B}*(.+)\n([\s\S]+?)(?=\[ACTIVITY\]|\Z)"
ACTIVITY_LINE = rf"\[ACTIVITY\]{_B}*:{_B}*(.+)$"
# --- end of fixed values

# The same for plain blocks, in the dialect of Arrow, from behind the bracket.
_SOME = rf"[^{''.join(rf'\x{{{ord(b):x}}}' for b in BLANKS)}]"


def _value(name: str) -> str:
    return rf"[ \t]*(?P<{name}>{_SOME}.*)"


_PLAIN = (
    rf"(?i)^OBSERVATION[ \t]*\|[ \t]*id:[ \t]*(?P<id>O\d+)\][ \t\r]*\nsensor:{_value('sensor')}\ntemporal:{_value('temporal')}"
    rf"\npattern:{_value('pattern')}\nconfidence:{_value('confidence')}(?P<end>\n|\z)",
    rf"(?i)^INFERENCE[ \t]*\|[ \t]*id:[ \t]*(?P<id>I\d+)\][ \t\r]*\nbased_on:{_value('based_on')}"
    rf"\ninference:{_value('inference')}\nconfidence:{_value('confidence')}(?P<end>\n|\z)",
    rf"(?i)^SYNTHESIS\][ \t\r]*\nbased_on:{_value('based_on')}\n(?P<text>(?s:.)*{_SOME}(?s:.)*)",
    rf"(?i)^ACTIVITY\][ \t]*:{_value('line')}(?P<end>\n|\z)",
)
_KIND = np.full(256, -1, np.int8)
for _n, _letters in enumerate((b"oO", b"iI", b"sS", b"aA")):
    _KIND[list(_letters)] = _n

# schema.GRAPH as types: workers, which have no session to read DDL with, import this module too.
_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT = T.StringType()
GRAPH_TYPE = _struct(
    observations=T.ArrayType(_struct(id=_TEXT, sensor=_TEXT, temporal=_TEXT, pattern=_TEXT, confidence=_TEXT)),
    inferences=T.ArrayType(_struct(id=_TEXT, based_on=_STRINGS, inference=_TEXT, confidence=_TEXT)),
    synthesis=_struct(based_on=_STRINGS, text=_TEXT),
    activity=_TEXT, n_observations=T.IntegerType(), n_inferences=T.IntegerType(), parse_failed=T.BooleanType(),
)

_OBSERVATION, _INFERENCE, _SYNTHESIS = (
    re.compile(p, re.IGNORECASE) for p in (OBSERVATION_BLOCK, INFERENCE_BLOCK, SYNTHESIS_BLOCK)
)
_ACTIVITY = re.compile(ACTIVITY_LINE, re.IGNORECASE | re.MULTILINE)
_STRING = pa.string()
_BLANK_LINE = re.compile(rf"\n{_B}*\n")


def _items(text: str) -> list[str]:
    """Comma-separated items, each stripped; never empty."""
    return [item.strip(BLANKS) for item in text.strip(BLANKS).split(",")]


def _stripped(text: str) -> str:
    return text.strip(BLANKS)


def _lowered(text: str) -> str:
    return text.strip(BLANKS).lower()


def _each(texts: Sequence[str] | pa.Array, form: Callable, kind: pa.DataType = _STRING) -> pa.Array:
    """``form`` of every text, worked out once for each different one: sensors, windows and ids repeat in a batch."""
    coded = (texts if isinstance(texts, pa.Array) else pa.array(texts, _STRING)).dictionary_encode()
    return pa.array([form(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices)


def _lists(sizes: list[int], fields: dict[str, pa.Array]) -> pa.Array:
    """One list of structs per text, from the fields of all of them."""
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)


def _conclusion(text: str) -> str:
    return _BLANK_LINE.sub("\n", text).strip(BLANKS)


def _label(text: str) -> str:
    return text.strip(BLANKS).lower().replace("_", " ")


_NODE_FIELDS = (
    (("id", _stripped), ("sensor", _lowered), ("temporal", _lowered), ("pattern", _stripped), ("confidence", _lowered)),
    (("id", _stripped), ("based_on", _items), ("inference", _stripped), ("confidence", _lowered)),
)
_BRIEF = frozenset(("id", "sensor", "temporal", "based_on"))  # what matching needs once the requests are out


def _cleaned(node: int, found: Sequence, brief: bool) -> dict[str, pa.Array]:
    """Fields of observations (0) or inferences (1) as they stand in the graph."""
    return {
        name: _each(values, form, pa.list_(_STRING) if form is _items else _STRING)
        for (name, form), values in zip(_NODE_FIELDS[node], found, strict=True) if not brief or name in _BRIEF
    }


def _graphs(
    fields: Sequence[dict[str, pa.Array]], n_obs: np.ndarray, n_inf: np.ndarray, synthesis: pa.Array, activity: pa.Array
) -> pa.Array:
    """Graphs of the fields of their observations and of their inferences."""
    columns = {
        "observations": _lists(n_obs.tolist(), fields[0]), "inferences": _lists(n_inf.tolist(), fields[1]),
        "synthesis": synthesis, "activity": activity,
        "n_observations": pa.array(n_obs, pa.int32()), "n_inferences": pa.array(n_inf, pa.int32()),
        "parse_failed": pa.array(n_obs == 0, pa.bool_()),
    }
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def _one_by_one(texts: pa.Array, keep_activity_case: bool, brief: bool = False) -> pa.Array:
    observations, inferences, syntheses, activities, n_obs, n_inf = [], [], [], [], [], []
    for text in texts.to_pylist():
        text = (text or "").strip(BLANKS)
        before = len(observations), len(inferences)
        observations.extend(_OBSERVATION.findall(text))
        inferences.extend(_INFERENCE.findall(text))
        n_obs.append(len(observations) - before[0])
        n_inf.append(len(inferences) - before[1])
        found = _SYNTHESIS.search(text)
        syntheses.append(found and (_items(found[1]), _conclusion(found[2])))
        line = _ACTIVITY.search(text)
        activities.append(line and (_stripped if keep_activity_case else _label)(line[1]))
    fields = [
        _cleaned(n, list(zip(*nodes, strict=True)) or [()] * len(_NODE_FIELDS[n]), brief) for n, nodes in enumerate((observations, inferences))
    ]
    missing = pa.array([x is None for x in syntheses], pa.bool_())
    synthesis = pa.StructArray.from_arrays(
        [pa.array([x and x[n] for x in syntheses], t) for n, t in ((0, pa.list_(_STRING)), (1, _STRING))],
        names=["based_on", "text"], mask=missing)
    return _graphs(fields, np.array(n_obs, np.int64), np.array(n_inf, np.int64), synthesis, pa.array(activities, _STRING))


def _together(texts: pa.Array, keep_activity_case: bool, brief: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Graphs of the plain texts, and which ones are plain."""
    pieces = pc.split_pattern(texts, "[")
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    offsets, pieces = offsets - offsets[0], pieces.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    before, last = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
    before[offsets[:-1]], last[offsets[1:] - 1] = True, True
    sizes = pc.binary_length(pieces).to_numpy()
    starts = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces)]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    kind = np.full(len(pieces), -1, np.int8)
    some = (sizes > 0) & ~before
    kind[some] = _KIND[data[starts[some]]]
    good, places, found = before.copy(), [], []
    for n, pattern in enumerate(_PLAIN):
        at = np.flatnonzero(kind == n)
        coded = pieces.take(pa.array(at)).dictionary_encode()  # blocks repeat in a batch; each different one is cut once
        match, code = pc.extract_regex(coded.dictionary, pattern), coded.indices.to_numpy()
        fits = match.is_valid().to_numpy(zero_copy_only=False)[code]
        if n != 2:  # a value that ends with the piece goes on behind the next bracket
            ended = pc.binary_length(pc.struct_field(match, "end")).fill_null(0).to_numpy()[code] > 0
            fits = fits & (ended | last[at])
        good[at] = fits
        places.append(at)
        found.append((match, code))
    at = places[2]  # a synthesis goes on until an activity line
    good[at] &= last[at] | ((kind[np.minimum(at + 1, len(kind) - 1)] == 3) & good[np.minimum(at + 1, len(kind) - 1)])
    plain = np.bincount(text[~good], minlength=len(texts)) == 0
    columns, counts, firsts = [], [], []
    for n, (at, (match, code)) in enumerate(zip(places, found, strict=True)):
        use = np.flatnonzero(plain[text[at]])
        if n < 2:
            counts.append(np.bincount(text[at[use]], minlength=len(texts))[plain])
            code = pa.array(code[use])
            values = [match.field(f).fill_null("") for f in range(match.type.num_fields - 1)]
            columns.append({name: of.take(code) for name, of in _cleaned(n, values, brief).items()})
        else:
            match = match.take(pa.array(code[use]))
            owner, first = np.unique(text[at[use]], return_index=True)
            index = np.full(len(texts), -1)
            index[owner] = first
            index = index[plain]
            firsts.append((match, pa.array(index, mask=index < 0)))
    (match, index), (line, line_index) = firsts
    synthesis = pa.StructArray.from_arrays(
        [_each(match.field(0), _items, pa.list_(_STRING)).take(index), _each(match.field(1), _conclusion).take(index)],
        names=["based_on", "text"], mask=index.is_null())
    activity = _each(line.field(0), _stripped if keep_activity_case else _label).take(line_index)
    return _graphs(columns, *counts, synthesis, activity), plain


def _parse(texts: pa.Array, keep_activity_case: bool) -> pa.Array:
    """Graphs of a batch, column by column."""
    return parsed(texts, keep_activity_case)[0]


def parsed(texts: pa.Array, keep_activity_case: bool, brief: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Graphs of a batch, and which texts are plain. A brief graph has only what ``_BRIEF`` names of its nodes."""
    texts = texts.cast(_STRING).fill_null("")
    if not len(texts):
        return _one_by_one(texts, keep_activity_case, brief), np.zeros(0, bool)
    graphs, plain = _together(texts, keep_activity_case, brief)
    if plain.all():
        return graphs, plain
    rest = _one_by_one(texts.filter(pa.array(~plain)), keep_activity_case, brief)
    order = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
    return pa.concat_arrays([graphs, rest]).take(pa.array(order)), plain


@F.arrow_udf(GRAPH_TYPE)
def _graph(texts: pa.Array) -> pa.Array:
    return _parse(texts, keep_activity_case=False)


@F.arrow_udf(GRAPH_TYPE)
def _graph_with_case(texts: pa.Array) -> pa.Array:
    return _parse(texts, keep_activity_case=True)


def trace_graph(text: Column | str, *, keep_activity_case: bool = False) -> Column:
    """Graph of one trace. NULL and blank text give an empty, failed graph."""
    parse = _graph_with_case if keep_activity_case else _graph
    return parse(F.make_valid_utf8(as_column(text)))


# The optimizer must not move the parse into later expressions, where it would run again or stand in the arguments of
# another Arrow function; it keeps what is called nondeterministic in its place.
_graph, _graph_with_case = _graph.asNondeterministic(), _graph_with_case.asNondeterministic()


MATCH_GRAPH_TYPE = _struct(
    obs=T.ArrayType(_struct(id=_TEXT, sensor=_TEXT, raw_sensor=_TEXT, resolved=T.BooleanType(), temporal=_TEXT, pattern=_TEXT)),
    inf=GRAPH_TYPE["inferences"].dataType, syn=GRAPH_TYPE["synthesis"].dataType,
)


def match_graph(text: Column | str, sensors: Sequence[str]) -> Column:
    """Graph for matching: observations carry the canonical name of their sensor next to the raw one."""
    name_of = sensor_names(sensors)

    def build(texts: pa.Array) -> pa.Array:
        graphs = _parse(texts, keep_activity_case=False)
        observations = graphs.field("observations")
        nodes = observations.values
        raw = nodes.field("sensor")
        fields = {
            "id": nodes.field("id"), "sensor": _each(raw, lambda x: name_of(x)[0]), "raw_sensor": raw,
            "resolved": _each(raw, lambda x: name_of(x)[1], pa.bool_()), "temporal": nodes.field("temporal"),
            "pattern": nodes.field("pattern"),
        }
        obs = pa.ListArray.from_arrays(observations.offsets, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
        return pa.StructArray.from_arrays([obs, graphs.field("inferences"), graphs.field("synthesis")], names=["obs", "inf", "syn"])

    return F.arrow_udf(build, MATCH_GRAPH_TYPE).asNondeterministic()(F.make_valid_utf8(as_column(text)))


def unresolved_names(texts: Sequence[Column | str], sensors: Sequence[str]) -> Column:
    """Sensor strings of several traces that could not be resolved, in one list."""
    name_of = sensor_names(sensors)

    def build(*sides: pa.Array) -> pa.Array:
        rows, names = [], []
        for side in sides:
            observations = _parse(side, keep_activity_case=False).field("observations")
            raw = observations.values.field("sensor")
            open_ = ~_each(raw, lambda x: name_of(x)[1], pa.bool_()).to_numpy(zero_copy_only=False)
            rows.append(np.repeat(np.arange(len(side)), np.diff(observations.offsets.to_numpy()))[open_])
            names.append(raw.filter(pa.array(open_)))
        row = np.concatenate(rows)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sides[0])))))
        listed = pa.concat_arrays(names).take(pa.array(np.argsort(row, kind="stable")))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)

    return F.arrow_udf(build, _STRINGS).asNondeterministic()(*[F.make_valid_utf8(as_column(t)) for t in texts])


def corpus_graph(answer: Column | str) -> Column:
    """Graph of a teacher answer: think blocks are dropped first and the activity keeps its case."""
    return trace_graph(drop_thinking(as_column(answer)), keep_activity_case=True)
