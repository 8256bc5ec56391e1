"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation shall give role initials ``(s?(ua)+)?``. A repair item (rows used, state of that pattern) is derived from
the item before it and the row it uses, or from an insertion; its weight is the pair (cost, audit). Costs add and audits
are concatenated, and both combine monotonically: at equal cost no audit of an item is a proper prefix of another, since
it could only go on with insertions, which cost. Only a kept row costs nothing and it uses a row, so weights grow along
(cost, rows used) and the item popped from the agenda is final. The search ends when the goal item is.

The steps for tables of any size:

1. Texts are hashed and everything up to the audit works on narrow rows. Equal rows (one conversation, turn, role and
   text) collapse to a count before they are shuffled; the first turn of a text that comes back is joined to them.
2. Rows are range-partitioned by conversation and turn, so a conversation of any length is dealt over tasks. A task
   derives the lightest weights of blocks of at most ``BLOCK`` rows, from every state to every state where the
   conversation goes on in another block.
3. Blocks are combined by one more deduction: block [s, q] and block [q, t] give [s, t].
4. Audits and texts meet by conversation in the order of turns, streamed: of a conversation only its audit is held.
   One task rewrites one conversation, because a digest of its text has to be taken in order.

Defined results: rows come by turn (NULL first), then role, then hash of role and text; a NULL role or text is one
space; a NULL conv_id is a conversation; an empty role has an initial of its own, which cannot be kept; two texts are
equal when 128 bits of hash are; gaps beyond 2^63 - 1 are that number; an empty table gives no rows. Other columns are
not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
LEGAL = frozenset(("su", "ua", "au"))
USER, ASSISTANT = "user", "assistant"

#: States of the pattern: nothing yet, after s, after u, after a. The last two numbers end nothing and end a conversation.
START, AFTER_S, AFTER_U, AFTER_A, GOAL = range(5)
ACCEPTED = (START, AFTER_A)
_MUST_GO = 8  # a symbol is 2 * (place of the initial in "sua", or 3) + truncated, or this one
Weight = tuple[int, str]
Paths = dict[tuple[int, int], Weight]


# ---- derivations -------------------------------------------------------------------------------------------


def _next_role(state: int) -> tuple[str, int]:
    """The role that a state asks for, and the state after it."""
    return (ASSISTANT, AFTER_A) if state == AFTER_U else (USER, AFTER_U)


def _deductions(symbol: int | None, state: int) -> Iterator[tuple[int, int, str, int]]:
    """(cost, rows used, edit, state) of what an item leads to with the next row."""
    role, after = _next_role(state)
    yield INSERT_COST, 0, INSERT, after
    if symbol is None:
        return
    yield DELETE_COST, 1, DELETE, state
    if symbol == _MUST_GO:
        return
    kind, extra = "sua?"[symbol // 2], TRUNCATED_COST * (symbol % 2)
    if kind == role[0]:
        yield extra, 1, KEEP, after
    else:
        yield extra + REROLE_COST, 1, REROLE, after
    if kind == "s" and state == START:
        yield extra, 1, KEEP, AFTER_S


@lru_cache(maxsize=1 << 16)
def lightest(symbols: bytes, start: int, closed: bool) -> tuple[tuple[int, Weight], ...]:
    """Lightest weights from ``start`` over all rows: to the goal if ``closed``, else to every state."""
    n, final, ends = len(symbols), set(), {}
    agenda = [(0, 0, "", start)]
    while agenda and len(ends) < 4:
        cost, used, audit, state = heappop(agenda)
        if (used, state) in final:
            continue
        final.add((used, state))
        if used == n:
            if closed and state in ACCEPTED:
                return ((GOAL, (cost, audit)),)
            ends[state] = (cost, audit)
        for more, taken, edit, after in _deductions(symbols[used] if used < n else None, state):
            if (used + taken, after) not in final:
                heappush(agenda, (cost + more, used + taken, audit + edit, after))
    return tuple(ends.items())


def combined(left: Paths, right: Paths) -> Paths:
    """Block [s, q] and block [q, t] give [s, t]; the lightest of each stays."""
    out: Paths = {}
    for (s, q), (cost, audit) in left.items():
        for (p, t), (more, rest) in right.items():
            if q == p:
                weight = (cost + more, audit + rest)
                if (s, t) not in out or weight < out[s, t]:
                    out[s, t] = weight
    return out


# ---- rows --------------------------------------------------------------------------------------------------

_BLANK = r"\A[ \t-\r]*\z"
_TRUNCATED = r"[^ \t-\r.!?][ \t-\r]*\z"
_KEYS = ("turn", "role", "_h1", "_h2")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after faults drawn from the CRC of each row's place: 0 of 20 drops the row, 1
    empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(space("text"), "[.!?]", ""))
    return conversations.select("conv_id", "turn", "role", "text", fault.alias("_fault")).where("_fault <> 0").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_fault") == 4, USER).otherwise(space("role")).alias("role"),
        text.otherwise(space("text")).alias("text"),
        F.when(F.col("_fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def as_rows(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``plan`` and ``rewritten`` take."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).cast("long").alias("copies")
    )


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_h1": F.xxhash64("role", "text"), "_h2": F.xxhash64(F.lit(7919), "text", "role")})


def _symbols(rows: DataFrame) -> DataFrame:
    """Narrow rows: place, hashes, number of copies, what the row is, and whether its text came before."""
    text = F.col("text")
    narrow = _hashed(rows).select(
        "conv_id", *_KEYS, "copies", text.rlike(_BLANK).alias("blank"), text.rlike(_TRUNCATED).alias("truncated")
    )
    facts = [F.bool_or(c).alias(c) for c in ("blank", "truncated")]
    counted = narrow.groupBy("conv_id", *_KEYS).agg(F.sum("copies").alias("copies"), *facts)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    repeated = counted.where("not blank").groupBy("conv_id", "_h1", "_h2").agg(
        F.min(when).alias("_first"), F.count("*").alias("_n")
    ).where("_n > 1")
    firsts = repeated.select(F.col("conv_id").alias("_conv"), F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2"))
    return counted.join(firsts, same, "left").select(
        "conv_id", *_KEYS, "copies", "blank", "truncated", F.coalesce(when > F.col("_first"), F.lit(False)).alias("later")
    )


# ---- blocks ------------------------------------------------------------------------------------------------

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCK_FIELDS = (
    "part int, seq long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, paths array<struct<s:int,t:int,cost:long,audit:string>>"
)


class _Block:
    """Consecutive rows of one conversation: counts, both ends, and the symbols or the paths over them."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.turns = 0
        self.symbols = bytearray()
        self.paths: Paths = {}

    def add(self, initial: str, turn: int | None, symbol: int) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.symbols.append(symbol)

    def derive(self, begins: bool, ends: bool) -> None:
        symbols = bytes(self.symbols)
        for start in (START,) if begins else (START, AFTER_S, AFTER_U, AFTER_A):
            for end, weight in lightest(symbols, start, ends):
                self.paths[start, end] = weight

    def then(self, other: _Block) -> _Block:
        out = _Block()
        out.counts = {k: self.counts[k] + other.counts[k] for k in _COUNTS}
        out.counts["illegal"] += self.last + other.first not in LEGAL
        out.first, out.last = self.first, other.last
        out.low = other.low if self.low is None else self.low
        out.high = self.high if other.high is None else other.high
        out.turns = self.turns + other.turns - (self.high is not None and self.high == other.low)
        out.paths = combined(self.paths, other.paths)
        return out

    def weight(self) -> Weight:
        return min(w for (s, t), w in self.paths.items() if s == START and t in (*ACCEPTED, GOAL))


def _initial(role: str) -> str:
    return role[:1] or "\0"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _blocks(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition, in order. A conversation that has a neighbour on a side within the partition is known
    to begin or to end here."""
    part, seq, out = TaskContext.get().partitionId(), 0, []
    current, conv, begins, started = None, None, False, False

    def closed(ends: bool) -> None:
        nonlocal seq
        current.derive(begins, ends)
        paths = [{"s": s, "t": t, "cost": c, "audit": a} for (s, t), (c, a) in current.paths.items()]
        out.append({
            "conv_id": conv, "part": part, "seq": seq, **current.counts, "first": current.first, "last": current.last,
            "low": current.low, "high": current.high, "turns": current.turns, "paths": paths,
        })
        seq += 1

    for conv_id, turn, role, copies, blank, truncated, later in _rows(batches):
        if not started or conv_id != conv:
            if started:
                closed(True)
            current, begins, conv, started = _Block(), started, conv_id, True
        initial = _initial(role)
        kind = "sua".find(initial) if initial in "sua" else 3
        for copy in range(copies):
            if len(current.symbols) == size:
                closed(False)
                current, begins = _Block(), False
            go = blank or later or copy > 0
            if blank:
                current.counts["blank"] += 1
            elif go:
                current.counts["duplicate"] += 1
            elif truncated:
                current.counts["truncated"] += 1
            current.add(initial, turn, _MUST_GO if go else 2 * kind + truncated)
        if len(out) >= 1024:
            yield _block_batch(out, id_type)
            out.clear()
    if started:
        closed(False)
    yield _block_batch(out, id_type)


_BLOCK_TYPES = [
    ("part", pa.int32()), ("seq", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("first", pa.string()),
    ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("paths", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
]


def _block_batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", id_type), *_BLOCK_TYPES]))


def _folded(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per conversation. Blocks wait on a stack by size and meet their equals, so a conversation of any number of
    blocks is combined in a balanced way and in order."""
    schema = pa.schema([("conv_id", id_type), ("gaps", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string())])
    out: list[dict] = []
    stack: list[tuple[int, _Block]] = []
    conv, started = None, False

    def finish() -> None:
        whole = stack.pop()[1]
        while stack:
            whole = stack.pop()[1].then(whole)
        cost, audit = whole.weight()
        gaps = 0 if whole.low is None else min(whole.high - whole.low + 1 - whole.turns, (1 << 63) - 1)
        out.append({"conv_id": conv, "gaps": gaps, **whole.counts, "cost": cost, "audit": audit})

    for conv_id, _, _, *fields in _rows(batches):
        if started and conv_id != conv:
            finish()
        conv, started = conv_id, True
        block = _Block()
        block.counts = dict(zip(_COUNTS, fields[:4]))
        block.first, block.last, block.low, block.high, block.turns = fields[4:9]
        block.paths = {(p["s"], p["t"]): (p["cost"], p["audit"]) for p in fields[9]}
        size = 1
        while stack and stack[-1][0] <= size:
            below, left = stack.pop()
            block, size = left.then(block), size + below
        stack.append((size, block))
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if started:
        finish()
    yield pa.RecordBatch.from_pylist(out, schema)


def plan(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows. The number of
    rows of a block changes no result."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = _arrow_type(rows, "conv_id")
    order = ["conv_id", *_KEYS]
    ordered = _symbols(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("_h1", "_h2")
    blocks = ordered.mapInArrow(lambda b: _blocks(b, id_type, block), f"conv_id {kind}, {_BLOCK_FIELDS}")
    near = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return near.mapInArrow(lambda b: _folded(b, id_type), f"conv_id {kind}, gaps long, {counts}, cost long, audit string")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


# ---- repaired conversations --------------------------------------------------------------------------------


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(new conversation, conv_id, turn, edit, role, text) of every edit but deletions; a first one per conversation
    without an edit. Rows come after the audit of their conversation."""
    audit, at, state = "", 0, START
    last = None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            role, state = _next_role(state)
            at += 1
            yield False, last, None, INSERT, role, ""

    for conv_id, first, turn, role, text, copies in _rows(batches):
        if first is not None:
            yield from inserted()
            audit, at, state, last = first, 0, START, conv_id
            yield True, conv_id, None, None, None, None
            continue
        for _ in range(copies):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == DELETE:
                continue
            if edit == KEEP and _initial(role) == "s":
                state, now = AFTER_S, role
            else:
                now, state = _next_role(state)
                now = role if edit == KEEP else now
            yield False, conv_id, turn, edit, now, text
    yield from inserted()


def _written_rows(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "pos", "turn", "edit", "role", "text"]
    types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    pos = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    for new, conv_id, turn, edit, role, text in _edited(batches):
        if new:
            pos = 0
            continue
        out.append((conv_id, pos, turn, edit, role, text))
        pos += 1
        if len(out) >= 1024:
            yield make()
            out.clear()
    if out:
        yield make()


def _digests(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    digest, empty, conv = None, True, None
    make = lambda: pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "sha256"]
    )
    for new, conv_id, _, _, role, text in _edited(batches):
        if new:
            if digest is not None:
                out.append((conv, digest.hexdigest()))
            digest, empty, conv = hashlib.sha256(), True, conv_id
        else:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if len(out) >= 1024:
            yield make()
            out.clear()
    if digest is not None:
        out.append((conv, digest.hexdigest()))
    yield make()


def _with_audits(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    hashed = _hashed(rows).select(
        "conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies", "_h1", "_h2"
    )
    nothing = {"turn": "long", "role": "string", "text": "string", "copies": "long", "_h1": "long", "_h2": "long"}
    audits = plans.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    both = audits.unionAll(hashed).withColumn("_row", F.col("audit").isNull())
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "_row", *_KEYS)
    return ordered.select("conv_id", "audit", "turn", "role", "text", "copies")


def rewritten(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, pos, turn, edit, role, text), pos from 0."""
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), _arrow_type(rows, "conv_id")
    schema = f"conv_id {kind}, pos long, turn long, edit string, role string, text string"
    return _with_audits(rows, plans).mapInArrow(lambda b: _written_rows(b, id_type), schema)


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of each repaired conversation."""
    kind, id_type = rows.schema["conv_id"].dataType.simpleString(), _arrow_type(rows, "conv_id")
    return _with_audits(rows, plans).mapInArrow(lambda b: _digests(b, id_type), f"conv_id {kind}, sha256 string")


def audited(conversations: DataFrame, rows: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for every conversation: counts of faults, cost, audit and digest; those without rows have none of them."""
    prefixed = lambda df, p: df.withColumnsRenamed({"conv_id": f"{p}conv"})
    known = conversations.select("conv_id").distinct()
    on = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    whole = known.join(prefixed(plans, "_p"), on("_pconv"), "left").join(
        prefixed(digests(rows, plans), "_d"), on("_dconv"), "left"
    )
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", nothing).alias("repaired_sha256"),
    )
