"""Conversation repair against plain counterparts: every sequence of edits for small ones, a plain search for the table."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reasonmill.llm import conversations
from reasonmill.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows after damage by conversation, in order."""
    space = lambda x: " " if x is None else x
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = space(role), space(text)
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_search(rows, found):
    """Best (cost, audit, lines): for every row count and pattern state, the least of all ways, by repeated relaxation."""
    best = {(0, 0): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for q in (0, 1, 2, 3):
                if (i, q) in best:
                    cost, audit, lines = best[i, q]
                    role, t = ("assistant", 3) if q == 2 else ("user", 2)
                    way = (cost + 5, audit + "I", (*lines, f"{role}:"))
                    best[i, t] = min(best.get((i, t), way), way)
        if i == len(rows):
            break
        for q in (0, 1, 2, 3):
            if (i, q) not in best:
                continue
            (cost, audit, lines), (_, role, text), bad = best[i, q], rows[i], found[i]
            ways = [(q, (cost + 2, audit + "D", lines))]
            if bad not in ("blank", "duplicate"):
                extra = 5 if bad == "truncated" else 0
                want, t = ("assistant", 3) if q == 2 else ("user", 2)
                ways.append((t, (cost + extra + 1, audit + "R", (*lines, f"{want}:{text}"))))
                if role[:1] == want[0]:
                    ways.append((t, (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                if role[:1] == "s" and q == 0:
                    ways.append((1, (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
            for t, way in ways:
                best[i + 1, t] = min(best.get((i + 1, t), way), way)
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def expected(rows):
    found = faults(rows)
    cost, audit, lines = plain_search(rows, found)
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] or "\0") + (b[1][:1] or "\0") not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def every_way(symbols):
    """Least (cost, audit) over all sequences of edits with at most two insertions at a place."""
    pattern, best = re.compile(r"(s?(ua)+)?"), None
    inserts = ["", "u", "a", "ua", "au", "uu", "aa"]
    choices = []
    for s in symbols:
        kind, extra = ("?", 0) if s == 8 else ("sua?"[s // 2], 5 * (s % 2))
        choices.append([("D", "", 2)] + ([] if s == 8 else [("K", kind, extra), ("R", "u", extra + 1), ("R", "a", extra + 1)]))
    for gaps in itertools.product(inserts, repeat=len(symbols) + 1):
        for edits in itertools.product(*choices):
            roles = gaps[0] + "".join(e[1] + g for e, g in zip(edits, gaps[1:]))
            if pattern.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
                way = (sum(e[2] for e in edits) + 5 * sum(map(len, gaps)), audit)
                best = way if best is None else min(best, way)
    return best


def test_lightest_equals_every_sequence_of_edits():
    for n in range(4):
        for symbols in itertools.product(range(9), repeat=n):
            if n < 3 or sum(symbols) % 7 == 0:
                ((_, weight),) = conversations.lightest(bytes(symbols), conversations.START, True)
                assert weight == every_way(symbols), symbols


def test_blocks_combine_to_the_whole():
    symbols = bytes((7 * n * n + 3 * n) % 9 for n in range(40))
    ((_, whole),) = conversations.lightest(symbols, conversations.START, True)
    for cut in (1, 13, 39):
        paths = [{(s, t): w for s in range(4) for t, w in conversations.lightest(p, s, False)} for p in (symbols[:cut], symbols[cut:])]
        both = conversations.combined(*paths)
        assert min(both[0, t] for t in (0, 3) if (0, t) in both) == whole


SCHEMA = "conv_id long, turn long, role string, text string, pos int, audit string"


def checked(spark, rows, block):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    damaged = conversations.damaged(df)
    plans = conversations.plan(damaged, block).checkpoint()
    got = {r.conv_id: tuple(r)[1:] for r in conversations.audited(df, damaged, plans).collect()}
    assert got == {k: expected(v) for k, v in damage(rows).items()}
    return damaged, plans


def test_query_equals_a_plain_search_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries()["op13_conversation_repair"](spark, FOLDER).collect()}
    assert got == {k: expected(v) for k, v in damage(rows).items()}


@pytest.mark.parametrize("block", [4, 256])
def test_odd_and_long_conversations(spark, block):
    rows = [(None, n, None if n % 9 == 0 else "user", f"t{n % 11}.") for n in range(40)]
    rows += [(1, None, "system", "no turn."), (1, 3, "", "empty role."), (1, 4, "tool", None), (1, 5, "assistant", " \n")]
    rows += [(2, n, ("user", "assistant", "system", "other")[n * n % 7 % 4], f"text {n}" + "." * (n % 3)) for n in range(700)]
    rows += [(3, 7, "user", "same row.")] * 30 + [(4, n, "user", "one text.") for n in range(300)]
    rows += [(5, -(1 << 63), "user", "a."), (6, 1, "user", "word " * 50_000 + ".")]
    damaged, plans = checked(spark, rows, block)
    lines = defaultdict(list)
    for r in conversations.rewritten(damaged, plans).orderBy("conv_id", "pos").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, kept in damage(rows).items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == expected(kept)[-1]


def test_empty_table_and_undamaged_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    damaged = conversations.damaged(none)
    assert conversations.audited(none, damaged, conversations.plan(damaged)).count() == 0
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "There?"), (1, 3, "assistant", "Yes.")]
    whole = conversations.as_rows(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA))
    plans = conversations.plan(whole)
    assert plans.select("cost", "audit", "illegal").first() == (2, "KDKK", 1)
    assert [r.text for r in conversations.rewritten(whole, plans).orderBy("pos").collect()] == ["Be kind.", "There?", "Yes."]
    assert plans.agg(F.sum("gaps")).first()[0] == 0
