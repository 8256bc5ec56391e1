"""Text helpers and scalar projections as native column expressions.

Blanks, digits and case are Unicode-aware throughout, and Java's ``(?d)`` makes ``\\n`` the only line end: a
carriage return inside a value stays part of the value until it is stripped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reasonmill.functions.expr import let, strings
from reasonmill.schema import as_column

# All characters that count as blank, as a list for trimming and as a class for patterns. The class is spelled out
# because Java's \s is either ASCII only or, under (?U), slow, and misses the four ASCII separators both ways.
_BLANK_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
BLANKS = "".join(chr(c) for first, last in _BLANK_RANGES for c in range(first, last + 1))
_BLANK_CLASS = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in _BLANK_RANGES)
BLANK = f"[{_BLANK_CLASS}]"
VISIBLE = f"[^{_BLANK_CLASS}]"

# --- fixed values: phrases of a refusal, the shape of a leaked number, and the limits of the quality flags
REFUSAL_PHRASES = (
    r"i cannot|i can't|as an ai|i am unable|i'm unable|i apologize|i'm sorry, but|sorry, i cannot"
    r"|not able to (?:provide|generate|analyze)"
)
LEAKED_NUMBER = r"\b\d{2,}\.?\d*\b|\b\d+\.\d+\b"
SHORT_TOKENS = 50
ANSWER_TOKEN_LIMIT = 1024
PROMPT_TOKEN_LIMIT = 4096
# --- end of fixed values


def strip(c: Column | str) -> Column:
    return F.btrim(as_column(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and all-blank text."""
    return F.coalesce(~as_column(c).rlike(VISIBLE), F.lit(True))


def split_items(c: Column | str) -> Column:
    """Comma-separated items, each stripped; never an empty array."""
    return F.transform(F.split(strip(c), ",", -1), strip)


def is_refusal(c: Column | str) -> Column:
    return F.coalesce(as_column(c).rlike(rf"(?iU)(?:{REFUSAL_PHRASES})"), F.lit(False))


def leaks_number(c: Column | str) -> Column:
    return F.coalesce(as_column(c).rlike(rf"(?U)(?:{LEAKED_NUMBER})"), F.lit(False))


def drop_thinking(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), r"(?iu)<think>[\s\S]*?</think>", "")


def drop_code_fence(c: Column | str) -> Column:
    head = F.regexp_replace(as_column(c), r"(?U)\A```\w*\n?", "")
    return F.regexp_replace(head, r"\n?```\z", "")


def clean_answer(c: Column | str) -> Column:
    """Answer without think blocks and without an enclosing code fence."""
    return strip(drop_code_fence(strip(drop_thinking(c))))


def blank_token_count(c: Column | str) -> Column:
    """Stand-in for a tokenizer count: runs of non-blank characters."""
    return F.coalesce(F.regexp_count(as_column(c), F.lit(f"{VISIBLE}+")), F.lit(0))


def normalise_label(c: Column | str) -> Column:
    return F.replace(F.lower(strip(c)), F.lit("_"), F.lit(" "))


ACTIVITY_LINE = rf"\[(?iudm)ACTIVITY\]{BLANK}*:{BLANK}*(.+?)$"


def activity_line(text: Column | str) -> Column:
    """First activity line, stripped; NULL without a marker."""
    line = F.regexp_extract(as_column(text), ACTIVITY_LINE, 1)
    return let(line, lambda found: F.when(found != "", strip(found)))


def longest_first(classes: Sequence[str]) -> list[str]:
    return sorted(classes, key=lambda c: -len(c))


def predicted_activity(text: Column | str, classes: Sequence[str] | Column) -> Column:
    """Class named by an answer.

    The longest class equal to, or contained in, the activity line; else that line itself. Without a line the
    longest class contained in the whole text; else ``unknown``. Classes of equal length keep their order. A column of
    classes, one list per row, has them longest first.
    """
    ordered = classes if isinstance(classes, Column) else strings(longest_first(classes))

    def first_in(haystack: Column) -> Column:
        return F.get(F.filter(ordered, lambda c: F.contains(haystack, c)), F.lit(0))

    def build(t: Column) -> Column:
        whole = F.replace(F.lower(t), F.lit("_"), F.lit(" "))
        from_line = lambda line: F.coalesce(first_in(line), F.when(line != "", line))
        return F.when(t.rlike(ACTIVITY_LINE), let(normalise_label(activity_line(t)), from_line)).otherwise(
            first_in(whole)
        )

    return F.coalesce(let(F.coalesce(as_column(text), F.lit("")), build), F.lit("unknown"))


def verdict_of(response: Column | str) -> Column:
    """YES, NO or ERROR from the first line of a verdict text."""
    response = F.coalesce(as_column(response), F.lit(""))
    first = F.upper(strip(F.split_part(response, F.lit("\n"), F.lit(1))))
    return (
        F.when(first.startswith("YES"), "YES")
        .when(first.startswith("NO"), "NO")
        .when(first.contains("YES"), "YES")
        .when(first.contains("NO"), "NO")
        .otherwise("ERROR")
    )
