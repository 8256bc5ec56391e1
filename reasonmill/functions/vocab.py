"""Closed vocabularies: time windows, importance tiers, sensor names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reasonmill.functions.expr import let
from reasonmill.functions.text import BLANKS, strip
from reasonmill.schema import as_column

# --- fixed values: window length, limits of the window labels, rank limits of the tiers, label scale
WINDOW_STEPS = 128
FULL_WINDOW_SPAN = 0.75
WINDOW_CENTRES = (("early", 0.25), ("early_to_mid", 0.40), ("mid", 0.60), ("mid_to_late", 0.75))
HIGH_RANKS, MODERATE_RANKS = 3, 6
WINDOW_SCALE = ("early", "early_to_mid", "mid", "mid_to_late", "late")
ANY_WINDOW = "throughout"
FAR_APART = 999
CONFIDENCES = ("high", "medium", "low")
# --- end of fixed values


def literal_map(entries: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(entries.items())])


def window_label(start: Column | str, end: Column | str, steps: int = WINDOW_STEPS) -> Column:
    """Label of a timestep range: long spans cover the full window, others go by their centre."""
    first = as_column(start) / F.lit(float(steps))
    last = F.least(as_column(end) / F.lit(float(steps)), F.lit(1.0))
    centre = (first + last) / 2.0
    label = F.when(last - first >= FULL_WINDOW_SPAN, "full_window")
    for name, below in WINDOW_CENTRES:
        label = label.when(centre < below, name)
    return label.otherwise("late")


def importance_tier(rank: Column | str) -> Column:
    rank = as_column(rank)
    return F.when(rank < HIGH_RANKS, "high").when(rank < MODERATE_RANKS, "moderate").otherwise("low")


def window_distance(a: Column | str, b: Column | str) -> Column:
    """Steps between two window labels; 0 if equal or either is the wildcard, far apart if one is unknown."""
    a, b = as_column(a), as_column(b)
    scale = literal_map({name: i for i, name in enumerate(WINDOW_SCALE)})
    return (
        F.when(a.eqNullSafe(b), 0)
        .when(a.eqNullSafe(ANY_WINDOW) | b.eqNullSafe(ANY_WINDOW), 0)
        .otherwise(
            F.coalesce(
                F.abs(F.try_element_at(scale, a) - F.try_element_at(scale, b)), F.lit(FAR_APART)
            )
        )
    )


def window_steps(a: str, b: str) -> int:
    """``window_distance`` of two labels in Python."""
    if a == b or ANY_WINDOW in (a, b):
        return 0
    if a in WINDOW_SCALE and b in WINDOW_SCALE:
        return abs(WINDOW_SCALE.index(a) - WINDOW_SCALE.index(b))
    return FAR_APART


def vocabulary_sensor(raw: Column | str, aliases: Mapping[str, str]) -> Column:
    """Vocabulary name of a raw sensor: its alias, else the lower-cased name."""
    raw = as_column(raw)
    return F.coalesce(F.try_element_at(literal_map(aliases), raw), F.lower(raw))


# Token synonyms of the canonical form; two-word placements are joined before the lookup.
TOKEN_SYNONYMS = {
    "acceleration": "acc", "accelerometer": "acc", "accel": "acc",
    "gyroscope": "gyro", "gyr": "gyro", "magnetometer": "mag", "magnetic": "mag",
    "orientation": "orient", "temperature": "temp",
}
JOINED_WORDS = (
    ("left_ankle", "lankle"), ("right_wrist", "rwrist"), ("left_pocket", "leftpocket"),
    ("right_pocket", "rightpocket"), ("upper_arm", "upperarm"), ("linear_acc", "linacc"),
)

_WORD_CATEGORIES = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Me", "Mc", "Pc"))
_CIRCLED_LETTERS = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))


def sensor_key(raw: Column | str) -> Column:
    """Spelling-free form of a sensor name: case, separators and synonyms collapse, axis and modality do not."""
    synonyms = literal_map(TOKEN_SYNONYMS)
    tokens = F.filter(F.split(F.lower(strip(raw)), r"(?U)[^\w^]+|_+"), lambda t: t != "")
    return let(
        F.array_join(
            F.transform(tokens, lambda t: F.coalesce(F.try_element_at(synonyms, t), t)), "_"
        ),
        lambda key: F.when(key.rlike("left_|right_|upper_|linear_"), _joined(key)).otherwise(key),
    )


def _joined(key: Column) -> Column:
    for words, joined in JOINED_WORDS:
        key = F.regexp_replace(key, rf"(?<![^_]){words}(?![^_])", joined)
    return key


def sensor_maps(sensors: Sequence[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Valid sensors by lower-cased name and by key."""
    return {s.lower(): s for s in sensors}, {_plain_key(s): s for s in sensors}


def canonical_sensor(raw: Column | str, sensors: Sequence[str] | Column) -> Column:
    """``struct<name, resolved>``: the valid sensor with the same key, else the key itself, unresolved.

    Most names are spelled as in the registry, so those are looked up before any key is built. ``sensors`` are the same
    for all rows, or a column with the two maps of ``sensor_maps`` as ``exact`` and ``known``.
    """
    if isinstance(sensors, Column):
        exact, known = sensors["exact"], sensors["known"]
    else:
        exact, known = map(literal_map, sensor_maps(sensors))
    found = lambda name: F.struct(name.alias("name"), F.lit(True).alias("resolved"))
    lower = F.lower(as_column(raw))
    return F.when(F.map_contains_key(exact, lower), found(F.try_element_at(exact, lower))).otherwise(
        let(
            sensor_key(raw),
            lambda key: F.struct(
                F.coalesce(F.try_element_at(known, key), key).alias("name"),
                F.try_element_at(known, key).isNotNull().alias("resolved"),
            ),
        )
    )


def _is_word(char: str) -> bool:
    """Letters, marks, digits, connectors and joiners, as ``(?U)\\w`` has them."""
    code = ord(char)
    return (
        unicodedata.category(char) in _WORD_CATEGORIES or code in (0x200C, 0x200D)
        or any(first <= code <= last for first, last in _CIRCLED_LETTERS)
    )


def sensor_names(sensors: Sequence[str]) -> Callable[[str], tuple[str, bool]]:
    """``canonical_sensor`` of one name in Python: its name, and whether it is resolved."""
    exact, known = sensor_maps(sensors)

    def of(raw: str) -> tuple[str, bool]:
        if raw.lower() in exact:
            return exact[raw.lower()], True
        lower = raw.strip(BLANKS).lower()
        words = "".join(c if c == "^" or (c != "_" and _is_word(c)) else "_" for c in lower)
        key = "_".join(TOKEN_SYNONYMS.get(t, t) for t in words.split("_") if t)
        for two, joined in JOINED_WORDS:
            key = re.sub(rf"(?<![^_]){two}(?![^_])", joined, key)
        return known.get(key, key), key in known

    return of


def _plain_key(name: str) -> str:
    """The key of a registry name, which is already split by underscores."""
    tokens = [t for t in name.lower().split("_") if t]
    key = "_".join(TOKEN_SYNONYMS.get(t, t) for t in tokens)
    for words, joined in JOINED_WORDS:
        key = f"_{key}_".replace(f"_{words}_", f"_{joined}_").strip("_")
    return key
