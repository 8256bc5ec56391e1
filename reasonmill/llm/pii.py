"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a span
classifier trained on the outcome decides which candidates join the certain spans.

Native: DataFrame functions and Spark ML only.

1. Patterns find candidates in the whole text. Those of the four base kinds that pass their checks are certain and stay;
   the failing ones are only seen by the training. Looser patterns give candidates for more.
2. Five labelers look at a candidate and vote for, against, or not at all: its shape, its check digits or parts, words of
   a gazetteer before it, what touches it, and words that announce other numbers.
3. Candidates are counted by kind and votes; there are at most 3^5 vote vectors a kind, so this table is bounded whatever
   the corpus. Expectation-maximisation over it estimates the share of personal data and, per kind, what each labeler
   says of personal and of other spans.
4. A logistic regression learns these posteriors from the votes, the word before, the length and the next character.
5. A candidate of a looser pattern joins the spans if its check does not fail and its probability is a half or more.

Positions are code points. They come from the pieces between matches, whose lengths are summed in blocks, so the work on
a text grows with its length, also when it holds very many matches. Quantifiers are possessive where backtracking could
not change a match, so no run of characters, however long, exhausts the stack or takes quadratic time.

Defined results: a NULL text is ''; a text without candidates has counts of 0, the digest of '' and no spans; repeated
rows get equal results; an empty table gives no rows, and without candidates the classifier adds nothing. Spans of
different kinds may overlap. Only the id column is carried, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.expr import let, strings
from reasonmill.llm.tables import written

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "name")
BASE = KINDS[:4]
LABELERS = ("shape", "check", "gazetteer", "touching", "other")
BEFORE, AFTER = 48, 8
ROUNDS = 25
THRESHOLD = 0.5

# Words that announce a kind, and words that announce another number.
GAZETTEER = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt", "adresse", "reach"),
    "ip": ("ip", "host", "server", "address", "login", "from", "client", "adresse", "servidor", "serveur"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono", "cell", "ruf", "llame"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "key", "secret", "password", "apikey", "api_key", "bearer", "passwort", "clave"),
    "name": ("name", "dear", "contact", "signed", "from", "by", "regards"),
}
OTHER = ("version", "isbn", "order", "invoice", "page", "fig", "table", "sha", "md5", "checksum", "commit", "hash", "build", "issue", "nr")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora", "Sra")

_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_AT, _DOT = r" ?(?:\(at\)|\[at\]|\{at\}) ?| at ", r" ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\."


# ---- small expressions -------------------------------------------------------------------------------------


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _total(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a row of digits is right."""
    def value(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2)
        return digit - F.when(digit > 9, 9).otherwise(0)

    return _total(F.transform(F.sequence(F.lit(1), F.length(digits)), value), "int") % 10 == 0


def iban_check(m: Column) -> Column:
    """Whether an account number leaves 1 by 97, letters counting from 10, the first four signs last."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_SUM_BLOCK = 64


def running(values: Column) -> Column:
    """Sums up to and with each value, over blocks, so that n values take n * 64 steps and not n * n."""
    total = lambda a: _total(a)
    blocks = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _SUM_BLOCK).cast("int"))

    def build(v: Column) -> Column:
        sums = F.transform(blocks(v), lambda b: total(F.slice(v, b * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK))))
        return let(sums, lambda s: let(
            F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))),
            lambda starts: F.transform(v, lambda x, i: F.get(starts, F.floor(i / _SUM_BLOCK).cast("int"))
                                       + total(F.slice(v, i - i % _SUM_BLOCK + 1, i % _SUM_BLOCK + 1))),
        ))

    return let(values, build)


# ---- candidates --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A pattern, its kind, whether its passing matches are certain, and its check, shape and doubt."""

    kind: str
    regex: str
    certain: bool
    check: Callable[[Column], Column]
    shape: Callable[[Column], Column]

    def votes(self, found: Column) -> Column:
        """For 1, against -1, no vote 0, by labeler."""
        before = F.lower(found["before"])
        last = F.substring(found["before"], -1, 1)
        next_ = F.substring(found["after"], 1, 1)
        word = lambda words: before.rlike(r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})[^\n]{0,16}\z")
        joined = last.rlike(r"[\p{L}0-9_]") | next_.rlike(r"[\p{L}0-9_]")
        free = (last == "") | last.rlike(r"[\s\"'(\[<:,;=|]")
        vote = lambda yes, no: F.when(no, -1).when(yes, 1).otherwise(0)
        return F.array(
            vote(self.shape(found["match"]), F.lit(False)), vote(self.check(found["match"]), ~self.check(found["match"])),
            vote(word(GAZETTEER[self.kind]), F.lit(False)), vote(free, joined), vote(F.lit(False), word(OTHER)),
        )


def _n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


_always = lambda m: F.lit(True)

PATTERNS: tuple[Pattern, ...] = (
    Pattern("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, _always,
            lambda m: m.rlike(r"\.[A-Za-z]{2,24}\z")),
    Pattern("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True,
            lambda m: m.rlike(rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z"), lambda m: ~m.rlike(r"(?:\A|\.)0[0-9]")),
    # Runs of digits with single separators; only runs of 12 to 19 can pass.
    Pattern("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])", True,
            lambda m: luhn(_digits(m)), lambda m: m.rlike(r"\A[3-6]")),
    Pattern("phone", r"\+[0-9][ ().0-9-]+[0-9]", True, _n_digits(9, 15), lambda m: m.rlike(r"[ ().-]")),
    Pattern("email", rf"(?<![{_LOCAL}@])[{_LOCAL}]++(?:{_AT})[A-Za-z0-9-]++(?:(?:{_DOT})[A-Za-z]{{2,24}}+)++", False,
            lambda m: m.rlike(r"[(\[{]at|[(\[{]dot| dot "), lambda m: m.rlike(r"(?i)(?:com|org|net|edu|de|fr|es|io)\z")),
    Pattern("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", False, _always,
            lambda m: m.rlike("[A-Fa-f]")),
    Pattern("phone", r"(?=[(0-9])(?<![0-9A-Za-z+./-])(?<!\+[0-9][ ().0-9-]{0,12})"
            r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", False, _n_digits(10, 10),
            lambda m: m.rlike(r"\A\(|-")),
    Pattern("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", False,
            iban_check, lambda m: m.rlike(r"[0-9]{6}")),
    Pattern("secret", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])", False,
            lambda m: m.rlike("[A-Fa-f]") & m.rlike("[0-9]"), lambda m: F.length(m).isin(32, 40, 48, 64)),
    Pattern("name", r"(?<![\p{L}0-9])(?:" + "|".join(TITLES) + r")\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?", False, _always,
            lambda m: m.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}")),
)

_N = len(LABELERS)
_CELLS = len(KINDS) * _N * 3
_WORDS, _LENGTHS, _NEXT = 32, 8, 5
FEATURES = _CELLS + _WORDS + _LENGTHS + _NEXT


def _cells(kind: str, votes: Column) -> Column:
    """Numbers of what the labelers said, one per kind, labeler and vote."""
    first = KINDS.index(kind) * _N * 3
    return F.transform(votes, lambda v, n: first + n * 3 + v + 1)


def _features(found: Column) -> Column:
    """Numbers of the other features: the word before, the length and the next character."""
    word = F.regexp_extract(F.lower(found["before"]), r"(\p{L}+)[^\p{L}\n]*\z", 1)
    next_ = F.substring(found["after"], 1, 1)
    after = F.when(next_ == "", 0).when(next_.rlike(r"\p{L}"), 1).when(next_.rlike("[0-9]"), 2).when(next_.rlike(r"\s"), 3)
    long = F.least(F.floor(F.length(found["match"]) / 6), F.lit(_LENGTHS - 1)).cast("int")
    return F.array(
        _CELLS + F.pmod(F.xxhash64(word), F.lit(_WORDS)).cast("int"), _CELLS + _WORDS + long,
        _CELLS + _WORDS + _LENGTHS + after.otherwise(4),
    )


def _found(text: Column, pattern: Pattern, matches: Column) -> Column:
    """Start, match and surroundings of every match."""
    def build(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p, i: F.length(p).cast("long") + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
        return let(running(lengths), lambda starts: F.transform(matches, lambda m, i: F.struct(
            F.get(starts, i).alias("start"), m.alias("match"), F.substring(F.get(pieces, i), -BEFORE, BEFORE).alias("before"),
            F.substring(F.get(pieces, i + 1), 1, AFTER).alias("after"),
        )))

    return let(F.split(text, pattern.regex, -1), build)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of every row: start, kind, end, whether it is certain, whether it may join, and its features."""
    names = [f"_m{n}" for n in range(len(PATTERNS))]
    matched = docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    ).select("_id", "_text", *[
        F.regexp_extract_all("_text", F.lit(p.regex), F.lit(0)).alias(c) for c, p in zip(names, PATTERNS)
    ])

    def spans(pattern: Pattern, matches: str) -> Column:
        def span(f: Column) -> Column:
            fits = pattern.check(f["match"])
            return let(_cells(pattern.kind, pattern.votes(f)), lambda cells: F.struct(
                f["start"].alias("start"), F.lit(KINDS.index(pattern.kind)).alias("kind"),
                (f["start"] + F.length(f["match"])).alias("end"), (F.lit(pattern.certain) & fits).alias("certain"),
                (F.lit(not pattern.certain) & fits).alias("open"), cells.alias("cells"), _features(f).alias("more"),
            ))

        return F.when(F.size(matches) > 0, F.transform(_found(F.col("_text"), pattern, F.col(matches)), span))

    listed = matched.select("_id", *[spans(p, c).alias(c) for c, p in zip(names, PATTERNS)])
    kind = "array<struct<start:bigint,kind:int,end:bigint,certain:boolean,open:boolean,cells:array<int>,more:array<int>>>"
    lists = [F.coalesce(F.col(c).cast(kind), F.array().cast(kind)) for c in names]
    return listed.select(F.col("_id").alias(id_column), F.concat(*lists).alias("spans"))


# ---- reliabilities -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Classifier:
    intercept: float
    weights: Sequence[float]

    def probability(self, span: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        score = lambda a: _total(F.transform(a, lambda n: F.get(weights, n)), "double")
        return 1 / (1 + F.exp(-(self.intercept + score(span["cells"]) + score(span["more"]))))


def _log_odds(table: Column, cells: Column) -> Column:
    """Odds that a candidate is personal, from the weighed counts ``table`` of all cells (personal, other)."""
    kind = F.floor(F.get(cells, F.lit(0)) / (_N * 3)).cast("int") * (_N * 3)
    whole = lambda side: reduce(lambda a, b: a + b, [F.get(table, kind + v)[side] for v in range(3)])

    def build(all_: Column) -> Column:
        def vote(c: Column) -> Column:
            # Before any candidate is seen a labeler is taken to be right more often than wrong.
            v = c % 3
            yes, no = (F.get(table, c)["yes"] + 1 + v) / (all_["yes"] + 6), (F.get(table, c)["no"] + 3 - v) / (all_["no"] + 6)
            return F.log(yes) - F.log(no)

        prior = F.log((all_["yes"] + 2) / (all_["no"] + 2))
        return prior + _total(F.transform(cells, vote), "double")

    return let(F.struct(whole("yes").alias("yes"), whole("no").alias("no")), build)


def posteriors(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(cells, n, p) of every combination of kind and votes in ``counts`` (cells, n): p is the share of personal data by expectation-maximisation.

    One row holds the counts of all combinations, at most 3^5 for each kind, and an aggregate over the rounds does the
    estimation, so neither rows nor links of the corpus are gathered anywhere.
    """
    counted = counts.groupBy("cells").agg(F.sum("n").cast("double").alias("n"))
    seen = counted.agg(F.sort_array(F.collect_list(F.struct("cells", "n"))).alias("seen"))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    majority = F.transform("seen", lambda s: logistic(_total(F.transform(s["cells"], lambda c: c % 3 - 1), "double")))

    def again(shares: Column, _: Column) -> Column:
        weighed = F.zip_with(F.col("seen"), shares, lambda s, p: F.struct(
            s["cells"].alias("cells"), (s["n"] * p).alias("yes"), (s["n"] * (1 - p)).alias("no")))

        def table(rows: Column) -> Column:
            def cell(c: Column) -> Column:
                side = lambda name: _total(F.transform(rows, lambda r: F.when(F.array_contains(r["cells"], c), r[name]).otherwise(0.0)), "double")
                return F.struct(side("yes").alias("yes"), side("no").alias("no"))

            return F.transform(F.sequence(F.lit(0), F.lit(_CELLS - 1)), cell)

        return let(weighed, lambda rows: let(table(rows), lambda t: F.transform("seen", lambda s: logistic(_log_odds(t, s["cells"])))))

    final = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), majority, again)
    zipped = F.zip_with("seen", "shares", lambda s, p: F.struct(s["cells"].alias("cells"), s["n"].alias("n"), p.alias("p")))
    return seen.withColumn("shares", final).select(F.inline(zipped))


def reliabilities(estimated: DataFrame) -> DataFrame:
    """(kind, labeler, vote, personal, other): how often a labeler votes so on personal and on other candidates."""
    cells = estimated.select(F.explode("cells").alias("c"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    name = lambda values, at: F.get(strings(values), at.cast("int"))
    sums = cells.groupBy("c").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).select(
        name(KINDS, F.floor(F.col("c") / (_N * 3))).alias("kind"), name(LABELERS, F.floor(F.col("c") / 3) % _N).alias("labeler"),
        (F.col("c") % 3 - 1).alias("vote"), "yes", "no",
    )
    whole = sums.groupBy("kind", "labeler").agg(F.sum("yes").alias("_yes"), F.sum("no").alias("_no"))
    return sums.join(whole, ["kind", "labeler"]).select(
        "kind", "labeler", "vote", F.try_divide("yes", "_yes").alias("personal"), F.try_divide("no", "_no").alias("other")
    )


def fit(found: DataFrame, rounds: int = ROUNDS) -> Classifier:
    """The span classifier, from the candidates of all texts."""
    spans = found.select(F.explode("spans").alias("s")).select("s.cells", "s.more")
    # Bounded by the numbers of kinds, votes and features, whatever the corpus.
    vectors = written(spans.groupBy("cells", "more").agg(F.count("*").alias("n")).coalesce(4), "pii-vectors")
    estimated = posteriors(vectors, rounds)
    taught = written(vectors.join(F.broadcast(estimated.select("cells", "p")), "cells").select(
        F.concat("cells", "more").alias("active"), F.col("n").cast("double").alias("n"), "p"
    ), "pii-taught")
    if not taught.head(1):
        return Classifier(0.0, [0.0] * FEATURES)
    ones = F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda f: F.array_contains("active", f).cast("double"))
    sides = [taught.select(ones.alias("x"), F.lit(label).alias("label"), (F.col("n") * weight).alias("weight"))
             for label, weight in ((1.0, F.col("p")), (0.0, 1 - F.col("p")))]
    rows = sides[0].unionAll(sides[1]).select(array_to_vector("x").alias("features"), "label", "weight")
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=40, standardization=False).fit(rows)
    return Classifier(float(model.intercept), [float(w) for w in model.coefficients])


# ---- results -----------------------------------------------------------------------------------------------


def decided(found: DataFrame, model: Classifier) -> DataFrame:
    """(id, base, spans) of every row: the certain spans, and all of them with those that the classifier adds, in order of
    start and kind. A span is (start, kind, end)."""
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    accepted = lambda s: s["certain"] | (s["open"] & (model.probability(s) >= THRESHOLD))
    ordered = lambda keep: F.array_sort(F.array_distinct(F.transform(F.filter("spans", keep), place)))
    return found.select(
        *[c for c in found.columns if c != "spans"],
        ordered(lambda s: s["certain"]).alias("base"), ordered(accepted).alias("spans"),
    )


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Certain and added spans of every text, by a classifier trained on the candidates of all of them."""
    found = written(candidates(docs, id_column, text_column), "pii-candidates")
    return decided(found, fit(found))


def digests(detected: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the certain spans by kind, their digest, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.get(strings(KINDS), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == BASE.index(k))).cast("long")
    return detected.select(
        id_column, *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
