"""Personal data: patterns propose spans, checksums confirm, context scores.

Everything is a Column expression. For each kind, ``regexp_extract_all``
gives the leftmost non-overlapping matches and ``split`` by the same
pattern the text between them; the running sum of both lengths gives code
point offsets. Validators then drop what fails: octets for IP addresses,
Luhn for cards, mod 97 for IBANs, digit counts for phones. A score starts
at the kind's prior and moves with words that stand shortly before a match.

The patterns take the same strings as their plain greedy forms. Groups that
repeat are possessive, because Java's regex engine recurses for each turn
of a backtracking group and would overflow its stack on a very long run;
a match may start inside a run of its first characters only where the last
match ended, which changes no result and keeps long runs linear. Offsets,
contexts and redacted text are put together in blocks of about sqrt(n)
matches, as an array that grows by one is copied each time.

Defined results: null and empty texts have no spans; rows are judged one by
one, so repeated rows give repeated rows and null ids stay null; an empty
table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import lower_ascii, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
#: Added to the base kinds; listed after them.
KINDS = (*BASE_KINDS, "iban")

#: Characters of an IBAN without spaces, and the countries that have so many.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_IBAN_COUNTRIES = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # The country tells the length; one that is not listed has any.
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS}|(?!{_IBAN_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
}
#: A cheap test that every text with a match of the kind passes.
_HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
}
#: Score of a validated match without context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: Words that raise or lower the score when they stand in the
#: CONTEXT_CHARS code points before a match.
CONTEXT = {
    "email": (("mail", "contact", "write to", "reach"), ("example", "noreply")),
    "ip": (("ip", "host", "server", "address", "login"), ("version", "release", "section")),
    "card": (("card", "visa", "credit", "debit", "payment"), ("order", "isbn", "serial", "tracking")),
    "phone": (("phone", "call", "tel", "mobile", "fax"), ("order", "serial")),
    "iban": (("iban", "account", "bank", "transfer"), ("serial", "part number")),
}
CONTEXT_CHARS = 40
CONTEXT_STEP = 0.2
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _char(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = _char(back, i).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(account, F.lit(5), F.lit(40)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(_char(turned, i))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octet(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(value) <= 3) & (F.substring(value, F.lit(1), F.lit(3)).cast("int") <= 255)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _octet)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.translate(match, " ", ""))
    return F.lit(True)


def _score(kind: str, before: Column) -> Column:
    before = lower_ascii(before)
    raising, lowering = (F.greatest(*[F.contains(before, F.lit(w)).cast("int") for w in words]) for words in CONTEXT[kind])
    score = F.lit(PRIOR[kind]) + CONTEXT_STEP * (raising - lowering)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def _last(text: Column) -> Column:
    """The last CONTEXT_CHARS code points."""
    return F.substring(text, F.lit(-CONTEXT_CHARS), F.lit(CONTEXT_CHARS))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _in_blocks(items: Column, state: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step(state, block)`` over blocks of about sqrt(n) of the n items, so
    that arrays and strings that a step makes longer stay short."""
    block = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))

    def walk(width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), width)
        return F.aggregate(starts, state, lambda acc, i: step(acc, F.slice(items, i, width)))

    return _bound(block, walk)


def spans_of(kind: str, text: Column) -> Column:
    """Validated spans of one kind, by start."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        before = _last(F.concat(acc["tail"], _last(pair["gap"])))
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"), before.alias("before"))
        tail = _last(F.concat(acc["tail"], _last(pair["gap"]), _last(pair["match"])))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string>>")

    def block(acc: Column, pairs: Column) -> Column:
        state = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("spans"))
        return F.aggregate(
            pairs, state, step,
            lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["done"], F.array(x["spans"])).alias("done")),
        )

    none = F.array().cast("array<array<struct<start:bigint,end:bigint,match:string,before:string>>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), none.alias("done"))
    # The text after the last match pairs with no match; its null ends in no span.
    pairs = F.filter(F.arrays_zip(between.alias("gap"), matches.alias("match")), lambda p: p["match"].isNotNull())
    located = F.flatten(_bound(pairs, lambda p: _in_blocks(p, state, block))["done"])
    confirmed = F.filter(located, lambda s: valid(kind, s["match"]))
    scored = F.transform(
        confirmed,
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                           s["match"].alias("match"), _score(kind, s["before"]).alias("score")),
    )
    return F.when(F.regexp_like(text, F.lit(_HINTS[kind])), scored).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` (needs ``text``) with ``pii``: an array of (kind, start,
    end, match, score), by kind as listed and then by start. An input column
    called ``pii`` is replaced."""
    text = text_or_empty()
    return docs.withColumn("pii", F.concat(*[spans_of(k, text) for k in kinds]))


def redact(docs: DataFrame, min_score: float = 0.0, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with every span of ``min_score`` or more replaced by its
    kind in angle brackets; of overlapping spans the first start wins, and
    what the others cover beyond it goes with it. A null text stays null."""
    found = find_pii(docs, kinds)
    spans = F.array_sort(
        F.transform(
            F.filter("pii", lambda s: s["score"] >= min_score),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )

    def step(acc: Column, s: Column) -> Column:
        to = F.greatest(acc["at"], s["end"])
        new = F.concat(acc["out"], _from(acc["rest"], F.lit(0), s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(
            to.alias("at"), _from(acc["rest"], to - acc["at"]).alias("rest"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(new).alias("out"),
        )

    def block(acc: Column, some: Column) -> Column:
        # A block's steps cut only the text up to its furthest end.
        reach = F.greatest(acc["at"], F.array_max(F.transform(some, lambda s: s["end"]))) - acc["at"]
        head = _from(acc["rest"], F.lit(0), reach)
        return F.aggregate(
            some, F.struct(acc["at"].alias("at"), head.alias("rest"), F.lit("").alias("out")), step,
            lambda x: F.struct(
                x["at"].alias("at"), _from(acc["rest"], x["at"] - acc["at"]).alias("rest"),
                F.concat(acc["out"], F.array(x["out"])).alias("out"),
            ),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.col("text").alias("rest"), F.array().cast("array<string>").alias("out"))
    done = _bound(spans, lambda s: _in_blocks(s, start, block))
    text = _bound(done, lambda d: F.concat(F.array_join(d["out"], ""), d["rest"]))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), text)).drop("pii")


def _from(text: Column, skip: Column, size: Column | None = None) -> Column:
    """``size`` code points (all that are there) after the first ``skip``."""
    return F.substring(text, (skip + 1).cast("int"), F.char_length(text) if size is None else size.cast("int"))
