"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

DataFrame functions only. A span's place comes from splitting the text by the same pattern that
extracts the matches: gaps and matches alternate, so their lengths add up to code-point offsets.
A span's context is the CONTEXT characters on both sides of it, whatever else was matched there; of
spans of a kind that are that near to each other, as in a list or a column, all have it or none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the patterns must accept. Possessive repeats and the look-behinds change no
# match; they keep long runs linear and the matcher's stack flat.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)[\x22']?\x20{0,3}[=:]\x20{0,3}[\x22']?[a-z0-9+/_.-]{8,}+[\x22']?",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A cheap test that a text must pass before a pattern is tried on it.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": lambda t: t.rlike(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x22']?\x20{0,3}[=:]"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "secret": 0.6}
WORDS = {
    "email": r"e-?mail|contact|courriel|correo",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile",
    "iban": r"iban|bank|account|konto|compte",
    "ssn": r"ssn|social security",
    "secret": r"credential|login|auth|private",
}
CONTEXT = 40
BOOST = 0.2
LEAST = 0.5


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = (F.ascii(F.substr(digits, i + 1, F.lit(1))) - 48) * (i % 2 + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    sums = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), sums % 10 == 0).otherwise(False)


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), small)


def _mod97(match: Column) -> Column:
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(bare)), F.lit(0), add) == 1)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15),
    "iban": _mod97,
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"),
    # of the value, letters and digits both
    "secret": lambda m: m.rlike(r"[=:].*[0-9]") & m.rlike(r"[=:].*[A-Za-z]"),
}


def _by_kind(kind_no: Column, value: Callable[[str], Column]) -> Column:
    """What ``value`` makes of the kind that a number stands for."""
    return reduce(lambda c, k: c.when(kind_no == k, value(KINDS[k])), range(1, len(KINDS)), F.when(kind_no == 0, value(KINDS[0])))


def _confirmed(x: Column) -> Column:
    return _by_kind(x["kind_no"], lambda kind: VALID[kind](x["value"]))


#: Items that are folded at a time; their results are then joined, so no list grows item by item.
CHUNK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(items: Column, first: Column, step: Callable[[Column, Column], Column], result: Callable[[Column], Column], kind: str) -> Column:
    """array<kind> of the results of the states that ``step`` goes through from ``first`` over
    ``items``. Results gather in chunks and those in a list, so n items cost about n ** 2 / CHUNK ** 2
    copied references instead of n ** 2."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda state: F.struct(state.alias("state"), F.array_append(acc["out"], result(state)).alias("out")))

    def chunk(acc: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(acc["state"].alias("state"), empty.alias("out")), one, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def all_of(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(CHUNK)), lambda at: F.slice(rows, at + 1, CHUNK))
        return F.flatten(F.aggregate(parts, F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda r: r["out"]))

    return _let(items, all_of)


_SPAN = "struct<start:int,kind_no:int,end:int,value:string,before:string,after:string>"
_PAIR = "struct<gap:string,hit:string,after:string>"


def _pairs(text: Column, kind: str) -> Column:
    """kind_no and pairs: the gaps between the matches of a kind, each with the match behind it."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), hits.alias("hit"))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), F.when(HINTS[kind](text), pairs).otherwise(F.array().cast("array<struct<gap:string,hit:string>>")).alias("pairs"))


def _proposed(own: Column) -> Column:
    """array<struct<start, kind_no, end, value, before, after>> of a kind's :func:`_pairs`, offsets in
    code points, before validation; before and after: the CONTEXT characters on either side of the
    match. The kind is data here, so the plan holds these folds once, whatever the number of kinds."""
    head = lambda *parts: F.left(F.concat(*(F.left(p, F.lit(CONTEXT)) for p in parts)), F.lit(CONTEXT))
    tail = lambda *parts: F.right(F.concat(*(F.right(p, F.lit(CONTEXT)) for p in parts)), F.lit(CONTEXT))

    def back(state: Column, x: Column) -> Column:
        """From the end of the text: each pair, and in head what stands from its gap on."""
        pair = F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), state["head"].alias("after")).cast(_PAIR)
        return F.struct(head(x["gap"], F.coalesce(x["hit"], F.lit("")), state["head"]).alias("head"), pair.alias("pair"))

    def step(state: Column, x: Column) -> Column:
        hit = F.coalesce(x["hit"], F.lit(""))
        start = state["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), own["kind_no"].alias("kind_no"), (start + F.length(hit)).alias("end"), x["hit"].alias("value"), tail(state["tail"], x["gap"]).alias("before"), x["after"].alias("after")).cast(_SPAN)
        return F.struct((start + F.length(hit)).alias("at"), tail(state["tail"], x["gap"], hit).alias("tail"), span.alias("span"))

    sided = F.reverse(_folded(F.reverse(own["pairs"]), F.struct(F.lit("").alias("head"), F.lit(None).cast(_PAIR).alias("pair")), back, lambda r: r["pair"], _PAIR))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit(None).cast(_SPAN).alias("span"))
    found = F.filter(_folded(sided, begin, step, lambda r: r["span"], _SPAN), lambda x: x["value"].isNotNull())
    return F.when(F.size(own["pairs"]) > 1, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


_TOLD_SPAN = "struct<start:int,kind_no:int,end:int,value:string,told:boolean>"
_TOLD = f"array<{_TOLD_SPAN}>"


def _told(spans: Column) -> Column:
    """``spans`` of one kind, confirmed and in order, with told in place of before and after: whether
    a context word stands near, or near a span that others link to this one, each within CONTEXT
    characters of the next."""

    def own(x: Column) -> Column:
        near = _by_kind(x["kind_no"], lambda kind: F.lower(F.concat(x["before"], F.lit("\n"), x["after"])).rlike(WORDS[kind]))
        return F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), x["value"].alias("value"), near.alias("told")).cast(_TOLD_SPAN)

    def step(last: Column, x: Column) -> Column:
        apart = F.greatest(x["start"] - last["end"], last["start"] - x["end"])
        return F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"), x["value"].alias("value"), (x["told"] | F.coalesce(last["told"] & (apart <= CONTEXT), F.lit(False))).alias("told")).cast(_TOLD_SPAN)

    def passed(rows: Column) -> Column:
        return _folded(rows, F.lit(None).cast(_TOLD_SPAN), step, lambda r: r, _TOLD_SPAN)

    return F.reverse(passed(F.reverse(passed(F.transform(spans, own)))))


def find_pii(df: DataFrame, text: str = "text", least: float = LEAST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``text`` (null read as empty) and ``spans``: an array of
    struct<start, end, kind, value, score> by start, then kind. Offsets are code points, end
    exclusive. A base kind's confirmed span always stays; the others need a score of ``least``. A
    context word counts before and behind a span, and passes along a run of spans of its kind.

    Null or empty text: no spans. Very long texts: a few passes a pattern, of about linear cost (see
    :func:`_folded`). Repeated rows: one result each. An empty table gives an empty one. Other
    columns of ``df`` are dropped, so none can clash.
    """
    out = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = out.withColumn("_pairs", F.array(*(_pairs(F.col("_text"), kind) for kind in KINDS)))
    none = F.array().cast(f"array<array<{_SPAN}>>")
    out = out.withColumn("_found", F.when(F.exists("_pairs", lambda x: F.size(x["pairs"]) > 1), F.transform("_pairs", _proposed)).otherwise(none))
    out = out.withColumn("_sure", F.transform("_found", lambda spans: F.filter(spans, _confirmed)))
    told = F.transform("_sure", lambda spans: F.when(F.size(spans) > 0, _told(spans)).otherwise(F.array().cast(_TOLD)))
    out = out.withColumn("_all", F.flatten(told))

    def scored(x: Column) -> Column:
        score = _by_kind(x["kind_no"], lambda k: F.lit(PRIOR[k])) + F.when(x["told"], BOOST).otherwise(0.0)
        return F.struct(x["start"], x["end"], _by_kind(x["kind_no"], F.lit).alias("kind"), x["value"].alias("value"), F.round(score, 2).alias("score"))

    spans = F.filter(F.transform(F.array_sort("_all"), scored), lambda x: x["kind"].isin(*BASE) | (x["score"] >= least))
    return out.select(*keep, F.col("_text").alias("text"), spans.alias("spans"))


def redact(df: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """``df`` with each span in ``text`` replaced by its kind in angle brackets; of overlapping
    spans the first stands and swallows the rest. All columns stay, rows without spans are
    untouched (null stays null, empty stays empty). Long texts, repeated rows and empty tables are
    as in :func:`find_pii`; columns of ``df`` may have any name."""
    own = [c for c in df.columns]
    found = find_pii(df.withColumn("_row", F.struct(*own)), text, least, keep=("_row",))

    def step(state: Column, x: Column) -> Column:
        piece = F.concat(F.substr(F.col("text"), state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0))), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(x["start"] >= state["at"], piece).otherwise(F.lit("")).alias("piece"))

    pieces = _folded(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("piece")), step, lambda r: r["piece"], "string")
    clean = F.concat(F.array_join(pieces, ""), F.substr(F.col("text"), F.array_max(F.col("spans")["end"]) + 1))
    return found.select(*(F.when(F.size("spans") > 0, clean).otherwise(F.col("_row")[c]).alias(c) if c == text else F.col("_row")[c].alias(c) for c in own))
