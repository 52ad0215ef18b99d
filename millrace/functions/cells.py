"""Column functions over text cells: blanks, masks, guarded casts, normal forms and mapping
expressions. All are built-in expressions, so they stay in the JVM and fold into one projection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column | str) -> Column:
    """Null, or nothing but spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c) == "")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def mask_last(c: Column | str, keep: int = 4) -> Column:
    """Stars for all but the last ``keep`` characters, for all of a shorter value; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) <= keep, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - keep), F.right(c, F.lit(keep))))


def guarded_cast(c: Column | str, to: str) -> Column:
    """The value as type ``to``; blank or unreadable text is null rather than an error."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~blank(c), F.trim(c)).try_cast(to)


def lost(c: Column | str, to: str) -> Column:
    """Whether :func:`guarded_cast` makes null of something."""
    return ~blank(c) & guarded_cast(c, to).isNull()


def as_date(c: Column | str, fmt: str) -> Column:
    return F.try_to_date(F.col(c) if isinstance(c, str) else c, fmt)


def reformat_date(c: Column | str, source: str, target: str) -> Column:
    return F.date_format(as_date(c, source), target)


def tidy_cell(c: Column) -> Column:
    """A cell without case and outer or repeated space; null as ''."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def normal_of(t: Column) -> Column:
    """A tidy cell's normal form, see :func:`normal_cell`. It reads ``t`` several times, so that had
    better be a column."""
    # fixed values: repeated slashes are one but for those of a scheme, and the last ones don't count
    path = F.regexp_replace(F.translate(t, "\\", "/"), "(?<!:)/{2,}", "/")
    path = F.regexp_replace(path, "(?<=.)/+$", "")
    day = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ t]00:00(?::00(?:\.0+)?)?$"
    number = F.regexp_replace(t, r"\.?0+$", "")
    return F.when(t == "null", "").when(t.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), number).when(t.rlike(day), F.substring(t, 1, 10)).otherwise(path)


def normal_cell(c: Column) -> Column:
    """The form in which two cells are compared: no case, no outer or repeated space, the word NULL
    as nothing, decimals without trailing zeros, midnight as its date; slashes go one way, are single
    but behind a colon, and end no path."""
    return normal_of(tidy_cell(c))


def in_any_environment(c: Column, tokens: list[tuple[str, list[str], list[str]]]) -> Column:
    """A normal cell with each environment's own words replaced by what they stand for. tokens: the
    name, literals (as whole words) and patterns of each, applied in order."""
    for token, literals, patterns in tokens:
        for p in (*(f"(?<![a-z0-9]){re.escape(v.lower())}(?![a-z0-9])" for v in literals), *patterns):
            c = F.regexp_replace(c, p, token.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def status_of(expected: Column, actual: Column, x: Column, y: Column, tokens: list[tuple[str, list[str], list[str]]] | None = None) -> Column:
    """:func:`cell_status` of two cells whose normal forms ``x`` and ``y`` are at hand."""
    alike = x == y
    if tokens:
        alike = alike | ((x != "") & (y != "") & (in_any_environment(x, tokens) == in_any_environment(y, tokens)))
    return F.when(F.coalesce(expected, F.lit("")) == F.coalesce(actual, F.lit("")), "exact").when(alike, "normalized").when(x == "", "extra").when(y == "", "missing").otherwise("mismatch")


def cell_status(expected: Column, actual: Column, tokens: list[tuple[str, list[str], list[str]]] | None = None) -> Column:
    """exact, normalized (alike in normal form, or but for environment words), extra (nothing was
    expected), missing (nothing is there) or mismatch; null and '' are the same nothing, and the
    first test that holds decides."""
    return status_of(expected, actual, normal_cell(expected), normal_cell(actual), tokens)


def normal_name(c: Column | str, prefixes: tuple[str, ...] = ()) -> Column:
    """A name without case, known prefixes and repeated separators."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_")
    for p in prefixes:
        t = F.regexp_replace(t, f"^{p}_", "")
    return F.regexp_replace(t, "^_+|_+$", "")


def slot_template(c: Column | str, slots: dict[str, str]) -> Column:
    """Known values replaced by their slot's name, longest first."""
    t = F.col(c) if isinstance(c, str) else c
    for value, name in sorted(slots.items(), key=lambda x: (-len(x[0]), x[0])):
        t = F.replace(t, F.lit(value), F.lit(f"<{name}>"))
    return t


# The mapping vocabulary: what a mapping cell can state, as columns.


def chain(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """IF / THEN / ELSE; an ELSE is needed, as a missing one has no stated value."""
    first, *rest = cases
    return reduce(lambda c, x: c.when(*x), rest, F.when(*first)).otherwise(otherwise)


def if_null(c: Column, value: Column) -> Column:
    return F.coalesce(c, value)


def if_empty(c: Column, value: Column) -> Column:
    """``value`` where the cell is null or an empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), value)


def is_empty(c: Column, or_null: bool = False) -> Column:
    return F.nullif(c, F.lit("")).isNull() if or_null else c == ""


def piece(c: Column, first: int, last: int) -> Column:
    """Characters ``first`` to ``last``, from 1, both included."""
    if last < first:
        raise ValueError(f"a piece from {first} to {last} has no meaning")
    return F.substr(c, F.lit(first), F.lit(last - first + 1))


def joined(*parts: Column) -> Column:
    """Concatenation that is null if a part is."""
    return F.concat(*parts)


# Filters that a selection cell can state.


def one_of(c: Column, values: list) -> Column:
    return c.isin(values)


def within_days(c: Column, today: Column, days: int) -> Column:
    """From ``days`` before ``today`` to ``today``."""
    return (F.to_date(c) >= F.date_sub(today, days)) & (F.to_date(c) <= today)


def in_force(start: Column, end: Column, on: Column) -> Column:
    """Begun by ``on`` and not ended before it."""
    return (start <= on) & (end >= on)


def strictly_between(start: Column, now: Column, end: Column) -> Column:
    return (start < now) & (now < end)
