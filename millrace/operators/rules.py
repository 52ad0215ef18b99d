"""The registry of data-quality rules, applied in order; a rule of another kind is reported, never
guessed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import as_date, reformat_date
from millrace.operators.quality import cast_columns, dedup, split_mandatory
from millrace.operators.recycle import lookup


@dataclass(frozen=True)
class Rule:
    """kind: a key of REGISTRY; columns: what it works on; options: formats, types, values."""

    kind: str
    columns: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass
class Outcome:
    rows: DataFrame
    rejected: list[DataFrame] = field(default_factory=list)
    not_done: list[str] = field(default_factory=list)


def _trim(df: DataFrame, r: Rule) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in r.columns})


def _cast(df: DataFrame, r: Rule) -> DataFrame:
    types = {c: t for c, t in zip(r.columns, r.options["types"], strict=True) if t}
    return cast_columns(df, types, r.options.get("check", True)) if types else df


def _date(df: DataFrame, r: Rule) -> DataFrame:
    return df.withColumns({c: as_date(c, r.options["format"]) for c in r.columns})


def _date_format(df: DataFrame, r: Rule) -> DataFrame:
    return df.withColumns({c: reformat_date(c, r.options["format"], r.options["to"]) for c in r.columns})


def _dedup(df: DataFrame, r: Rule) -> DataFrame:
    keys = list(r.columns) or df.columns
    return dedup(df, keys, [F.col(c).asc_nulls_first() for c in df.columns])


def _custom(df: DataFrame, r: Rule) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in zip(r.columns, r.options["values"], strict=True)})


REGISTRY: dict[str, Callable[[DataFrame, Rule], DataFrame]] = {
    "lr_trim": _trim,
    "data_type_cast": _cast,
    "date_conversion": _date,
    "date_format": _date_format,
    "dedup": _dedup,
    "add_custom_columns": _custom,
}
NEEDS = {"date_conversion": ("format",), "date_format": ("format", "to"), "data_type_cast": ("types",), "add_custom_columns": ("values",)}


def apply_rules(df: DataFrame, rules: list[Rule]) -> Outcome:
    """Rules in order. null_check parts rows with a blank mandatory column; a rule of an unknown
    kind, or without an option it needs, is listed in ``not_done``."""
    out = Outcome(df)
    for r in rules:
        if r.kind == "null_check":
            out.rows, bad = split_mandatory(out.rows, list(r.columns))
            out.rejected.append(bad)
        elif r.kind not in REGISTRY:
            out.not_done.append(f"{r.kind}: no such rule")
        elif missing := [o for o in NEEDS.get(r.kind, ()) if not r.options.get(o)]:
            out.not_done.append(f"{r.kind}: {', '.join(missing)} not stated")
        else:
            out.rows = REGISTRY[r.kind](out.rows, r)
    return out


@dataclass
class Routed:
    """What rules leave of a file's segments: frames by segment, those among them that go to tables
    of their own, what a lookup missed, and what wasn't done."""

    frames: dict[str, DataFrame]
    separate: list[str] = field(default_factory=list)
    missed: list[DataFrame] = field(default_factory=list)
    not_done: list[str] = field(default_factory=list)


def apply_to_segments(frames: dict[str, DataFrame], rules: list[Rule], detail: str, reference: DataFrame | None = None) -> Routed:
    """Rules in order over all segments of a file: custom columns go on all but the detail records,
    header_trailer_split gives those segments tables of their own, and is an error where a file has
    no other segment, referential_check parts detail records that the ``reference`` lacks, and any
    other rule works on the detail records."""
    out = Routed(dict(frames))
    others = [s for s in frames if s != detail]
    for r in rules:
        if r.kind == "header_trailer_split":
            if not others:
                raise ValueError("a header and trailer split needs a file with such records")
            out.separate = others
        elif r.kind == "add_custom_columns" and others:
            for s in others:
                done = apply_rules(out.frames[s], [r])
                out.frames[s], out.not_done = done.rows, out.not_done + done.not_done
        elif r.kind == "referential_check":
            if reference is None or len(r.columns) != 1:
                out.not_done.append("referential_check: no reference or key stated")
                continue
            out.frames[detail], missed = lookup(out.frames[detail], r.columns[0], reference)
            out.missed.append(missed)
        else:
            done = apply_rules(out.frames[detail], [r])
            out.frames[detail], out.not_done = done.rows, out.not_done + done.not_done
            out.missed += done.rejected
    return out
