"""Gold tables from mapped sources: joins, filters and column expressions of a contract, as one
DataFrame plan a source set and their union. Expressions are Spark columns or SQL text; anything
that the contract leaves open stops the plan instead of being guessed."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quality import LossyCast
from millrace.plans.contract import OpenQuestions, Value


@dataclass(frozen=True)
class Join:
    """kind: inner or left; using: columns of the same name; on: pairs (left, right) of names."""

    table: str
    kind: str = "inner"
    using: tuple[str, ...] = ()
    on: tuple[tuple[str, str], ...] = ()
    state: str = "filled"


@dataclass(frozen=True)
class SourceSet:
    base: str
    joins: tuple[Join, ...] = ()
    filters: tuple[Value, ...] = ()


@dataclass(frozen=True)
class GoldColumn:
    name: str
    type: str
    expression: Value


@dataclass(frozen=True)
class GoldFeed:
    target: str
    columns: tuple[GoldColumn, ...]
    sources: tuple[SourceSet, ...]

    def questions(self, accept_proposed: bool = False) -> list[str]:
        """What is open, all at once."""
        values = [(f"column {c.name}", c.expression) for c in self.columns] + [(f"filter of {s.base}", v) for s in self.sources for v in s.filters]
        out = [f"{what}: {v.basis}" for what, v in values if v.value is None or (v.state == "proposed" and not accept_proposed)]
        for s in self.sources:
            for j in s.joins:
                if not j.using and not j.on:
                    out.append(f"join of {s.base} with {j.table}: no condition stated")
                elif j.state == "proposed" and not accept_proposed:
                    out.append(f"join of {s.base} with {j.table}: proposed")
        return out


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _selected(feed: GoldFeed, tables: dict[str, DataFrame], accept_proposed: bool) -> list[DataFrame]:
    """The rows of each source set after its joins and filters, not yet projected."""
    if open_ := feed.questions(accept_proposed):
        raise OpenQuestions("; ".join(open_))
    sets = []
    for s in feed.sources:
        df = tables[s.base].alias(s.base)
        for j in s.joins:
            right = tables[j.table].alias(j.table)
            condition = list(j.using) if j.using else reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in j.on])
            df = df.join(right, condition, j.kind)
        for v in s.filters:
            df = df.where(_column(v.get(accept_proposed)))
        sets.append(df)
    return sets


def cast_audit(feed: GoldFeed, tables: dict[str, DataFrame], accept_proposed: bool = False) -> DataFrame:
    """source_set (from 1), column_name, to_type and rows_lost: values that are there, and that the
    target's type can't hold. One aggregate a source set, for all columns; the rows with losses."""
    out = []
    for n, df in enumerate(_selected(feed, tables, accept_proposed), 1):
        each = [(c, _column(c.expression.get(accept_proposed))) for c in feed.columns]
        lost = [F.count_if(x.isNotNull() & (F.trim(x.cast("string")) != "") & x.try_cast(c.type).isNull()).alias(c.name) for c, x in each]
        rows = F.array(*(F.struct(F.lit(c.name).alias("column_name"), F.lit(c.type).alias("to_type"), F.col(c.name).alias("rows_lost")) for c in feed.columns))
        out.append(df.agg(*lost).select(F.lit(n).alias("source_set"), F.inline(rows)))
    return reduce(DataFrame.unionByName, out).where("rows_lost > 0")


def build(feed: GoldFeed, tables: dict[str, DataFrame], accept_proposed: bool = False, check: bool = True) -> DataFrame:
    """The target's rows. A join without a condition is refused, never crossed; filters stand before
    the projection, where they are pushed to the scans. With ``check`` a value that the target's type
    can't hold stops the plan, with the columns and row counts named but no value shown."""
    sets = _selected(feed, tables, accept_proposed)
    # a source column that already has the target's type can lose nothing
    typed = [df.select(*(_column(c.expression.get(accept_proposed)).alias(c.name) for c in feed.columns)).schema for df in sets]
    safe = all(f.dataType.simpleString() == c.type or c.type == "string" for s in typed for f, c in zip(s.fields, feed.columns, strict=True))
    if check and not safe and (found := cast_audit(feed, tables, accept_proposed).collect()):  # a row a column and set
        raise LossyCast("; ".join(f"{r.column_name} as {r.to_type}: {r.rows_lost} rows" for r in found))
    return reduce(DataFrame.unionByName, [df.select(*(_column(c.expression.get(accept_proposed)).try_cast(c.type).alias(c.name) for c in feed.columns)) for df in sets])


def region_union(regions: list[tuple[str, DataFrame]], ids: tuple[str, ...] = ()) -> DataFrame:
    """Regions' rows under the union of their columns, which are the same whatever their case; null
    where a region lacks one. ``ids`` begin with their region's name, so they stay apart."""
    first: dict[str, str] = {}
    for _, df in regions:
        for c in df.columns:
            first.setdefault(c.lower(), c)
    wanted = {c.lower() for c in ids}
    named = []
    for name, df in regions:
        own = [F.concat(F.lit(f"{name}:"), F.col(c)).alias(first[c.lower()]) if c.lower() in wanted else F.col(c).alias(first[c.lower()]) for c in df.columns]
        named.append(df.select(*own, F.lit(name).alias("region")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def read_manifest(folder: str) -> dict[str, GoldFeed]:
    """A feed for each target table of a mapping folder: ``_manifest.json`` and a JSON file a table.

    A mapping row that names a source field and no edit is that field; one with an edit, a selection
    or several source tables states them in words, so they are questions. Texts are read on the
    driver: a contract is a document, not data."""
    with open(os.path.join(folder, "_manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    out = {}
    for entry in manifest["tables"]:
        with open(os.path.join(folder, entry["json_file"]), encoding="utf-8") as f:
            table = json.load(f)
        rows = [r for r in table["mappings"] if (r.get("target_attribute") or "").strip()]
        text = lambda r, k: (r.get(k) or "").strip()
        tables = list(dict.fromkeys(text(r, "source_table") for r in rows if text(r, "source_table")))
        columns = []
        for r in rows:
            edit = text(r, "mapping_edits")
            plain = text(r, "source_field") and not edit
            value = Value(f"`{text(r, 'source_table')}`.`{text(r, 'source_field')}`" if text(r, "source_table") else f"`{text(r, 'source_field')}`") if plain else Value(None, "question", edit or "no source field")
            columns.append(GoldColumn(text(r, "target_attribute"), text(r, "target_format") or "string", value))
        filters = tuple(Value(None, "question", x) for x in dict.fromkeys(text(r, "selection_criteria") for r in rows) if x)
        base, *more = tables or [entry["target_table"]]
        out[entry["target_table"]] = GoldFeed(entry["target_table"], tuple(columns), (SourceSet(base, tuple(Join(t) for t in more), filters),))
    return out
