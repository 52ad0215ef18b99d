"""Contracts as values: frozen, checked when made, and built straight into DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Generic, TypeVar

T = TypeVar("T")

# Contract datatypes and Spark's.
TYPES = {
    "string": "string", "int": "int", "integer": "int", "bigint": "bigint", "tinyint": "tinyint", "smallint": "smallint", "timestamp": "timestamp",
    "date": "date", "double": "double", "float": "float", "boolean": "boolean", "decimal": "decimal(10,0)",
}


class ContractError(ValueError):
    """A contract contradicts itself."""


class OpenQuestions(ValueError):
    """A plan needs values that nobody has stated."""


def spark_type(stated: str) -> str:
    """A contract's datatype as Spark's; text types keep their length elsewhere, and a type that
    isn't known is an error, never a guess."""
    t = stated.strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", t):
        return f"decimal({m[1]},{m[2]})"
    if re.fullmatch(r"(?:var)?char\s*\(\s*\d+\s*\)", t):
        return "string"
    if m := re.fullmatch(r"(\w+)\s*\([^)]*[a-z][^)]*\)", t):  # a type with a format
        t = m[1]
    if t not in TYPES:
        raise ContractError(f"unknown datatype {stated!r}")
    return TYPES[t]


@dataclass(frozen=True)
class Value(Generic[T]):
    """A stated value, a proposed one with its basis, or a question (none) with its reason."""

    value: T | None
    state: str = "filled"
    basis: str = ""

    def get(self, accept_proposed: bool = False) -> T:
        if self.value is None or self.state == "question" or (self.state == "proposed" and not accept_proposed):
            raise OpenQuestions(f"{self.state}: {self.basis}")
        return self.value


@dataclass(frozen=True)
class Field:
    """A source column, its stage and standard names, and its marks."""

    source: str
    stage: str
    standard: str
    type: str = "string"
    mandatory: bool = False
    key: bool = False
    sensitive: bool = False


@dataclass(frozen=True)
class Segment:
    """A record type that isn't the feed's own: its marker, which a record begins with, its fields,
    and in a fixed-width file their places, (start from 1, length)."""

    name: str
    marker: str | None
    fields: tuple[Field, ...]
    places: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class Feed:
    """Files, fields and rules of one feed. Files with a header row have neither ``segments`` nor
    ``places``. In others ``detail`` is the marker of the feed's own records; None tells records
    apart by position, by the trailer's marker. ``trailer``: segment and column that state the
    number of detail records. Rows without a mandatory value are rejected; with ``retry_rejects``
    they also wait for the next run. ``header``: files without a header row have their columns by
    position. ``footer``: each file's last record is no data. ``rules`` run on the stage or the
    standard leg. ``options``: load (the load option), needed (values that must not be blank) and
    retention are checked before a run."""

    name: str
    fields: tuple[Field, ...]
    patterns: tuple[str, ...] = ("*",)
    delimiter: str = ","
    reference_key: str | None = None
    window_days: int = 7
    allow_duplicates: bool = True
    multi_line: bool = False
    segments: tuple[Segment, ...] = ()
    detail: str | None = None
    places: tuple[tuple[int, int], ...] = ()
    exact_width: bool = True
    trailer: tuple[str, str] | None = None
    retry_rejects: bool = False
    codes: tuple[str, ...] = ()
    header: bool = True
    footer: bool = False
    rules: tuple = ()
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        stages = [f.stage for f in self.fields]
        if len(set(stages)) != len(stages):
            raise ContractError(f"{self.name}: a stage column is mapped twice")
        for f in self.fields:
            spark_type(f.type)
        if self.reference_key is not None and self.reference_key not in stages:
            raise ContractError(f"{self.name}: {self.reference_key} is no stage column")
        for fields, places in ((self.fields, self.places), *((s.fields, s.places) for s in self.segments)):
            if self.places and len(places) != len(fields):
                raise ContractError(f"{self.name}: fields without a place")
        if self.trailer and not any(s.name == self.trailer[0] and any(f.stage == self.trailer[1] for f in s.fields) for s in self.segments):
            raise ContractError(f"{self.name}: no segment states {self.trailer}")
        if self.retry_rejects and self.reference_key:
            raise ContractError(f"{self.name}: rejects and missed references can't share a recycle table")

    @property
    def keys(self) -> list[str]:
        return [f.stage for f in self.fields if f.key]

    @property
    def mandatory(self) -> list[str]:
        return [f.stage for f in self.fields if f.mandatory]
