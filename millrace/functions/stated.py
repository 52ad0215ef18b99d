"""What documents state about fields, as column functions over a table of fields: whole numbers,
widths, lengths, region types, delimiters and classes of types. Each settles a cell in the JVM, so
dictionaries of any size go through one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILLED, PROPOSED, QUESTION, NONE = "filled", "proposed", "question", "none"

#: A whole number, also as a spreadsheet writes one (13.0).
WHOLE = r"^\s*([0-9]+)(?:\.0+)?\s*$"
#: A stated length: a number, or a precision and scale; and the one in a type's parentheses.
LENGTH = r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*$"
IN_TYPE = r"\(\s*([0-9]+(?:\s*,\s*[0-9]+)?)(?:\s+(?:BYTE|CHAR))?\s*\)"
#: Words that name a type without a length.
BARE = r"^[A-Za-z][A-Za-z0-9 ]*$"

# Cells of a region that state no type.
SENTINELS = ("NOT AVAILABLE", "NOT SUPPLIED", "COLUMN NOT FOUND", "NULL")

# What words and formats say about a delimiter, and characters that name themselves.
DELIMITER_WORDS = {"comma": ",", "pipe": "|", "tab": "\t", "semicolon": ";", "caret": "^", "tilde": "~", "colon": ":"}
FORMATS = {"csv": ",", "psv": "|", "tsv": "\t", "pipe": "|"}
FIXED_WIDTH = ("fixed width", "fixed-width", "fixedwidth")

# Classes of equivalent type names; one may be in two.
TYPE_CLASSES = (
    ("string", "varchar", "varchar2", "nvarchar", "char", "nchar", "text", "x", "an", "alphanumeric"),
    ("int", "integer", "bigint", "smallint", "tinyint", "number", "numeric", "9", "n"),
    ("decimal", "numeric", "number", "float", "double", "money", "s9"),
    ("date",),
    ("datetime", "timestamp", "datetime2"),
    ("boolean", "bool", "bit"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _found(c: Column, pattern: str) -> Column:
    """The pattern's group, null where it doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def value(v: Column, state: Column | str, basis: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(v.alias("value"), lit(state).alias("state"), lit(basis).alias("basis"))


def whole(c: Column | str) -> Column:
    """The whole number that a cell states, else null; a precision such as 10,2 is none."""
    return _found(_col(c).cast("string"), WHOLE).try_cast("int")


def width(length: Column | str, start: Column | str, end: Column | str, span: Column | None = None, answer: Column | None = None) -> Column:
    """A fixed-width field's width, as value, state and basis: its stated length, if that is whole and
    not 0, else its places, else the dictionary's span, which is only proposed, else an answer."""
    own, first, last = whole(length), whole(start), whole(end)
    none = F.lit(None).cast("int")
    span, answer = (none if x is None else x for x in (span, answer))
    out = F.when(own > 0, value(own, FILLED, "length")).when(last >= first, value(last - first + 1, FILLED, "places"))
    out = out.when(span.isNotNull(), value(span, PROPOSED, "dictionary")).when(answer.isNotNull(), value(answer, FILLED, "answer"))
    return out.otherwise(value(none, QUESTION, "no width is stated"))


def region_type(c: Column | str) -> Column:
    """type and nullable of a cell of a region's structure: without its comma, its NOT NULL and the
    space before a parenthesis; both null where the cell is blank or a sentinel."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "), r"(\s*,)+\s*$", "")), r"^\s+|\s+$", "")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?i)\s*\bNOT\s+NULL\b", "")), r"(\s*,)+\s*$", ""))
    stated = ~F.upper(text).isin(*SENTINELS, "")
    return F.struct(F.when(stated, F.nullif(F.regexp_replace(bare, r"\s+\(", "("), F.lit(""))).alias("type"), F.when(stated, ~text.rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"))


def column_length(stated: Column | str, kind: Column | str) -> Column:
    """A column's length as text: the stated one; else, only proposed, that of the type in the one cell
    or the other; none where only a type without a length is named; a question for other words."""
    said = F.trim(F.coalesce(_col(stated), F.lit("")))
    own, typed, other = _found(said, LENGTH), _found(said, IN_TYPE), _found(F.coalesce(_col(kind), F.lit("")), IN_TYPE)
    tidy = lambda c: F.regexp_replace(c, r"\s", "")
    none = F.lit(None).cast("string")
    out = F.when(own.isNotNull(), value(said, FILLED, "stated")).when(typed.isNotNull(), value(tidy(typed), PROPOSED, "its own type")).when(other.isNotNull(), value(tidy(other), PROPOSED, "type"))
    return out.when((said == "") | said.rlike(BARE), value(none, NONE, "no length")).otherwise(value(none, QUESTION, F.concat(F.lit("no length: "), said)))


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def delimiter(c: Column | str) -> Column:
    """The one character that a stated delimiter names, by itself, by a word or inside a phrase; null
    if it names none, or two. A comma, semicolon or colon before a space or at the end is
    punctuation."""
    text = _col(c)
    t = F.trim(text)
    words = F.filter(F.transform(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)), lambda w: F.try_element_at(_table(DELIMITER_WORDS), w)), lambda x: x.isNotNull())
    marks = F.regexp_extract_all(t, F.lit(r"[|^~]|[,;:](?=\S)"), F.lit(0))
    named = F.array_distinct(F.concat(words, marks))
    one = F.when(F.size(named) == 1, named[0])
    return F.when(F.length(text) == 1, text).when(F.length(t) == 1, t).when(F.lower(t) == "\\t", "\t").otherwise(one)


def delimiter_of(first: Column | str, second: Column | str, stated_format: Column | str, name: Column | str) -> Column:
    """A feed's delimiter, as value, state and basis. What documents state comes first, and two that
    state different ones are a question; a fixed-width format has none; else the format or the file's
    extension proposes one; else it is a question."""
    a, b = delimiter(first), delimiter(second)
    form = F.lower(F.trim(F.coalesce(_col(stated_format), F.lit(""))))
    fixed = F.lit(False)
    for word in FIXED_WIDTH:
        fixed = fixed | form.contains(word)
    implied = F.try_element_at(_table(FORMATS), form)
    by_name = F.try_element_at(_table(FORMATS), F.lower(F.regexp_extract(F.trim(F.coalesce(_col(name), F.lit(""))), r"\.([A-Za-z0-9]{2,4})$", 1)))
    none = F.lit(None).cast("string")
    out = F.when(a != b, value(none, QUESTION, "two are stated")).when(F.coalesce(a, b).isNotNull(), value(F.coalesce(a, b), FILLED, "stated"))
    out = out.when(fixed, value(F.lit(""), FILLED, "fixed width")).when(implied.isNotNull(), value(implied, PROPOSED, "format")).when(by_name.isNotNull(), value(by_name, PROPOSED, "extension"))
    return out.otherwise(value(none, QUESTION, "no delimiter is stated"))


# Types as a relation.


def base_type(c: Column | str) -> Column:
    """A type's name without what stands in parentheses, case and space; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"\(.*?\)", ""), r"\s+", "")


def class_table(spark: SparkSession, classes: tuple[tuple[str, ...], ...] = TYPE_CLASSES) -> DataFrame:
    """name and class, a row for each name in each class; a contract may bring its own."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("class")) for i, names in enumerate(classes) for n in names))
    return spark.range(1).select(F.inline(rows))


def with_alike(df: DataFrame, left: str, right: str, classes: DataFrame, name: str = "alike") -> DataFrame:
    """``df`` with whether its two types mean the same: equal base types, a blank one on either side,
    or a class of ``classes`` (name and class) that both are in."""
    held = classes.select(base_type("name").alias("_name"), "class").groupBy("_name").agg(F.collect_set("class").alias("_classes"))
    out = df.withColumns({"_l": base_type(left), "_r": base_type(right)})
    for side in "lr":
        out = out.join(held.toDF(f"_{side}", f"_classes_{side}"), f"_{side}", "left")
    shared = F.coalesce(F.arrays_overlap("_classes_l", "_classes_r"), F.lit(False))
    alike = (F.col("_l") == "") | (F.col("_r") == "") | (F.col("_l") == F.col("_r")) | shared
    return out.withColumn(name, alike).drop("_l", "_r", "_classes_l", "_classes_r")


# The same for single values that the driver holds, by the same patterns.


def whole_of(text: str | int | None) -> int | None:
    found = re.match(WHOLE.removesuffix("$") + r"\Z", str(text)) if text is not None else None
    return int(found[1]) if found else None
