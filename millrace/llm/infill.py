"""Fill-in-the-middle: a text is cut into units, two cuts make a prefix, a middle and a suffix, and
their order is changed, with a sentinel before each.

A grammar of units says what may stand on the two sides of a boundary: pairs of neighbouring
character classes. It becomes a pattern of lookarounds that match between two characters and take
none, so Spark's own ``split`` gives pieces that add up to the text. Everything is JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Classes before and after a boundary, as the insides of brackets; None is any character.
GRAMMARS: dict[str, list[tuple[str | None, str | None]]] = {
    # spaces and the word after them; spaces at the end are a token of their own
    "token": [(f"^{SPACE}", SPACE)],
    # words and the spaces between them, each by itself
    "word": [(f"^{SPACE}", SPACE), (SPACE, f"^{SPACE}")],
    # lines with their ends
    "line": [(r"\x0A", None)],
    # up to the mark that ends a sentence, with what stands before the next one
    "sentence": [(r".!?\x0A", SPACE)],
    # code points
    "character": [(None, None)],
}


def boundary(grammar: str) -> str:
    """The pattern that matches, with no width, where a unit of ``grammar`` ends and one begins."""
    either = lambda cls: r"[\x{0}-\x{10FFFF}]" if cls is None else f"[{cls}]"
    return "|".join(f"(?<={either(before)})(?={either(after)})" for before, after in GRAMMARS[grammar])


def units(text: str, grammar: str = "token") -> Column:
    """The units of a text, in order; of an empty text none, of a null one null."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: str, seed: int = 42, n: int = 4) -> list[Column]:
    """``n`` numbers below 2**32 from the digest of the seed and the id; a null id is no digits."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def infill(docs: DataFrame, grammar: str = "token", share: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with n (units), form, prefix, middle, suffix (null if plain) and output.

    form is plain, in which output is the text: if the text is empty (or null), holds a sentinel, or
    isn't among ``share`` percent of the documents; else spm (suffix, prefix, middle) for ``spm``
    percent and psm (prefix, suffix, middle) for the others. Cuts and form depend on the seed and
    doc_id alone, so repeated rows agree and reruns too; a null doc_id is an id of its own. Columns
    of the names made here are replaced.
    """
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    kept = [c for c in docs.columns if c.lower() not in made]
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*kept, text.alias("_text"), F.array(*draws("doc_id", seed)).alias("_h"))
    df = df.withColumn("_units", units("_text", grammar)).withColumn("n", F.size("_units").cast("long"))
    h = [F.col("_h")[k] for k in range(4)]
    first, second = (h[k] % (F.col("n") + 1) for k in (0, 1))
    plain = (F.col("n") == 0) | F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE) | (h[2] % 100 >= share)
    df = df.withColumns({"_a": F.least(first, second).cast("int"), "_b": F.greatest(first, second).cast("int"), "form": F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")})

    def piece(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))

    n = F.col("n").cast("int")
    df = df.withColumns({"prefix": piece(F.lit(1), F.col("_a")), "middle": piece(F.col("_a") + 1, F.col("_b") - F.col("_a")), "suffix": piece(F.col("_b") + 1, n - F.col("_b"))})
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm_ = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    out = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", spm_).otherwise(psm_)
    return df.select(*kept, "n", "form", "prefix", "middle", "suffix", out.alias("output"))


def restore(output: str, form: str) -> Column:
    """The text from an output and its form alone. No piece holds a sentinel, and no sentinel
    overlaps another or a piece's end, so each is where it is first found."""

    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substr(c, F.locate(mark, c) + len(mark))

    out, middle = F.col(output), after(F.col(output), MIDDLE)
    head = before(out, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
