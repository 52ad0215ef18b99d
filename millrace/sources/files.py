"""File scans: delimited, raw-line and fixed-width text, file names and footers. All columns are
strings; nothing is inferred. Columns are found by name, so a reordered file loads correctly."""

from __future__ import annotations

import csv
import fnmatch
import io
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import stated
from millrace.plans.contract import Value

# Date tokens of file patterns; each stands for as many digits as it has letters.
DATE_TOKENS = ("CCYYMMDDHHMMSS", "YYYYMMDDHHMMSS", "CCYYMMDD", "YYYYMMDD", "HHMMSS", "CCYY", "YYYY", "HHMM", "MM", "DD", "HH", "SS")
#: A token that no letter or digit touches, or the wildcard; longer tokens are tried first.
_VARIABLE = re.compile(rf"(?<![^\W_])(?:{'|'.join(DATE_TOKENS)})(?![^\W_])|\*")


class UnrecognizedFile(ValueError):
    """A file's name matches no pattern of its feed."""


def name_pattern(pattern: str) -> re.Pattern:
    """A file pattern as an expression for whole names, without case: a free-standing date token is
    its digits, ``*`` is anything, and all else is literal."""
    fixed = [re.escape(x) for x in _VARIABLE.split(pattern)]
    free = [".*" if x == "*" else rf"\d{{{len(x)}}}" for x in _VARIABLE.findall(pattern)]
    return re.compile("".join(x for pair in zip(fixed, [*free, ""], strict=True) for x in pair) + r"\Z", re.IGNORECASE)


def admit(name: str, patterns: list[str]) -> str:
    """The pattern that the file's name matches."""
    for p in patterns:
        if name_pattern(p).match(name):
            return p
    raise UnrecognizedFile(name)


def expand_codes(pattern: str, token: str, codes: list[str]) -> tuple[list[str], bool]:
    """A pattern for each code if it holds the token, else the pattern; and whether the token stands
    for codes that nobody has stated."""
    if token not in pattern:
        return [pattern], False
    return [pattern.replace(token, c) for c in codes] or [pattern], not codes


def delimiter_of(first: str | None, second: str | None, stated_format: str = "", name: str = "") -> Value[str]:
    """A feed's delimiter. What documents state comes first, a character or a word for one, and two
    that state different ones contradict each other; a fixed-width format has none; else a format or
    the file's extension proposes one; else it is a question. ``functions.stated`` has the same over
    a table of feeds."""
    named = [c for c in map(_delimiter, (first, second)) if c]
    if len(set(named)) > 1:
        return Value(None, "question", f"{first!r} and {second!r} are stated")
    if named:
        return Value(named[0], basis="stated")
    form = " ".join(stated_format.lower().split())
    if any(word in form for word in stated.FIXED_WIDTH):
        return Value("", basis="fixed width")
    for found, basis in ((stated.FORMATS.get(form), "format"), (stated.FORMATS.get(name.strip().lower().rpartition(".")[2]) if "." in name else None, "extension")):
        if found:
            return Value(found, "proposed", basis)
    return Value(None, "question", "no delimiter is stated")


def _delimiter(text: str | None) -> str | None:
    """The one character that a stated delimiter names."""
    if not text or len(text) == 1:
        return text
    t = text.strip()
    if len(t) == 1 or t.lower() == "\\t":
        return "\t" if len(t) > 1 else t
    named = {stated.DELIMITER_WORDS[w] for w in re.findall("[a-z]+", t.lower()) if w in stated.DELIMITER_WORDS} | set(re.findall(r"[|^~]|[,;:](?=\S)", t))
    return named.pop() if len(named) == 1 else None


def address(container: str, path: str, host: str, scheme: str = "abfss") -> str:
    """The URI of ``path`` in a container of ``host``; what is a URI already stays."""
    return path if "://" in path else f"{scheme}://{container}@{host}/{path.lstrip('/')}"


def archive(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Moves files into ``folder`` and returns where they are now; a file of that name that is there
    already is an error, before anything moves."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    moves = [(jvm.org.apache.hadoop.fs.Path(p), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{p.rstrip('/').rpartition('/')[2]}")) for p in paths]
    there = [str(to) for _, to in moves if to.getFileSystem(conf).exists(to)]
    if there:
        raise FileExistsError(", ".join(there))
    for source, to in moves:
        filesystem = to.getFileSystem(conf)
        filesystem.mkdirs(to.getParent())
        if not filesystem.rename(source, to):
            raise OSError(f"{source} could not be moved")
    return [to.toString() for _, to in moves]


def read_table(spark: SparkSession, name: str, columns: list[str], rows: int) -> DataFrame:
    """The first ``rows`` (1 to 10,000) rows of some columns of a catalogue table. Names are plain
    identifiers, so nothing else gets into a plan."""
    for part in (*name.split("."), *columns):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", part):
            raise ValueError(f"not an identifier: {part!r}")
    if not 1 <= rows <= 10_000:
        raise ValueError(f"1 to 10,000 rows, not {rows}")
    return spark.table(name).select(*columns).limit(rows)


def discover(spark: SparkSession, folder: str, pattern: str, modified_on: str | None = None) -> list[str]:
    """Sorted paths of the folder's files whose name matches, changed on a day (UTC) if one is given."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    filesystem = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in filesystem.listStatus(root):
        day = status.getModificationTime() // 86_400_000
        wanted = None if modified_on is None else _day(modified_on)
        if status.isFile() and fnmatch.fnmatch(status.getPath().getName(), pattern) and wanted in (None, day):
            found.append(status.getPath().toString())
    return sorted(found)


def _day(date: str) -> int:
    from datetime import date as d

    return d.fromisoformat(date).toordinal() - d(1970, 1, 1).toordinal()


def read_delimited(spark: SparkSession, paths: str | list[str], delimiter: str = ",", columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Text columns by the header's names and ``_source_file``; ``columns`` picks some by name. Files
    are read in splits, unless quoted fields may hold line ends (``multi_line``): then one task
    reads a file."""
    df = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("inferSchema", False).csv(paths)
    names = columns or df.columns
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in names), F.col("_metadata.file_path").alias("_source_file"))


def _row_order() -> tuple[Column, Column]:
    """What a file's rows are in order by: the start of the split that a task read, and the row's
    number in that task."""
    return F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")


def first_records(spark: SparkSession, paths: list[str], delimiter: str = ",", most: int = 1 << 16) -> dict[str, list[str]]:
    """The fields of each file's first record, read from its first ``most`` bytes by the driver,
    which has listed the files anyway: no job, however many they are. Quoted fields may hold
    delimiters and line ends; compressed files are unpacked; of a folder the first file counts."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        filesystem = path.getFileSystem(conf)
        if filesystem.getFileStatus(path).isDirectory():
            inside = sorted(s.getPath().toString() for s in filesystem.listStatus(path) if s.isFile() and s.getPath().getName()[0] not in "._" and s.getLen())
            if not inside:
                out[p] = []
                continue
            path = jvm.org.apache.hadoop.fs.Path(inside[0])
        stream, codec = filesystem.open(path), codecs.getCodec(path)
        try:
            stream = codec.createInputStream(stream) if codec is not None else stream
            head = jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most))
        finally:
            stream.close()
        text = bytes(head).decode("utf-8", "replace").removeprefix("\ufeff")
        out[p] = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), [])
    return out


def read_headed(spark: SparkSession, headers: dict[str, list[str]], delimiter: str, multi_line: bool = False) -> list[DataFrame]:
    """The files of :func:`first_records` as text columns by their names and ``_source_file``: a frame
    for each different header, of which a feed has few, so files may differ in order and columns.
    A name that a header repeats counts where it stands first."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, found in headers.items():
        groups.setdefault(tuple(found), []).append(path)
    out = []
    for found, paths in groups.items():
        names = [c.strip() for c in found]
        unique = [c if c and c not in names[:i] else f"_c{i}" for i, c in enumerate(names)]
        schema = StructType([StructField(c, StringType()) for c in unique])
        df = spark.read.schema(schema).option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(paths)
        out.append(df.select(*(F.col(f"`{c}`") for c in unique), F.col("_metadata.file_path").alias("_source_file"), *_row_order()))
    return out


def read_unheaded(spark: SparkSession, paths: list[str], names: list[str], delimiter: str, multi_line: bool = False) -> DataFrame:
    """Files without a header row: the columns are ``names``, by position."""
    schema = StructType([StructField(c, StringType()) for c in names])
    df = spark.read.schema(schema).option("header", False).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(paths)
    return df.select(*(F.col(f"`{c}`") for c in names), F.col("_metadata.file_path").alias("_source_file"), *_row_order())


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, _source_file, and _block and _id, by which lines of a file are in order."""
    df = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_source_file"), *_row_order())
    return df.where(F.length(F.trim("value")) > 0)


def split_fields(line: Column | str, delimiter: str) -> Column:
    """Fields of a line, trailing empty ones kept; any delimiter is taken literally."""
    return F.split(line, re.escape(delimiter).replace("\\ ", " "), -1)


def slice_fields(line: str, layout: list[tuple[str, int, int]]) -> list[Column]:
    """Columns of a fixed-width line from (name, start from 1, length)."""
    return [F.substring(line, start, length).alias(name) for name, start, length in layout]


def drop_footer(df: DataFrame) -> DataFrame:
    """Lines but the last of each file. The last one is a maximum, joined back a row a file."""
    last = df.groupBy("_source_file").agg(F.max(F.struct("_block", "_id")).alias("_last"))
    return df.join(last, "_source_file").where(F.struct("_block", "_id") != F.col("_last")).drop("_last")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def loaded_name(spark: SparkSession, paths: list[str], column: str = "_source_file") -> Column:
    """The name under which a row's file loads: the last part of the one of ``paths`` that it lies
    under. What Spark says about a row's path is encoded, so names are decoded again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    depths = {str(p.getFileSystem(conf).makeQualified(p).toUri().getPath()).rstrip("/").count("/") for p in full}
    # the path's own parts, without scheme and host
    parts = F.split(F.regexp_replace(column, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    names = F.array(*(F.lit(p.rstrip("/").rpartition("/")[2]) for p in paths)) if len(depths) > 1 else None
    found = [F.url_decode(F.replace(F.get(parts, F.lit(d)), F.lit("+"), F.lit("%2B"))) for d in sorted(depths)]
    if names is None:
        return found[0]
    return F.coalesce(*(F.when(F.array_contains(names, c), c) for c in found))


def keyed_codes(names: DataFrame, *codes: DataFrame, least: int = 3) -> DataFrame:
    """name and code of files whose name holds, between other than letters and digits, keys of
    exactly one code. names: name; codes: key and code; shorter keys never match. Of several sources
    the first that knows a key of the name decides, even if it can't tell which code it is."""
    words = names.select("name", F.explode(F.array_distinct(F.split(F.lower("name"), "[^a-z0-9]+"))).alias("_key"))
    keys = reduce(DataFrame.unionByName, (c.where(F.length("key") >= least).select(F.lower("key").alias("_key"), "code", F.lit(i).alias("_source")) for i, c in enumerate(codes)))
    found = words.join(keys, "_key").groupBy("name", "_source").agg(F.countDistinct("code").alias("_k"), F.min("code").alias("code"))
    first = found.groupBy("name").agg(F.min(F.struct("_source", "_k", "code")).alias("m"))
    return first.where("m._k = 1").select("name", "m.code")


def first_of_file(df: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("_source_file").orderBy("_block", "_id")) == 1
