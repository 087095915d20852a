"""CSV folders in and out. All columns are text; nothing is inferred."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from playtrace.operators.combine import merge_sources
from playtrace.operators.sequence import broadcast_up_to
from playtrace.scratch import exists, full_path, listing, move, remove, saved
from playtrace.sources.csv_records import has_bare_returns, records

# Never a cell's text; naming it as the null text keeps '' apart from a missing cell.
_NO_NULL_TEXT = "\u0000"
# Never a cell's text either; it marks the end of a record.
_END = "\u0001"
#: Raw text of rows with more cells than the header, if these are kept.
RECORD = "csv_record"


class CsvFile(NamedTuple):
    path: str
    name: str
    bytes: int
    is_folder: bool


def _exactly(path: str) -> str:
    """``path`` with the characters escaped that Spark takes for a pattern."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def list_csv(spark: SparkSession, folder: str, exclude: Sequence[str] = ()) -> list[CsvFile]:
    """The CSV files and CSV tables directly in ``folder``. Reads no content.

    A table is a folder ``x.csv`` of CSV files, see ``table_files``. Names
    that begin with a dot do not count; ``exclude`` holds paths to skip. Spark's readers
    take a name that begins with ``_`` for a file of their own and would pass over it, so
    such an input is an error.
    """
    skip = {full_path(spark, path) for path in exclude}
    found = [
        CsvFile(path, name, size, is_folder)
        for path, name, size, is_folder in listing(spark, folder)
        if name.endswith(".csv") and not name.startswith(".") and path not in skip
    ]
    if hidden := sorted(f.name for f in found if f.name.startswith("_")):
        raise ValueError(f"Spark cannot read files whose names begin with '_': {hidden}")
    return found


def table_files(spark: SparkSession, path: str) -> list[CsvFile]:
    """The files of the table ``path``, a folder, or ``path`` itself if it is a file.

    All files count whatever their names, but for those that begin with a dot and
    ``_SUCCESS``. What Spark's readers would pass over, folders and names that begin with ``_``
    or end in ``._COPYING_``, is an error, and so is a folder without a file.
    """
    parts = [CsvFile(*f) for f in listing(spark, path)]
    parts = [f for f in parts if not f.name.startswith(".") and f.name != "_SUCCESS"]
    if left := sorted(f.name for f in parts if f.is_folder or f.name.startswith("_") or f.name.endswith("._COPYING_")):
        raise ValueError(f"these would be passed over in {path}: {left}")
    if not parts:
        raise ValueError(f"no file in {path}")
    return parts


def read_raw(
    spark: SparkSession, folder: str, exclude: Sequence[str] = (), **options
) -> DataFrame:
    """All CSV files and tables of one folder, stacked. ``exclude`` holds paths to skip.

    Files larger than ``split_bytes`` (by default what Spark gives to one task) are read in pieces:
    those in which no line has an odd number of quotes at their line ends, others by ``csv_records``, which
    tells a line break in a cell from a stray quote. Only a file with carriage returns inside its lines is
    read whole.
    """
    listed = list_csv(spark, folder, exclude)
    files = [f for f in listed if not f.is_folder]
    for table in listed:
        if table.is_folder:
            files += table_files(spark, table.path)
    if not files:
        raise ValueError(f"no CSV file to merge in {folder}")
    return _read_files(spark, files, **options)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """One CSV file or table; large files are split as in ``read_raw``."""
    return _read_files(spark, table_files(spark, path), **options)


def _read_files(spark: SparkSession, files: Sequence[CsvFile], **options) -> DataFrame:
    multi_line = options.pop("multi_line", None)
    if multi_line is not None:
        paths = sorted(_exactly(f.path) for f in files)
        return read_events_csv(spark, paths, multi_line=multi_line, **options)
    split_size = options.pop("split_bytes", None)
    split_size = _split_bytes(spark) if split_size is None else split_size
    long_files = [f.path for f in files if f.bytes > split_size]
    whole = {f.path for f in files} - set(long_files)
    broken = set(_with_open_quotes(spark, long_files))
    if options.get("mode", "PERMISSIVE") != "PERMISSIVE":
        whole, broken = whole | broken, set()
    whole |= (returns := set(_with_bare_returns(spark, sorted(broken))))
    broken -= returns
    in_parts = [path for path in long_files if path not in whole | broken]
    parts = [
        read_events_csv(spark, [_exactly(p) for p in paths], multi_line=multi, **options)
        for paths, multi in ((sorted(whole), True), (sorted(in_parts), False))
        if paths
    ]
    if broken:
        parts.append(_read_records(spark, sorted(broken), **options))
    return merge_sources(*parts)


def _with_bare_returns(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    if not paths:
        return []
    found = has_bare_returns(spark, [_exactly(path) for path in paths])
    return [full_path(spark, row.path) for row in found.select(_decoded("file").alias("path")).collect()]


def _read_records(
    spark: SparkSession,
    paths: Sequence[str],
    *,
    empty_as_null: bool = False,
    trim_values: bool = False,
    surplus: str = "error",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """As ``read_events_csv`` with ``multi_line``, but each file in pieces (see ``csv_records``)."""
    cells = _cells(trim_values)
    exact = [_exactly(path) for path in paths]
    names = spark.read.options(header=True, encoding="UTF-8", multiLine=True, **cells).csv(exact[0]).columns
    found = records(spark, exact, trim_values).where("record != ''")
    firsts = saved(found.groupBy("file").agg(F.min("number").alias("first")))
    found = found.join(broadcast_up_to(firsts, len(paths)), "file")
    different = found.where("number = first").select("record").distinct().limit(2).collect()
    if len(different) > 1:
        raise ValueError(f"the header differs between files: {[row.record for row in different]}")
    rows = found.where("number > first")
    record = _record_name(names)
    inner = f"_{record}"
    columns = [f"c{i}" for i in range(len(names))]
    ddl = ", ".join(f"{c} string" for c in [*columns, inner])
    options = cells | {
        "mode": mode,
        "nullValue": "" if empty_as_null else _NO_NULL_TEXT,
        "columnNameOfCorruptRecord": inner,
        "multiLine": True,
    }
    # All cells at once, so that Spark sees how many a record has.
    parsed = rows.select(F.inline(F.array(F.from_csv("record", ddl, _texts(options)))))
    return _checked(parsed.toDF(*[name.strip() for name in names], inner), record, surplus, cells)


def _decoded(path: str) -> Column:
    """A file's ``_metadata`` path or name, without its URL encoding."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _cells(trim_values: bool) -> dict:
    return {
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": trim_values,
        "ignoreTrailingWhiteSpace": trim_values,
    }


def _texts(options: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}


def _record_name(names: Sequence[str]) -> str:
    record = RECORD
    while record in names:
        record = f"_{record}"
    return record


def _checked(df: DataFrame, record: str, surplus: str, cells: dict) -> DataFrame:
    """``df`` with its raw records in ``_<record>``, of rows that do not fit: those too long are kept or an error."""
    if surplus not in ("error", "keep"):
        raise ValueError(f"surplus is 'error' or 'keep', not {surplus!r}")
    inner = f"_{record}"
    # Spark refuses to read the record alone; the first cell goes with it.
    first = F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit(""))
    raw = F.concat(inner, F.left(first, F.lit(0)))
    too_long = F.col(inner).isNotNull() & _has_surplus(raw, len(df.columns) - 1, cells)
    if surplus == "keep":
        return df.withColumn(inner, F.when(too_long, raw)).withColumnRenamed(inner, record)
    told = F.concat(F.lit("more cells than the header: "), F.left(raw, F.lit(200)))
    return df.where(F.when(too_long, F.raise_error(told).cast("boolean")).otherwise(True)).drop(inner)


def _split_bytes(spark: SparkSession) -> int:
    """Largest piece of a file that one task reads; smaller files are never split."""
    setting = spark.conf.get("spark.sql.files.maxPartitionBytes")
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
    digits = setting.rstrip("bBkKmMgGtT")
    return int(digits) << units[setting[len(digits) :].lower() or "b"]


def _with_open_quotes(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files with a line that holds an odd number of quotes.

    A cell with a line break leaves its quote open at the end of the first line.
    Where every line has an even number, no cell goes on to the next line, and
    cutting the file at line ends gives the same rows.
    """
    if not paths:
        return []
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = (
        spark.read.text([_exactly(path) for path in paths])
        .filter(quotes % 2 == 1)
        .select(_decoded("_metadata.file_path").alias("path"))
    )
    return [full_path(spark, row.path) for row in odd.distinct().collect()]


def read_events_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    multi_line: bool = True,
    empty_as_null: bool = False,
    trim_values: bool = False,
    surplus: str = "error",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """CSV with a header; all files must have the same header in the same order.

    Header names lose surrounding blanks, cell values keep theirs unless
    ``trim_values``. A missing cell is null; ``""`` stays an empty text unless
    ``empty_as_null``. ``multi_line`` allows line breaks in cells, and makes one
    task read a whole file; ``read_raw`` decides it per file and reads large ones in pieces.

    A row with fewer cells than the header gets nulls. A row with more is an error when it
    is read; with ``surplus="keep"`` it stays, and the column ``csv_record`` holds its
    raw text (null for every other row), so that no cell is lost unseen.
    """
    paths = [path] if isinstance(path, str) else list(path)
    options = {"empty_as_null": empty_as_null, "trim_values": trim_values, "surplus": surplus, "mode": mode}
    return csv_lines(spark, spark.read, paths, multi_line=multi_line, **options)


def csv_lines(
    spark: SparkSession,
    reader: DataFrameReader | DataStreamReader,
    path: str | Sequence[str],
    *,
    multi_line: bool,
    empty_as_null: bool = False,
    trim_values: bool = False,
    surplus: str = "error",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """What ``reader`` finds, as ``read_events_csv`` describes it. A stream takes its header from the files that are there."""
    if surplus not in ("error", "keep"):
        raise ValueError(f"surplus is 'error' or 'keep', not {surplus!r}")
    cells = _cells(trim_values)
    common = {"header": True, "encoding": "UTF-8", "multiLine": multi_line, **cells}
    heads = spark.read.options(**common)
    if isinstance(reader, DataStreamReader):
        names = heads.options(recursiveFileLookup=True, pathGlobFilter="*.csv").csv(path).columns
    else:
        names = heads.csv(path[0]).columns
    if not names:
        raise ValueError(f"no CSV file with a header in {path}")
    record = _record_name(names)
    # Without all columns Spark does not see how many cells a row has.
    lines = reader.options(
        **common,
        enforceSchema=False,
        mode=mode,
        nullValue="" if empty_as_null else _NO_NULL_TEXT,
        columnPruning=False,
        columnNameOfCorruptRecord=record,
    )
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, record]])
    df = lines.schema(schema).csv(path).toDF(*[name.strip() for name in names], f"_{record}")
    return _checked(df, record, surplus, cells)


def _has_surplus(record: Column, n: int, cells: dict) -> Column:
    """Whether a raw record has more than ``n`` cells: a mark put behind it is beyond cell ``n + 1``."""
    fields = [f"c{i}" for i in range(n + 1)]
    ddl = ", ".join(f"{f} string" for f in fields)
    parsed = F.from_csv(F.concat(record, F.lit(f",{_END}")), ddl, _texts(cells | {"multiLine": True}))
    return ~F.coalesce(F.array_contains(F.array(*[parsed[f] for f in fields]), _END), F.lit(False))


def write_events_csv(df: DataFrame, path: str, *, replace: bool = False) -> None:
    """Write a folder of CSV part files with header.

    ``replace`` allows an existing ``path``, also one that ``df`` itself reads: the
    rows are written beside it, and take its place when they are complete there. The old table is
    moved aside first, to ``<path>.<id>.old``, and removed last.
    """
    spark = df.sparkSession
    target = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new" if replace else path
    df.write.mode("errorifexists").options(
        header=True,
        quote='"',
        escape='"',
        encoding="UTF-8",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(target)
    if replace:
        # The old table stays beside the new one until that is in its place.
        old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
        if had := exists(spark, path):
            move(spark, path, old)
        move(spark, target, path)
        if had:
            remove(spark, old)
