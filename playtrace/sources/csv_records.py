"""CSV records that go over several lines, from files that are read in pieces.

Whether a line begins a record depends on all lines before it: a quoted cell may be open. Each
line is therefore taken as a function of one bit, "a quoted cell is open", to the same bit at
its end. Such functions compose. Pieces are cut into chunks of lines; the bit at the start of every chunk
follows from one row per chunk, and the bit at the start of every line from the lines of its chunk. Lines of one record
are joined in their chunk; only what a border of chunks cuts is moved again.

Cells are read as Spark's reader does: a quote opens a cell only at its beginning, a doubled one inside it is text,
and behind the closing quote everything up to the next separator belongs to the cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from playtrace.operators.sequence import broadcast_up_to
from playtrace.scratch import saved

_QUOTE = '"'
# Lines of a chunk. Spark's windows hold so many rows without a sorter of their own.
_CHUNK = 4096


def _is_open(line: Column, at_start: bool, trim: bool) -> Column:
    """Whether a quoted cell is open at the end of ``line``, given whether one is at its start."""

    def unpaired(text: Column) -> Column:
        return F.contains(F.replace(text, F.lit(_QUOTE * 2), F.lit("")), F.lit(_QUOTE))

    def after(is_open: Column, cell: Column) -> Column:
        begun = F.ltrim(cell) if trim else cell
        opens = F.startswith(begun, F.lit(_QUOTE)) & ~unpaired(F.substr(begun, F.lit(2)))
        return F.when(is_open, ~unpaired(cell)).otherwise(opens)

    plain = ~F.contains(line, F.lit(_QUOTE))
    folded = F.aggregate(F.split(line, ","), F.lit(at_start), after)
    return F.when(plain, F.lit(at_start)).otherwise(folded)


def _bit(df: DataFrame, name: str, window: WindowSpec, start: Column, closed: str, opened: str) -> DataFrame:
    """Add ``name``: the bit before each row, from ``start`` and the rows' functions.

    ``closed`` and ``opened`` are a row's bit behind it, if the bit before is false or true. From the last row
    before that does not depend on its own start, the bit only changes at rows that turn it.
    """
    begin = Window.unboundedPreceding
    turns = F.col(closed) & ~F.col(opened)
    df = df.withColumn("_turns", F.sum(turns.cast("int")).over(window.rowsBetween(begin, 0)))
    fixed = F.when(F.col(closed) == F.col(opened), F.struct(F.col(closed).alias("bit"), F.col("_turns").alias("turns")))
    before = window.rowsBetween(begin, -1)
    df = df.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before))
    df = df.withColumn("_before", F.coalesce(F.last("_turns").over(before), F.lit(0)))
    since = F.col("_before") - F.coalesce(F.col("_fixed.turns"), F.lit(0))
    bit = F.coalesce(F.col("_fixed.bit"), start) != (since % 2 == 1)
    return df.withColumn(name, bit).drop("_turns", "_fixed", "_before")


def _lines(spark: SparkSession, paths: Sequence[str], trim: bool) -> DataFrame:
    """``(file, piece, place, line, returns, closed, opened)``; ``place`` is in the order of the piece, without gaps."""
    lines = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
        F.endswith("value", F.lit("\r")).alias("returns"),
    )
    return lines.withColumns(
        {"closed": _is_open(F.col("line"), False, trim), "opened": _is_open(F.col("line"), True, trim)}
    )


def _in_chunks(lines: DataFrame) -> DataFrame:
    """Add ``chunk``: the place of the first line of each ``_CHUNK`` lines of a piece."""
    pieces = saved(lines.groupBy("file", "piece").agg(F.min("place").alias("first")))
    pieces = broadcast_up_to(pieces, pieces.count())
    chunk = F.col("place") - (F.col("place") - F.col("first")) % _CHUNK
    return lines.join(pieces, ["file", "piece"]).withColumn("chunk", chunk).drop("first")


def _chunks(lines: DataFrame) -> DataFrame:
    """``(chunk, file, piece, is_open, before, returns)``: the bit at the start of each chunk, records begun before
    it, and whether the file's first line ends with a carriage return."""
    window = Window.partitionBy("chunk").orderBy("place")
    df = lines.select("chunk", "place", "closed", "opened").repartition("chunk")
    for name, start in (("if_closed", False), ("if_open", True)):
        df = _bit(df, name, window, F.lit(start), "closed", "opened")

    def behind(name: str) -> Column:
        return F.max_by(F.when(F.col(name), F.col("opened")).otherwise(F.col("closed")), "place")

    chunks = df.groupBy("chunk").agg(
        behind("if_closed").alias("closed"),
        behind("if_open").alias("opened"),
        F.count_if(~F.col("if_closed")).alias("begun_closed"),
        F.count_if(~F.col("if_open")).alias("begun_open"),
    )
    # File names only go with the first line of each chunk.
    firsts = lines.where("place = chunk").select("chunk", "file", "piece", "returns")
    chunks = chunks.join(firsts, "chunk")
    files = Window.partitionBy("file").orderBy("piece", "chunk")
    chunks = _bit(chunks, "is_open", files, F.lit(False), "closed", "opened")
    begun = F.when(F.col("is_open"), F.col("begun_open")).otherwise(F.col("begun_closed"))
    before = F.sum(begun).over(files.rowsBetween(Window.unboundedPreceding, -1))
    returns = F.first("returns").over(files.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.select(
        "chunk", "file", "piece", "is_open", F.coalesce(before, F.lit(0)).alias("before"), returns.alias("returns")
    )


def _fragments(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(file, piece, chunk, number, record, whole)``: what each chunk holds of a record; most are whole."""
    window = Window.partitionBy("chunk").orderBy("place")
    df = lines.select("chunk", "place", "line", "closed", "opened").repartition("chunk")
    df = df.join(chunks.drop("file", "piece"), "chunk")
    df = _bit(df, "inside", window, F.col("is_open"), "closed", "opened")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("number", F.col("before") + F.sum((~F.col("inside")).cast("long")).over(upto))
    df = df.withColumn("goes_on", F.when(F.col("inside"), F.col("opened")).otherwise(F.col("closed")))
    several = F.col("returns") & (F.col("inside") | F.col("goes_on"))
    line = F.when(several, F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    parts = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    text = F.array_join(F.transform(parts, lambda p: p["line"]), "\n")
    # The rows of a chunk are in one task already, so this moves none.
    found = df.groupBy("chunk", "number").agg(
        text.alias("record"), (F.bool_or(~F.col("inside")) & F.bool_or(~F.col("goes_on"))).alias("whole")
    )
    files = chunks.select("chunk", "file", "piece")
    return found.join(files, "chunk").select("file", "piece", "chunk", "number", "record", "whole")


def records(spark: SparkSession, paths: Sequence[str], trim: bool = False) -> DataFrame:
    """``(file, number, record)``: the raw text of every record of the files, from number 1 in each.

    A record's line breaks are kept, but where a file's first line ends with ``\\r\\n``, all of those are
    ``\\n``, as Spark reads them; a carriage return at the end of a record goes. Empty lines between
    records are records without text. Files that end their lines with a carriage return alone are not for
    this function (see ``has_bare_returns``). A quote that opens a cell and is never closed makes one record
    of all lines behind it, as in any reader of such files.

    Lines and records are saved once each. Line texts are shuffled once, and no window is longer than a chunk.
    """
    lines = _in_chunks(saved(_lines(spark, paths, trim)))
    chunks = saved(_chunks(lines))
    chunks = broadcast_up_to(chunks, chunks.count())
    fragments = saved(_fragments(lines, chunks))
    whole = fragments.where("whole").select("file", "number", "record")
    parts = F.sort_array(F.collect_list(F.struct("piece", "chunk", "record")))
    text = F.array_join(F.transform(parts, lambda p: p["record"]), "\n")
    joined = fragments.where("not whole").groupBy("file", "number").agg(text.alias("record"))
    return whole.union(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def has_bare_returns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file``: those with a carriage return inside a line; it may be a line's end or text of a cell."""
    lines = spark.read.text(list(paths), lineSep="\n")
    return lines.where(F.col("value").rlike("\r.")).select(F.col("_metadata.file_path").alias("file")).distinct()
