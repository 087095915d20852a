"""Per-event storage: a Parquet stage partitioned by event, then one CSV per event."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.operators.splitting import split_by_event
from playtrace.settings import EVENT
from playtrace.sources.csv_files import write_events_csv

# Partition folders cannot be named by an empty text.
_FOLDER = "event_folder"
_BLANK = "_blank"


def _folder(event):
    """The folder of an event. A leading ``_`` of a real name is escaped, so ``_blank`` is free."""
    return F.when(event == "", _BLANK).otherwise(F.regexp_replace(event, "^_", "%5F"))


def _file_name(event: str) -> str:
    name = quote(event, safe=" ")
    if name[:1] in ("_", "."):
        name = f"%{ord(name[0]):02X}{name[1:]}"
    return f"{name or _BLANK}.csv"


class StagedEvents:
    """A parsed log on disk, partitioned by event."""

    def __init__(self, table: DataFrame):
        self.table = table

    def event(self, name: str) -> DataFrame:
        """The rows of one event; Spark lists and reads only its folder."""
        here = F.col(_FOLDER) == _folder(F.lit(name))
        return self.table.filter(here & (F.col(EVENT) == name)).drop(_FOLDER)

    @property
    def rows(self) -> DataFrame:
        return self.table.drop(_FOLDER)


def stage_by_event(parsed: DataFrame, path: str) -> StagedEvents:
    """Write the rows that have an event to ``path``, one folder per event.

    Rows are rebalanced by event first: adaptive execution deals a large event over several
    tasks and joins small ones, so files have about the advisory partition size
    whatever the number of tasks before.
    """
    keyed = parsed.filter(F.col(EVENT).isNotNull()).withColumn(
        _FOLDER, _folder(F.col(EVENT))
    )
    keyed.hint("rebalance", _FOLDER).write.partitionBy(_FOLDER).parquet(path)
    schema = T.StructType(
        [f for f in keyed.schema.fields if f.name != _FOLDER]
        + [T.StructField(_FOLDER, T.StringType())]
    )
    return StagedEvents(parsed.sparkSession.read.schema(schema).parquet(path))


def write_split(
    staged: StagedEvents, out_dir: str, writers: int = 8
) -> dict[str, str]:
    """Write ``<out_dir>/<event>.csv`` for every event; return the paths by event.

    Events have different columns, hence one write per event. Each reads the
    folder of its event and runs on all executors; ``writers`` of them run at once.
    """
    tables = split_by_event(staged.rows, staged.event)
    paths = {event: f"{out_dir.rstrip('/')}/{_file_name(event)}" for event in tables}
    if len(set(paths.values())) < len(paths):
        raise ValueError("two events have the same path")
    # Several writes at once: the last tasks of one event do not leave the
    # cluster idle, and many small events do not wait for each other.
    with ThreadPoolExecutor(max_workers=writers) as pool:
        list(pool.map(lambda event: write_events_csv(tables[event], paths[event]), tables))
    return paths
