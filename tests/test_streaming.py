"""Exports that arrive in steps against the batch operators over all of them."""

import datetime

import pytest

from playtrace.operators.cleaning import drop_invalid_ids
from playtrace.operators.combine import dedup
from playtrace.settings import DEDUP_KEYS
from playtrace.sources import write_events_csv
from playtrace.streaming import first_copies, ingest

LOG = "idfa string, event string, time string, param string"
HEADER = "idfa, event, time,param\n"
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def inbox(spark, tmp_path):
    """``arrive(name, line, ...)`` puts a file into the folder; ``run()`` ingests what is new; ``held()`` reads the table."""
    folder = tmp_path / "in"
    folder.mkdir()

    class Inbox:
        path = str(folder)

        def arrive(self, name, *lines, header=HEADER):
            whole = tmp_path / name
            whole.write_text(header + "".join(f"{line}\n" for line in lines))
            whole.rename(folder / name)

        def run(self, **options):
            return ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), **options)

        def held(self):
            rows = spark.read.parquet(str(tmp_path / "out")).collect()
            return sorted((tuple(r) for r in rows), key=str)

    return Inbox()


def counts(run):
    return run.rows, run.kept, run.copies, run.late, run.invalid


def test_three_steps_give_the_batch_result(spark, inbox):
    from workload.tables import messy_log, two_exports

    first, second = two_exports(spark, SF_DIR)
    steps = [
        first.filter("event_id % 3 < 2"),
        second.unionByName(first.filter("event_id % 3 = 0")),
        messy_log(spark, SF_DIR),
    ]
    total = 0
    for i, step in enumerate(steps):
        write_events_csv(step.drop("event_id"), f"{inbox.path}/{i}.csv")
        run = inbox.run(delay="60 days")
        assert run.rows == step.count() and run.late == 0
        assert run.rows == run.kept + run.copies + run.invalid
        total += run.kept
    everything = first.unionByName(second)
    want = drop_invalid_ids(dedup(everything, DEDUP_KEYS)).select(*DEDUP_KEYS).collect()
    held = inbox.held()
    assert sorted(row[:3] for row in held) == sorted(tuple(r) for r in want)
    assert len(held) == total
    assert set(held) <= {tuple(r) for r in everything.drop("event_id").collect()}
    assert counts(inbox.run(delay="60 days")) == (0, 0, 0, 0, 0)


def test_late_rows_are_counted_and_left_out(inbox):
    inbox.arrive("1.csv", "u,e,2024-01-01 00:00:00,", "u,e,2024-01-11 00:00:00.0019,")
    assert counts(inbox.run(delay="5 days")) == (2, 2, 0, 0, 0)
    # The watermark stands at 2024-01-06 00:00:00.001, and counts milliseconds.
    inbox.arrive(
        "2.csv",
        "u,e,2024-01-01 00:00:00,",
        "u,new,2024-01-06 00:00:00.001,",
        "u,new,2024-01-06 00:00:00.0011,",
        "u,e,2024-01-11 00:00:00.0019,",
        "unknown-adid,e,2024-01-12 00:00:00,",
    )
    assert counts(inbox.run(delay="5 days")) == (5, 1, 1, 2, 1)
    assert [row[2] for row in inbox.held()] == [
        "2024-01-01 00:00:00", "2024-01-11 00:00:00.0019", "2024-01-06 00:00:00.0011",
    ]


def test_wrong_clocks_and_unreadable_times(inbox):
    now = datetime.datetime(2024, 2, 1)
    inbox.arrive("1.csv", "u,e,2099-01-01 00:00:00,", "u,e,2024-01-11 00:00:00,", "u,e,no time,", "u,e,,")
    assert counts(inbox.run(latest=now)) == (4, 4, 0, 0, 0)
    inbox.arrive("2.csv", "u,e,2099-01-01 00:00:00,", "u,e,2024-01-05 00:00:00,", "u,e,no time,", "u,e,,")
    assert counts(inbox.run(latest=now)) == (4, 1, 3, 0, 0)


def test_cells_with_breaks_and_many_files_a_run(inbox):
    for day in range(1, 8):
        cells = f'u,e,2024-01-0{day} 00:00:00,"a, ""b""\nc"'
        inbox.arrive(f"{day}.csv", cells, cells, f"u,e,2024-01-0{day} 00:00:00")
    run = inbox.run(files_per_batch=2)
    assert counts(run) == (21, 7, 14, 0, 0) and run.batches >= 4
    assert [row[:2] for row in inbox.held()] == [("u", "e")] * 7


def test_what_cannot_be_read_stops_the_run(spark, inbox, rows):
    with pytest.raises(ValueError, match="has to be one of the keys"):
        first_copies(rows(LOG), keys=["idfa"])
    inbox.arrive("1.csv", "u,e,2024-01-01 00:00:00,")
    inbox.run()
    inbox.arrive("2.csv", "u,e,2024-01-02 00:00:00,,more")
    with pytest.raises(Exception, match="more cells than the header"):
        inbox.run()
    assert len(inbox.held()) == 1


def test_another_header_stops_the_run(inbox):
    inbox.arrive("1.csv", "u,e,2024-01-01 00:00:00,")
    inbox.run()
    inbox.arrive("2.csv", "e,u,2024-01-02 00:00:00,", header="event,idfa,time,param\n")
    with pytest.raises(Exception, match="(?i)header"):
        inbox.run()
    assert len(inbox.held()) == 1


def test_an_empty_folder_is_an_error(inbox):
    with pytest.raises(Exception, match="(?i)no csv file|unable to infer"):
        inbox.run()
