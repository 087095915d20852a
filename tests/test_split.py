import glob
import os

import pytest

from playtrace.functions.params import parse_params
from playtrace.operators.splitting import (
    base_cols,
    discover_params,
    drop_all_null,
    event_counts,
    event_types,
    param_column_names,
    preview,
    split_by_event,
    split_long,
)
from playtrace.plans import clean_table, merge_folder, process_folder, split_table
from playtrace.sources import read_events_csv, stage_by_event, write_events_csv, write_split

LOG = "idfa string, event string, time string, param string"
DATA = [
    ("u1", "start", "1", '""level"":""3"",""win"":""1""'),
    ("u2", "start", "2", '"level":4'),
    ("u1", "start", "3", None),
    ("u1", "a/b", "4", '"x":null'),
    ("u1", "", "5", '"event":"e","idfa":"i","IDFA":"j"'),
    ("u1", None, "6", '"lost":1'),
    ("u1", "bad", "7", '"a":""'),
    ("u1", "42", "8", '"n":"1","m":null'),
    ("u2", "42", "9", '"n":"2"'),
]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture
def parsed(rows):
    return parse_params(rows(LOG, *DATA))


def check(tables):
    assert set(tables) == {"start", "a/b", "", "bad", "42"}
    assert tables["start"].columns == ["idfa", "event", "time", "level", "win"]
    assert tuples(tables["start"]) == [
        ("u1", "start", "1", "3", "1"),
        ("u1", "start", "3", "", ""),
        ("u2", "start", "2", "4", ""),
    ]
    # an explicit null in every row goes, a missing value does not
    assert tables["a/b"].columns == ["idfa", "event", "time"]
    assert tuples(tables["42"]) == [("u1", "42", "8", None, "1"), ("u2", "42", "9", "", "2")]
    assert tuples(tables["bad"]) == [("u1", "bad", "7")]
    blank = tables[""]
    assert blank.columns == ["idfa", "event", "time", "param_IDFA", "param_event", "param_idfa_"]
    assert tuples(blank) == [("u1", "", "5", "j", "e", "i")]


def test_split(parsed):
    check(split_by_event(parsed))


def test_split_of_a_staged_table(parsed, tmp_path):
    staged = stage_by_event(parsed, str(tmp_path / "stage"))
    assert staged.rows.columns == parsed.columns
    check(split_by_event(staged.rows, rows_of=staged.event))


def test_many_params(rows):
    cell = ",".join(f'"k{i}":"1"' for i in range(6000))
    parsed = parse_params(rows("idfa string, event string, time string, param string", ("u", "e", "t", cell)))
    assert len(split_by_event(parsed)["e"].columns) == 6003


def test_names_that_look_reserved(spark, rows, tmp_path):
    names = ("", "_blank", "_x", ".y")
    data = [("u", name, "t", f'"n":"{i}"') for i, name in enumerate(names)]
    parsed = parse_params(rows("idfa string, event string, time string, param string", *data))
    staged = stage_by_event(parsed, str(tmp_path / "stage"))
    paths = write_split(staged, str(tmp_path / "out"), writers=2)
    assert len(set(paths.values())) == 4
    got = {name: read_events_csv(spark, path).first().n for name, path in paths.items()}
    assert got == {name: str(i) for i, name in enumerate(names)}


def test_few_files_per_event(rows, tmp_path):
    data = [("u", f"e{i % 5}", "t", None) for i in range(300)]
    parsed = parse_params(rows("idfa string, event string, time string, param string", *data).repartition(12))
    stage_by_event(parsed, str(tmp_path / "stage"))
    parts = [f for _, _, files in os.walk(tmp_path / "stage") for f in files if f.endswith(".parquet")]
    assert len(parts) <= 10


def test_small_pieces(parsed):
    assert {r.event for r in event_types(parsed).collect()} == {r[1] for r in DATA}
    counts = {r.event: r.rows for r in event_counts(parsed).collect()}
    assert counts == {"start": 3, "a/b": 1, "": 1, "bad": 1, "42": 2}
    assert sum(counts.values()) == sum(r[1] is not None for r in DATA)
    found = {r.event: r["keys"] for r in discover_params(parsed).collect()}
    assert found["start"] == ["level", "win"] and "bad" not in found
    long = {(r.event, r.key): r.filled_rows for r in split_long(parsed).collect()}
    assert long[("start", "level")] == 2 and long[("42", "m")] == 0
    assert base_cols(parsed).columns == ["idfa", "event", "time"]
    assert [r.time for r in preview(parsed, 3).collect()] == ["1", "2", "3"]


def test_drop_all_null(rows):
    df = rows("a string, `b.c` string, d string", ("x", None, None), ("y", None, ""))
    assert drop_all_null(df).columns == ["a", "d"]


def test_column_names_never_clash():
    names = param_column_names(["Time", "time", "a", "A", "", "param_"])
    assert len({n.lower() for n in names.values()}) == 6
    assert names["A"] == "A" and names["a"] == "param_a"


def test_write_split(spark, parsed, tmp_path):
    staged = stage_by_event(parsed, str(tmp_path / "stage"))
    out = str(tmp_path / "out")
    paths = write_split(staged, out)
    assert sorted(os.listdir(out)) == ["42.csv", "_blank.csv", "a%2Fb.csv", "bad.csv", "start.csv"]
    check({event: read_events_csv(spark, path) for event, path in paths.items()})


def raw_folder(spark, rows, tmp_path):
    folder = str(tmp_path / "raw")
    header = ["idfa", " event", " time", "param"]
    data = DATA + DATA[:3] + [("0000-0000", "start", "1", None), (None, "start", "1", None)]
    write_events_csv(rows(LOG, *data).toDF(*header), folder)
    return folder


def test_whole_folder(spark, rows, tmp_path):
    folder = raw_folder(spark, rows, tmp_path)
    result = process_folder(spark, folder, str(tmp_path / "out"))
    assert result.counts == {
        "rows_before": 14,
        "rows_after": 11,
        "rows_removed": 3,
        "columns": "idfa, event, time, param",
        "original_rows": 11,
        "deleted_rows": 2,
        "remaining_rows": 9,
        "deleted_percent": 18.18,
        "rows_without_event": 2,
        "unreadable_params": 1,
    }
    # '' is a missing event once tables are split
    assert set(result.events) == {"start", "a/b", "bad", "42"}
    assert read_events_csv(spark, result.events["start"]).count() == 3


def test_step_by_step(spark, rows, tmp_path):
    folder = raw_folder(spark, rows, tmp_path)
    merged = merge_folder(
        spark, folder, str(tmp_path / "merged.csv"), keys=["idfa", "event", "time"]
    )
    assert (merged.counts["rows_before"], merged.counts["rows_after"]) == (14, 11)
    assert merged.table.count() == 11
    clean = clean_table(spark, merged.path, None)
    assert clean.path == merged.path
    assert clean.counts["deleted_rows"] == 2
    assert clean.counts["top_before"][0] == ("u1", 7)
    assert dict(clean.counts["top_after"]) == {"u1": 7, "u2": 2}
    assert read_events_csv(spark, merged.path).count() == 9
    paths = split_table(spark, clean.path, str(tmp_path / "events"))
    assert set(paths) == {"start", "a/b", "bad", "42"}
    assert glob.glob(paths["start"] + "/*.csv")


def test_merging_twice_skips_only_its_own_output(spark, rows, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as f:
        f.write("idfa,event\nu,x\n")
    with open(f"{folder}/out.csv", "w") as f:
        f.write("idfa,event\nold,x\n")
    step = merge_folder(spark, folder, str(tmp_path / "elsewhere" / "out.csv"))
    assert sorted(tuples(step.table)) == [("old", "x"), ("u", "x")]
    again = merge_folder(spark, folder, f"{folder}/out.csv")
    assert tuples(again.table) == [("u", "x")]
