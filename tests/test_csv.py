import os
import random

import pytest

import playtrace.sources.csv_files as csv_files
import playtrace.sources.csv_records as csv_records
from playtrace.operators.cleaning import drop_invalid_ids
from playtrace.plans import clean_table, split_table
from playtrace.sources.csv_records import records
from playtrace.sources import list_csv, read_events_csv, read_raw, write_events_csv
from tests.test_plans import plan


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v or "") for v in r])


def test_scan_takes_csv_files_of_one_folder(spark, tmp_path):
    folder = str(tmp_path / "raw data")
    put(folder, "a 1%.csv", "idfa, event, time,param\nu1,x,t1,p\n")
    put(folder, "b+[1].csv", "idfa, event, time,param\nu2, y ,t2,\n")
    put(folder, "out.csv", "idfa, event, time,param\nu3,z,t3,\n")
    put(folder, "notes.txt", "no,table\n")
    put(os.path.join(folder, "deeper"), "c.csv", "idfa, event, time,param\nu4,z,t4,\n")
    names = {f.name for f in list_csv(spark, folder)}
    assert names == {"a 1%.csv", "b+[1].csv", "out.csv"}
    df = read_raw(spark, folder, exclude=[f"{folder}/out.csv", "somewhere/a 1%.csv"])
    assert df.columns == ["idfa", "event", "time", "param"]
    assert tuples(df) == [("u1", "x", "t1", "p"), ("u2", " y ", "t2", None)]
    trimmed = read_raw(spark, folder, exclude=[f"{folder}/out.csv"], trim_values=True)
    assert tuples(trimmed)[1] == ("u2", "y", "t2", None)


def test_no_input_vanishes(spark, rows, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "a.csv", "idfa,event\nu1,x\n")
    put(folder, ".b.csv", "idfa,event\nno,no\n")
    write_events_csv(rows("idfa string, event string", ("u2", "y"), ("u3", "z")), f"{folder}/b.csv")
    assert tuples(read_raw(spark, folder)) == [("u1", "x"), ("u2", "y"), ("u3", "z")]
    put(folder, "_c.csv", "idfa,event\nu4,x\n")
    with pytest.raises(ValueError, match="_c.csv"):
        read_raw(spark, folder)


def test_no_file_is_an_error(spark, tmp_path):
    put(str(tmp_path), "x.txt", "")
    with pytest.raises(ValueError, match="no CSV file"):
        read_raw(spark, str(tmp_path))


SURPLUS = (
    'idfa,event,param\nu1,a,"x,y"\nu2,b\nu3,c,"{""k"":""3""}",z\nu4,d,"q""r",\n'
    'u5,e,"two\nlines"\nu6,f,5" a,6" b\nu7,g,\nu8,h,"two\nlines",w\n'
)


def test_surplus_cells_are_loud(spark, tmp_path):
    put(str(tmp_path), "a.csv", SURPLUS)
    path = f"{tmp_path}/a.csv"
    for act in ("collect", "count"):
        with pytest.raises(Exception, match="more cells than the header"):
            getattr(read_events_csv(spark, path).select("event"), act)()
    with pytest.raises(Exception, match="more cells than the header"):
        read_raw(spark, str(tmp_path)).collect()
    kept = read_events_csv(spark, path, surplus="keep")
    assert kept.count() == 8
    assert kept.where("csv_record is not null").count() == 4
    found = {r["idfa"]: r["csv_record"] for r in kept.collect()}
    assert found == {
        "u1": None,
        "u2": None,
        "u3": 'u3,c,"{""k"":""3""}",z',
        "u4": 'u4,d,"q""r",',
        "u5": None,
        "u6": 'u6,f,5" a,6" b',
        "u7": None,
        "u8": 'u8,h,"two\nlines",w',
    }
    with pytest.raises(ValueError, match="surplus"):
        read_events_csv(spark, path, surplus="drop")


def test_headers_must_agree(spark, tmp_path):
    put(str(tmp_path), "a.csv", "idfa,event\n1,2\n")
    put(str(tmp_path), "b.csv", "event,idfa\n1,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        read_raw(spark, str(tmp_path)).collect()


VALUES = [
    ("plain", "a"),
    ("", None),
    (None, ""),
    ("quote \" and \"\"two\"\"", "back\\slash \\\" end\\"),
    ("comma, inside", " blanks around "),
    ("line\nbreak", "two\n\nlines"),
    ('""k"":""3""', "中文"),
    ("NA", "null"),
]


def test_round_trip_keeps_every_cell(spark, rows, tmp_path):
    path = str(tmp_path / "t.csv")
    write_events_csv(rows("a string, b string", *VALUES), path)
    assert tuples(read_events_csv(spark, path)) == tuples(rows("a string, b string", *VALUES))
    nulled = read_events_csv(spark, path, empty_as_null=True)
    assert ("plain", "a") in tuples(nulled)
    assert (None, None) in tuples(nulled)
    with pytest.raises(Exception, match="exists"):
        write_events_csv(rows("a string, b string", *VALUES), path)


def test_replace_may_read_its_own_target(spark, rows, tmp_path):
    path = str(tmp_path / "t.csv")
    write_events_csv(rows("idfa string, n string", ("u", "1"), ("0000-0000", "2")), path)
    write_events_csv(drop_invalid_ids(read_events_csv(spark, path)), path, replace=True)
    assert tuples(read_events_csv(spark, path)) == [("u", "1")]


def test_large_files_are_split_only_where_that_is_safe(spark, tmp_path):
    folder = str(tmp_path)
    flat = [(f"u{i}", f"a {i}", '""k"":""1""') for i in range(400)]
    broken = [(f"v{i}", f"line {i}\nnext, \"{i}\"", "") for i in range(400)]

    def cell(text):
        return '"' + text.replace('"', '""') + '"'

    for name, data in (("flat.csv", flat), ("broken.csv", broken)):
        text = "".join(",".join(cell(c) for c in row) + "\n" for row in data)
        put(folder, name, "idfa,event,param\n" + text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_raw(spark, folder)
        assert tuples(df) == sorted(flat + broken)
        # Both by several tasks.
        assert df.rdd.getNumPartitions() > 8
        whole = read_raw(spark, folder, multi_line=True)
        assert tuples(whole) == sorted(flat + broken)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_of_other_tools(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "a.csv", "idfa,event\nu1,x\n")
    table = f"{folder}/b.csv"
    put(table, "0.part", "idfa,event\nu2,y\n")
    put(table, "data1.csv", "idfa,event\nu3,z\n")
    put(table, "_SUCCESS", "")
    put(table, ".0.part.crc", "no")
    assert tuples(read_raw(spark, folder)) == [("u1", "x"), ("u2", "y"), ("u3", "z")]
    for place, name in ((f"{table}/deeper", "c.csv"), (table, "_d.csv"), (f"{folder}/c.csv", "_SUCCESS")):
        put(place, name, "idfa,event\nu4,z\n")
        with pytest.raises(ValueError, match="deeper|_d.csv|no file"):
            read_raw(spark, folder)
        os.remove(os.path.join(place, name))
        if place != table:
            os.rmdir(place)


def test_single_steps_split_large_files(spark, tmp_path):
    table = f"{tmp_path}/a.csv"
    put(table, "0.csv", "idfa,event,time,param\n" + "".join(f"u{i},x,t{i},\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        step = clean_table(spark, table, f"{tmp_path}/out.csv")
        assert step.table.count() == 2000
        assert len(os.listdir(f"{tmp_path}/out.csv")) > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    put(table, "_d.csv", "idfa,event,time,param\nu,x,t,\n")
    for step in (clean_table, split_table):
        with pytest.raises(ValueError, match="_d.csv"):
            step(spark, table, f"{tmp_path}/other")


@pytest.fixture
def small_pieces(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


ODD_CELLS = [
    "plain", "", "5\" screen", "a\"\"b", '"two\nlines"', '"a ""quoted"", b\n\nc"', '"closed"rest', '""k"":""3""',
    '"\n"', '"ends ""\n"" begins"', ' "not open', '"x,\ny,\nz"', '"\r\n"', "é\"", '""', '"""one""\n"',
]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_lines_and_pieces(spark, tmp_path, small_pieces, seed, end):
    rng = random.Random(seed)
    for name in ("a.csv", "b.csv"):
        lines = [",".join([f"u{i}", rng.choice(ODD_CELLS), rng.choice(ODD_CELLS)]) for i in range(150)]
        lines.insert(20, "")
        put(str(tmp_path), name, end.join(["idfa,event,param", *lines]) + (end if seed % 2 else ""))
    whole = read_raw(spark, str(tmp_path), multi_line=True)
    got = read_raw(spark, str(tmp_path))
    assert got.columns == whole.columns
    assert tuples(got) == tuples(whole)
    raw = records(spark, [f"{tmp_path}/a.csv"])
    assert raw.count() == 152 and raw.select("number").distinct().count() == 152


def test_line_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    put(str(tmp_path), "a.csv", 'idfa,event\nu1,"a\nb"\nu2,c\n')
    plans, save = [], csv_records.saved

    def spy(df, *args):
        plans.append(plan(df))
        return save(df, *args)

    for module in (csv_files, csv_records):
        monkeypatch.setattr(module, "saved", spy)
    got = read_raw(spark, str(tmp_path), split_bytes=0)
    assert tuples(got) == [("u1", "a\nb"), ("u2", "c")]
    (texts,) = [text for text in plans if "Window [" in text and "collect_list" in text]
    assert texts.count("Exchange hashpartitioning") == 1, texts
    # No sort of whole records either.
    assert not any("SortAggregate" in text for text in plans)
    # Windows over lines end with a chunk; only rows of chunks go by file.
    for text in plans:
        by_file = [line for line in text.splitlines() if "Window [" in line and "windowspecdefinition(file#" in line]
        assert not any("place#" in line for line in by_file), text


@pytest.mark.parametrize("lines,end", [(1, "\n"), (3, "\r\n")])
def test_records_over_chunks(spark, tmp_path, monkeypatch, lines, end):
    monkeypatch.setattr(csv_records, "_CHUNK", lines)
    rng = random.Random(lines)
    for name in ("a.csv", "b.csv"):
        rows = [",".join([f"u{i}", rng.choice(ODD_CELLS), rng.choice(ODD_CELLS)]) for i in range(80)]
        put(str(tmp_path), name, end.join(["", "idfa,event,param", *rows, 'v,"last', "", 'of all",w']))
    whole = read_raw(spark, str(tmp_path), multi_line=True)
    got = read_raw(spark, str(tmp_path), split_bytes=0)
    assert tuples(got) == tuples(whole)
    raw = records(spark, [f"{tmp_path}/a.csv"]).orderBy("number").collect()
    assert [row.number for row in raw] == list(range(1, 84))
    assert raw[1].record == "idfa,event,param" and raw[-1].record == 'v,"last\n\nof all",w'


def test_one_broken_cell_and_one_stray_quote(spark, tmp_path, small_pieces):
    lines = [f"u{i},x,t{i}" for i in range(500)]
    lines[100], lines[300] = 'u100,x,"t\n100"', 'u300,5" x,t300'
    put(str(tmp_path), "a.csv", "\n".join(["idfa,event,time", *lines]))
    got = read_raw(spark, str(tmp_path))
    want = [("u100", "x", "t\n100"), ("u300", '5" x', "t300")] + [(f"u{i}", "x", f"t{i}") for i in range(500) if i not in (100, 300)]
    assert tuples(got) == sorted(want)
    assert got.rdd.getNumPartitions() > 1


def test_long_records_over_many_pieces(spark, tmp_path, small_pieces):
    text = "\n".join(f"line {i}, of a ""cell""" for i in range(200))
    rows = "\n".join(f"u{i},x,t{i}" for i in range(100))
    put(str(tmp_path), "a.csv", f'idfa,event,time\n{rows}\nlong,x,"{text}"\n{rows}\n')
    got = read_raw(spark, str(tmp_path))
    assert got.count() == 201
    assert got.where("idfa = 'long'").first()["time"] == text.replace('""', '"')


def test_surplus_in_pieces(spark, tmp_path):
    put(str(tmp_path), "a.csv", SURPLUS)
    with pytest.raises(Exception, match="more cells than the header"):
        read_raw(spark, str(tmp_path), split_bytes=0).collect()
    kept = read_raw(spark, str(tmp_path), split_bytes=0, surplus="keep")
    whole = read_raw(spark, str(tmp_path), multi_line=True, surplus="keep")
    assert tuples(kept) == tuples(whole)


def test_bare_returns_are_read_whole(spark, tmp_path):
    put(str(tmp_path), "a.csv", 'idfa,event\nu1,"a\rb"\nu2,"c\n"\n')
    got = read_raw(spark, str(tmp_path), split_bytes=0)
    assert tuples(got) == tuples(read_raw(spark, str(tmp_path), multi_line=True))


def test_headers_of_pieces_must_agree(spark, tmp_path):
    put(str(tmp_path), "a.csv", 'idfa,event\n1,"2\n"\n')
    put(str(tmp_path), "b.csv", 'event,idfa\n1,"2\n"\n')
    with pytest.raises(ValueError, match="header"):
        read_raw(spark, str(tmp_path), split_bytes=0)


def test_failed_replace_keeps_the_old_table(spark, rows, tmp_path, monkeypatch):
    import playtrace.sources.csv_files as csv_files

    path = str(tmp_path / "t.csv")
    write_events_csv(rows("a string", ("old",)), path)
    moved = csv_files.move

    def fails(spark, source, target):
        if source.endswith(".new"):
            raise OSError("no")
        moved(spark, source, target)

    monkeypatch.setattr(csv_files, "move", fails)
    with pytest.raises(OSError):
        write_events_csv(rows("a string", ("new",)), path, replace=True)
    (kept,) = [f for f in os.listdir(tmp_path) if f.endswith(".old")]
    assert tuples(read_events_csv(spark, str(tmp_path / kept))) == [("old",)]
