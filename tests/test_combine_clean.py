import pytest

from pyspark.sql import functions as F

from playtrace.operators.cleaning import (
    NullRules,
    clean_audit,
    drop_invalid_ids,
    null_handling,
    quality_report,
    top_values,
)
from playtrace.operators.combine import (
    common_rows,
    dedup,
    dedup_counted,
    export_differences,
    merge_audit,
    merge_sources,
    rows_only_in,
)
from playtrace.settings import INVALID_IDS

LOG = "idfa string, event string, time string, param string"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def test_merge_is_strict(rows):
    a = rows("x string, y long", ("a", 1))
    assert tuples(merge_sources(a, a)) == [("a", 1), ("a", 1)]
    for other in ("y long, x string", "x string, y string", "x string"):
        with pytest.raises(ValueError, match="differ"):
            merge_sources(a, rows(other).limit(0) if other == "x string" else a.selectExpr(
                *[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in other.split(", ")]
            ))
    with pytest.raises(ValueError, match="nothing to merge"):
        merge_sources()


def test_dedup_treats_nulls_as_equal(rows):
    df = rows(LOG, (None, "e", "t", "1"), (None, "e", "t", "2"), ("u", "e", "t", None))
    keys = ["idfa", "event", "time"]
    assert dedup(df, keys).count() == 2
    assert dedup(df).count() == 3
    first = dedup(df, keys, order_by=[F.desc("param")])
    assert tuples(first) == [("u", "e", "t", None), (None, "e", "t", "2")]
    assert tuples(dedup(first, keys)) == tuples(first)
    audit = merge_audit(df, keys).first()
    assert (audit.rows_before, audit.rows_after, audit.rows_removed) == (3, 2, 1)
    assert audit.columns == "idfa, event, time, param"
    assert merge_audit(df.limit(0), keys).first().rows_before == 0


def test_dedup_counts_as_it_goes(rows):
    data = [("u", "e", str(t % 5), None) for t in range(40)] + [(None, "e", "t", "p")] * 3
    for keys, after in ((["idfa", "event", "time"], 6), (["idfa"], 2), (None, 6)):
        df, counts = dedup_counted(rows(LOG, *data), keys)
        assert df.columns == ["idfa", "event", "time", "param"]
        assert len(df.collect()) == after
        assert counts.get == {"rows_before": 43, "rows_after": after}
    empty, counts = dedup_counted(rows(LOG, *data).limit(0))
    assert empty.collect() == []
    assert counts.get["rows_before"] in (0, None)


def test_column_names_with_dots(rows):
    df = rows("idfa string, `a.b` string", ("u", "x"), ("u", "x"), ("u", " "))
    assert len(dedup_counted(df, ["idfa"])[0].collect()) == 1
    assert merge_audit(df).first().rows_after == 2
    assert tuples(null_handling(df, NullRules(blank_to_null=("a.b",))))[-1] == ("u", None)
    report = quality_report(df, id_col="idfa", time_col="idfa", keys=["idfa"])
    assert report.filter("column_name = 'a.b'").count() == 4


def test_invalid_ids_are_exact_and_null_goes(rows):
    ids = [*INVALID_IDS, None, "", "u", "Unknown-adid", " 0000-0000"]
    df = rows("idfa string", *[(i,) for i in ids])
    assert {r.idfa for r in drop_invalid_ids(df).collect()} == set(ids[5:])
    audit = clean_audit(df).first()
    assert tuple(audit) == (9, 5, 4, 55.56)
    assert tuple(clean_audit(df.limit(0)).first()) == (0, 0, 0, None)


def test_filter_and_dedup_commute(rows):
    data = [(i, "e", str(t), None) for i in (*INVALID_IDS, "u", "v", None) for t in (1, 1, 2)]
    df = rows(LOG, *data)
    keys = ["idfa", "event", "time"]
    assert tuples(drop_invalid_ids(dedup(df, keys))) == tuples(dedup(drop_invalid_ids(df), keys))


def test_top_values(rows):
    df = rows("v string", *[(v,) for v in ["b", "b", None, None, "a", "a", "c"]])
    got = [tuple(r) for r in top_values(df, "v", 3).collect()]
    assert got == [("a", 2), ("b", 2), (None, 2)]


def test_null_rules(rows):
    df = rows("a string, b string, n long", ("NA", " ", 1), ("x", " y ", None), (None, "", 3))
    rules = NullRules(null_tokens=("NA",), blank_to_null=("b",), fill={"a": "none"})
    assert tuples(null_handling(df, rules)) == [
        ("none", None, 1),
        ("none", None, 3),
        ("x", " y ", None),
    ]
    dropped = null_handling(df, NullRules(null_tokens=("NA",), drop_if_null=("a", "n")))
    assert dropped.count() == 0
    assert tuples(null_handling(df, NullRules())) == tuples(df)


def test_quality_report(rows):
    df = rows(LOG, ("u", "e", "t1", " "), ("u", "e", "t1", None), ("0000-0000", "f", None, "p"))
    got = {(r.column_name, r.metric): r.value for r in quality_report(df).collect()}
    assert got[("param", "rows")] == "3"
    assert got[("param", "nulls")] == "1"
    assert got[("param", "blanks")] == "1"
    assert got[("param", "distinct_values")] == "2"
    assert got[("time", "nulls")] == "1"
    assert got[("*", "duplicate_key_rows")] == "1"
    assert got[("*", "invalid_id_rows")] == "1"
    assert (got[("*", "min_time")], got[("*", "max_time")]) == ("t1", "t1")


def test_export_differences(rows, spark):
    schema = "a string, `b c` long"
    left = rows(schema, ("x", 1), ("x", 1), ("x", 1), (None, 2), ("y", None), ("z", 3))
    right = rows(schema, ("x", 1), (None, 2), (None, 2), ("z", 3), ("w", 4))

    def found(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    assert found(export_differences(left, right)) == sorted(
        [("x", 1, 3, 1), (None, 2, 1, 2), ("y", None, 1, 0), ("w", 4, 0, 1)], key=str
    )
    assert found(common_rows(left, right)) == sorted([("x", 1, 1), (None, 2, 1), ("z", 3, 1)], key=str)
    assert found(rows_only_in(left, right)) == sorted([("x", 1, 2), ("y", None, 1)], key=str)
    assert sum(r.copies for r in common_rows(left, right).collect()) == left.intersectAll(right).count()
    assert sum(r.copies for r in rows_only_in(left, right).collect()) == left.exceptAll(right).count()
    with pytest.raises(ValueError, match="differ"):
        export_differences(left, right.withColumnRenamed("a", "q"))
    empty = spark.createDataFrame([], schema)
    assert found(export_differences(empty, empty)) == []
