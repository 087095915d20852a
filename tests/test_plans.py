"""What Spark makes of the operators: shapes that must hold at any size."""

import contextlib
import io
import re

import pytest

from workload.queries import all_queries
from playtrace.functions.params import parse_params
from playtrace.operators import behavior, splitting, users
from playtrace.operators.combine import dedup
from playtrace.plans import events_of
from workload.queries import METRICS
from workload.tables import event_view, messy_log

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    for bad in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
        assert bad not in text, text


@pytest.mark.parametrize("name", sorted(set(METRICS) - {"reward_scene_rank"}))
def test_metrics_read_only_their_columns(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    columns = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*?)>", text))))
    needs_params = name in ("user_levels", "round_stats", "loss_streak_churn", "events_in_ads", "exit_causes") or (
        name.startswith(("reward", "button_c", "button_by"))
    )
    assert ("props" in columns) == needs_params, text
    assert ("value" in columns) == (name.startswith("bet") or name == "exit_causes"), text


def test_id_filter_runs_before_the_dedup_shuffle(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    messy_log(spark, SF_DIR).drop("event_id").write.parquet(path)
    text = plan(events_of(spark.read.parquet(path)))
    assert text.index("Exchange") < text.index("Filter")
    assert re.search(r"PushedFilters: \[.*Not\(In\(idfa", text)


@pytest.mark.parametrize("name", ["dedup_subset", "event_preview"])
def test_copies_are_reduced_before_the_shuffle(spark, name):
    text = plan(all_queries()[name](spark, SF_DIR))
    below = text[text.index("Exchange") :]
    assert re.search(r"WindowGroupLimit .*Partial", below)


def test_dedup_without_order_is_a_partial_aggregate(spark):
    text = plan(dedup(messy_log(spark, SF_DIR), ["idfa", "event", "time"]))
    below = text[text.index("Exchange") :]
    assert "partial_first" in below


def test_window_and_sessions_share_one_shuffle_by_user(spark):
    E = event_view(spark, SF_DIR)
    assert plan(users.user_span(E)).count("Exchange") == 1
    assert plan(behavior.sessions(E)).count("Exchange") == 1
    assert plan(behavior.session_duration_dist(E)).count("Exchange") == 2


def test_params_are_parsed_once_per_row(spark):
    E = event_view(spark, SF_DIR)
    assert plan(E.select("params")).count("from_json") == 1
    parsed = parse_params(messy_log(spark, SF_DIR))
    assert plan(splitting.split_long(parsed)).count("from_json") == 1
    assert plan(parsed.select("params", "params_ok")).count("from_json") == 1


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_table_is_ordered_in_one_task(spark, name):
    lines = plan(all_queries()[name](spark, SF_DIR)).splitlines()
    one_task = [above for above, line in zip(lines, lines[1:]) if "SinglePartition" in line]
    # a ranking of scenes whose number was checked; running sums over one row per slice
    small = name in ("reward_scene_rank", "bet_percentiles", "bet_risk_churn")
    assert small or not any("Sort [" in line for line in one_task)
