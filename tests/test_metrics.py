"""Metrics on a log small enough to check by hand."""

import datetime
import hashlib
import statistics

import pytest

from pyspark.sql import functions as F

from playtrace.functions.params import parse_params
from playtrace.operators import ads, behavior, buttons, churn, experiment, users
from playtrace.settings import Roles
from playtrace.sources import typed_events

LOG = "idfa string, event string, time string, param string"
ROLES = Roles()
DATA = [
    ("a", "round_start", "2024-03-01 10:00:00", None),
    ("a", "round_end", "2024-03-01 10:01:30.5", '"win":"1"'),
    ("a", "round_start", "2024-03-01 10:02:00", None),
    ("a", "button", "2024-03-01 10:02:10", '"button":"menu"'),
    ("a", "round_end", "2024-03-01 10:03:00", '"win":"0"'),
    ("a", "round_start", "2024-03-02 09:00:00", None),
    ("a", "round_end", "2024-03-02 09:00:10", None),
    ("a", "ad_show", "2024-03-02 09:00:20", '"scene":"s1"'),
    ("a", "button", "2024-03-02 09:00:25", '"button":"menu"'),
    ("a", "ad_done", "2024-03-02 09:00:50", None),
    ("b", "ad_show", "2024-03-02 23:59:59", '"scene":"s1"'),
    ("b", "ad_show", "2024-03-03 00:00:30", '"scene":"s2"'),
    ("b", "button", "2024-03-15 00:00:00", '"button":"shop","value":"5.5"'),
    ("c", "button", "1969-12-30 00:00:00", '"button":"shop","value":"1"'),
    ("c", "button", "no time", '"button":"shop"'),
]


@pytest.fixture
def E(rows):
    return typed_events(parse_params(rows(LOG, *DATA)))


def day(text):
    return datetime.date.fromisoformat(text)


def tuples(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_typed_events(E):
    assert E.dtypes == [
        ("idfa", "string"),
        ("event", "string"),
        ("ts", "timestamp_ntz"),
        ("d", "date"),
        ("value", "double"),
        ("params", "map<string,string>"),
        ("event_id", "bigint"),
    ]
    assert E.count() == len(DATA) - 1
    assert tuples(E.filter("value is not null"), "value") == [(1.0,), (5.5,)]
    assert E.select("event_id").distinct().count() == len(DATA) - 1


def test_active_users(E):
    assert tuples(users.dau(E)) == [
        (day("1969-12-30"), 1),
        (day("2024-03-01"), 1),
        (day("2024-03-02"), 2),
        (day("2024-03-03"), 1),
        (day("2024-03-15"), 1),
    ]
    assert (day("2024-02-26"), 2) in tuples(users.wau(E))
    assert tuples(users.mau(E)) == [(day("1969-12-01"), 1), (day("2024-03-01"), 2)]
    assert tuples(users.new_users(E))[1:] == [(day("2024-03-01"), 1), (day("2024-03-02"), 1)]
    assert tuples(users.active_days(E)) == tuples(E.select("idfa", "d").distinct())


def test_churn_and_as_of(E):
    assert tuples(users.churned_users(E)) == [("a", day("2024-03-02")), ("c", day("1969-12-30"))]
    assert tuples(users.churned_users(E, as_of=day("2024-03-09")), "idfa") == [("c",)]
    assert tuples(users.churned_users(E, days=13), "idfa") == [("c",)]


def test_retention_over_block_borders(rows):
    first = day("2024-01-01")
    days = [0, 1, 7, 40, 70, 128]
    data = [(u, first + datetime.timedelta(days=n + u)) for u in range(66) for n in days]
    E = rows("idfa int, d date", *data)
    got = tuples(users.retention(E, offsets=(1, 2, 7, 70, 128)))
    last = first + datetime.timedelta(days=65 + 128)
    want = [
        (first + datetime.timedelta(days=u), 1, n, int(n != 2), float(n != 2))
        for u in range(66)
        for n in (1, 2, 7, 70, 128)
        if first + datetime.timedelta(days=u + n) <= last
    ]
    assert got == sorted(want)


def test_tiers_and_levels(rows):
    E = rows("idfa string, lv int", *[(f"u{n}", n) for n in range(1, 6) for _ in range(n)])
    assert tuples(users.user_tiers(E)) == [
        ("u1", 1, 1),
        ("u2", 2, 1),
        ("u3", 3, 2),
        ("u4", 4, 3),
        ("u5", 5, 4),
    ]
    assert tuples(users.user_levels(E, "lv"))[0] == ("u1", 1)


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_sessions(E, max_rows):
    got = behavior.sessions(E, gap_s=1800, max_rows=max_rows)
    assert tuples(got.filter("idfa = 'a'"), "session_no", "n_events", "duration_us") == [
        (1, 5, 180_000_000),
        (2, 5, 50_000_000),
    ]
    assert got.agg(F.sum("n_events")).first()[0] == E.count()
    dist = tuples(behavior.session_duration_dist(E, max_rows=max_rows))
    assert dist == [(0, 4, 9), (60, 1, 5)]


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_rounds(E, max_rows):
    got = behavior.round_stats(E, ROLES, max_rows).first()
    assert (got.rounds, got.wins) == (3, 1)
    assert got.min_duration_us == 10_000_000
    assert got.max_duration_us == 90_500_000
    assert got.avg_duration_us == pytest.approx(160_500_000 / 3)
    streaks = tuples(churn.loss_streak_churn(E, ROLES, max_rows=max_rows))
    assert streaks == [(2, 1, 1, 1.0)]
    assert tuples(churn.survival_by_streak(E, ROLES, max_rows=max_rows)) == [(2, 1, 1, 1, 0, 0.0)]
    assert tuples(churn.survival_by_streak(E, ROLES, days=30, max_rows=max_rows)) == [(2, 1, 1, 0, 1, 1.0)]


def test_survival_with_ties_and_censored_users(rows):
    users = [(1, d, True) for d in (2, 2, 5)] + [(1, 2, False), (1, 9, False), (None, 0, True), (None, 0, True)]
    got = {(r.g, r.days): r for r in churn.survival(rows("g int, days long, churned boolean", *users), "g").collect()}
    counts = {key: (r.at_risk, r.churned, r.censored) for key, r in got.items()}
    assert counts == {(1, 2): (5, 2, 1), (1, 5): (2, 1, 0), (1, 9): (1, 0, 1), (None, 0): (2, 2, 0)}
    want = {(1, 2): 3 / 5, (1, 5): 3 / 5 / 2, (1, 9): 3 / 5 / 2, (None, 0): 0.0}
    assert {key: r.survival for key, r in got.items()} == pytest.approx(want)
    assert churn.survival(rows("g int, days long, churned boolean"), "g").collect() == []


def test_no_rounds(E):
    got = behavior.round_stats(E, Roles(round_start="x", round_end="y")).first()
    assert (got.rounds, got.wins, got.win_rate, got.avg_duration_us) == (0, 0, None, None)


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_ads(E, max_rows):
    assert tuples(ads.ad_completion(E, ROLES, max_rows)) == [
        (day("2024-03-02"), 2, 1, 0.5),
        (day("2024-03-03"), 1, 0, 0.0),
    ]
    funnel = ads.reward_video_funnel(E, ROLES, max_rows)
    assert tuples(funnel, "scene", "shows", "users", "completed") == [
        ("s1", 2, 2, 1),
        ("s2", 1, 1, 0),
    ]
    assert funnel.filter("scene = 's1'").first().shows_per_active_user == pytest.approx(2 / 3)
    rank = ads.reward_scene_rank(E, ROLES, max_rows)
    assert tuples(rank, "scene_rank", "scene") == [(1, "s1"), (2, "s2")]


def test_equal_rates_share_a_rank(rows):
    data = [(s, e, f"2024-01-01 00:00:0{i}", f'"scene":"{s}"')
            for s, done in (("x", 1), ("y", 1), ("z", 0))
            for i, e in enumerate(["ad_show", "ad_done"][: 1 + done])]
    E = typed_events(parse_params(rows(LOG, *data)))
    rank = ads.reward_scene_rank(E, ROLES)
    assert tuples(rank, "scene", "scene_rank") == [("x", 1), ("y", 1), ("z", 3)]


def test_buttons(E):
    assert tuples(buttons.button_clicks(E, ROLES)) == [("menu", 2, 1), ("shop", 2, 2)]
    assert tuples(buttons.button_by_ad_group(E, ROLES)) == [
        ("menu", True, 2, 1, 2.0),
        ("shop", False, 2, 2, 1.0),
    ]
    assert sum(r.clicks for r in buttons.button_by_tier(E, ROLES).collect()) == 4


def test_exits(E):
    assert tuples(churn.exit_events(E)) == [
        ("ad_done", 1, 0.2),
        ("ad_show", 1, 0.2),
        ("button", 2, 0.4),
        ("round_end", 1, 0.2),
    ]


def test_bets(rows):
    E = rows("idfa string, value double, d date", *[("u", float(v), day("2024-01-01")) for v in range(10)])
    hist = behavior.bet_histogram(E, 4)
    assert tuples(hist) == [(0.0, 4), (4.0, 4), (8.0, 2)]
    assert behavior.bet_percentiles(E).first().p50 == 4.5
    assert tuples(churn.bet_risk_churn(E)) == [(10, 1, 0, 0.0)]


def test_arms_are_stable(rows):
    ids = rows("idfa string", *[(f"u{i}",) for i in range(500)])
    arms = dict(tuples(experiment.ab_assign(ids, "s", 3)))
    assert arms == dict(tuples(experiment.ab_assign(ids.repartition(7), "s", 3)))
    assert set(arms.values()) == {0, 1, 2}
    assert arms != dict(tuples(experiment.ab_assign(ids, "t", 3)))
    # first 8 hex digits of md5("s:u0")
    assert arms["u0"] == int(hashlib.md5(b"s:u0").hexdigest()[:8], 16) % 3


def test_arm_metrics_without_churn(rows):
    E = rows("idfa string, d date", *[(f"u{i}", day("2024-01-01")) for i in range(40)])
    got = experiment.ab_metrics(E, "s").collect()
    assert sum(r.users for r in got) == 40
    assert all(r.churned == 0 and r.lift is None and r.z is None for r in got)


def test_poisson_weights_have_mean_and_variance_one(rows):
    users = rows("idfa string", *[(f"u{i}",) for i in range(300)])
    drawn = experiment.bootstrap_weights(users, "s", 50).filter("replicate > 0")
    held = {(r.idfa, r.replicate): r.weight for r in drawn.collect()}
    assert {b for _, b in held} == set(range(1, 51)) and min(held.values()) == 1
    weights = [held.get((f"u{i}", b), 0) for i in range(300) for b in range(1, 51)]
    mean = sum(weights) / len(weights)
    assert abs(mean - 1) < 0.03 and abs(sum((w - mean) ** 2 for w in weights) / len(weights) - 1) < 0.06
    again = experiment.bootstrap_weights(users.repartition(7), "s", 50).filter("replicate > 0")
    assert held == {(r.idfa, r.replicate): r.weight for r in again.collect()}


def _arm(user):
    return int(hashlib.md5(f"s:{user}".encode()).hexdigest()[:8], 16) % 2


def _experiment(rows, effect):
    """Users whose value after the start is that before it, some noise (user number modulo 3) and, in arm 1, ``effect``."""
    data = []
    for i in range(400):
        before = i * 7 % 40
        data.append((f"u{i}", day("2024-01-01"), float(before)))
        data.append((f"u{i}", day("2024-01-10"), float(before + i % 3 + effect * _arm(f"u{i}"))))
    return rows("idfa string, d date, value double", *data)


def test_intervals_follow_the_effect_and_the_covariate_narrows_them(rows):
    E = _experiment(rows, effect=2)
    got = experiment.ab_intervals(E, "s", day("2024-01-05"), F.col("value"), replicates=200)
    control, treated = sorted(got.collect())
    noise = [[i % 3 for i in range(400) if _arm(f"u{i}") == arm] for arm in (0, 1)]
    assert [control.users, treated.users] == [len(n) for n in noise]
    assert control.difference == control.adjusted_low == control.adjusted_high == 0
    # What the arms differ by once their levels before the start are taken off, and its standard error.
    true = 2 + statistics.mean(noise[1]) - statistics.mean(noise[0])
    error = sum(statistics.variance(n) / len(n) for n in noise) ** 0.5
    assert abs(treated.adjusted - true) < 0.02 and abs(treated.slope - 1) < 0.02
    assert abs((treated.adjusted_high - treated.adjusted_low) / (2 * 1.96 * error) - 1) < 0.2
    assert treated.adjusted_low < treated.adjusted < treated.adjusted_high
    assert treated.difference_low < treated.difference < treated.difference_high
    assert treated.adjusted_high - treated.adjusted_low < (treated.difference_high - treated.difference_low) / 5


def test_intervals_without_covariate_control_or_rows(rows):
    E = _experiment(rows, effect=0)
    late = experiment.ab_intervals(E, "s", day("2023-12-01"), F.col("value"), replicates=8).collect()
    assert all(r.slope == 0 and r.covariate == 0 and r.adjusted == r.difference for r in late)
    alone = experiment.ab_intervals(E, "s", day("2024-01-05"), arms=1, replicates=0).first()
    assert (alone.users, alone.mean, alone.covariate, alone.difference, alone.difference_low) == (400, 1, 1, 0, None)
    only = E.filter(experiment.arm_of(F.col("idfa"), "s", 2) == 1)
    assert experiment.ab_intervals(only, "s", day("2024-01-05"), replicates=8).first().difference is None
    assert experiment.ab_intervals(E.limit(0), "s", day("2024-01-05")).collect() == []
