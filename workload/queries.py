"""One callable per operator: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.functions.params import parse_params, repair_quotes, typed_params
from playtrace.operators import (
    ads,
    behavior,
    buttons,
    churn,
    cleaning,
    combine,
    experiment,
    splitting,
    users,
)
from playtrace.plans.folder import events_of, process_folder
from playtrace.scratch import scratch_path
from playtrace.settings import DEDUP_KEYS
from playtrace.sources.csv_files import RECORD
from playtrace.sources import (
    event_view_audit as audit_view,
    read_events_csv,
    read_raw,
    stage_by_event,
    typed_events,
    write_events_csv,
    write_split,
)
from playtrace.streaming import ingest
from workload.tables import (
    AB_START,
    DURATION_EDGES_S,
    ROLES,
    SESSION_GAP_S,
    event_view,
    messy_log,
    two_exports,
)

Query = Callable[[SparkSession, str], DataFrame]
LOG = ("idfa", "event", "time", "param")


def plain_types(df: DataFrame) -> DataFrame:
    """Dates and times as text and integers as bigint, so that engines agree on types."""
    casts = {"date": "string", "timestamp_ntz": "string", "int": "bigint"}
    return df.select(
        *[F.col(name).cast(casts.get(kind, kind)).alias(name) for name, kind in df.dtypes]
    )


# --- sources, merging, cleaning ------------------------------------------------


def csv_scan_merge(spark, sf_dir):
    """Two exports as CSV files with the blanks that raw headers have, read back."""
    both = combine.merge_sources(*two_exports(spark, sf_dir))
    folder = scratch_path(spark)
    write_events_csv(both.select(*LOG).toDF("idfa", " event", " time", "param"), folder)
    return read_raw(spark, folder)


def csv_bad_rows(spark, sf_dir):
    """Raw rows as lines of text, many with the unquoted param that has more cells than the header."""
    log = messy_log(spark, sf_dir)
    param = F.when(F.col("event_id") % 10 == 4, F.lit('"k","","scene",1')).when(
        F.col("event_id") % 10 != 1, F.lit('"a,b"')
    )
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event", "time", param)
    path = scratch_path(spark)
    plain = {"header": True, "sep": "\u0002", "quote": ""}
    log.select(line.alias("event_id,event,time,param")).write.options(**plain).csv(path)
    rows = read_events_csv(spark, path, multi_line=False, surplus="keep")
    return rows.withColumnRenamed(RECORD, "record")


def csv_multiline_scan(spark, sf_dir):
    """Two exports with line breaks and quotes in cells, read in pieces whatever their size."""
    both = combine.merge_sources(*two_exports(spark, sf_dir))
    text = F.concat(F.lit('one "'), "event_id", F.lit('",\n\ntwo""\n'), "event", F.lit('"'))
    param = F.when(F.col("event_id") % 3 == 0, text).otherwise(F.col("param"))
    folder = scratch_path(spark)
    write_events_csv(both.withColumn("param", param).select(*LOG), f"{folder}/log.csv")
    return read_raw(spark, folder, split_bytes=0)


def csv_roundtrip(spark, sf_dir):
    """Write, then replace the same folder by its own valid rows, then read."""
    path = scratch_path(spark)
    write_events_csv(messy_log(spark, sf_dir), path)
    valid = cleaning.drop_invalid_ids(read_events_csv(spark, path))
    write_events_csv(valid, path, replace=True)
    return read_events_csv(spark, path)


def union_all_sources(spark, sf_dir):
    return combine.merge_sources(*two_exports(spark, sf_dir))


def dedup_subset(spark, sf_dir):
    both = combine.merge_sources(*two_exports(spark, sf_dir))
    return combine.dedup(both, DEDUP_KEYS, order_by=["event_id"])


def dedup_all(spark, sf_dir):
    return combine.dedup(combine.merge_sources(*two_exports(spark, sf_dir)))


def stream_dedup(spark, sf_dir):
    """Two exports that arrive one after the other; of the second, what is ten days behind the first comes too late."""
    folder, out, checkpoint = (scratch_path(spark) for _ in range(3))
    for number, export in enumerate(two_exports(spark, sf_dir)):
        write_events_csv(export.select(*LOG), f"{folder}/{number}.csv")
        ingest(spark, folder, out, checkpoint, delay="10 days")
    return spark.read.parquet(out).select(*DEDUP_KEYS)


def merge_audit(spark, sf_dir):
    both = combine.merge_sources(*two_exports(spark, sf_dir)).select(*LOG)
    return combine.merge_audit(both, DEDUP_KEYS)


def export_differences(spark, sf_dir):
    """Rows that the two exports do not hold equally often."""
    first, second = (df.select(*LOG) for df in two_exports(spark, sf_dir))
    return combine.export_differences(first, combine.merge_sources(second, second.filter("event = 'click'")))


def clean_invalid_ids(spark, sf_dir):
    return cleaning.drop_invalid_ids(messy_log(spark, sf_dir))


def clean_audit(spark, sf_dir):
    return cleaning.clean_audit(messy_log(spark, sf_dir))


def top_ids_before(spark, sf_dir):
    return cleaning.top_values(messy_log(spark, sf_dir), "idfa")


def top_ids_after(spark, sf_dir):
    return cleaning.top_values(cleaning.drop_invalid_ids(messy_log(spark, sf_dir)), "idfa")


def null_handling(spark, sf_dir):
    rules = cleaning.NullRules(
        null_tokens=("broken",),
        blank_to_null=("param",),
        drop_if_null=("param",),
        fill={"idfa": "none"},
    )
    return cleaning.null_handling(messy_log(spark, sf_dir), rules)


def quality_report(spark, sf_dir):
    return cleaning.quality_report(messy_log(spark, sf_dir).select(*LOG))


# --- params and split ----------------------------------------------------------


def _parsed(spark, sf_dir):
    return parse_params(messy_log(spark, sf_dir))


def distinct_events(spark, sf_dir):
    return splitting.event_types(messy_log(spark, sf_dir))


def event_counts(spark, sf_dir):
    return splitting.event_counts(messy_log(spark, sf_dir))


def param_quote_repair(spark, sf_dir):
    return messy_log(spark, sf_dir).select("event_id", repair_quotes().alias("repaired"))


def param_parse(spark, sf_dir):
    """Every row with its parameters as sorted ``key=value`` text."""
    entries = F.sort_array(F.map_entries("params"))
    pairs = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    )
    return _parsed(spark, sf_dir).select(
        "event_id",
        F.array_join(pairs, ";").alias("params"),
        F.size("params").alias("n_params"),
        "params_ok",
    )


def param_bad_rows(spark, sf_dir):
    return splitting.bad_params(messy_log(spark, sf_dir))


def param_keys_by_event(spark, sf_dir):
    found = splitting.discover_params(_parsed(spark, sf_dir))
    return found.select("event", F.array_join("keys", ",").alias("keys"))


def param_types(spark, sf_dir):
    return splitting.param_types(typed_params(messy_log(spark, sf_dir)))


def split_wide(spark, sf_dir):
    """The wide tables of all events, stacked."""
    staged = stage_by_event(_parsed(spark, sf_dir), scratch_path(spark))
    return splitting.stack(splitting.split_by_event(staged.rows, rows_of=staged.event).values())


def drop_all_null_cols(spark, sf_dir):
    """``win`` is only ever an explicit null or missing; without the latter it goes."""
    wide = splitting.widen(_parsed(spark, sf_dir), ["k", "scene", "win"])
    return splitting.drop_all_null(wide.withColumn("win", F.nullif("win", F.lit(""))))


def event_preview(spark, sf_dir):
    return splitting.event_preview(messy_log(spark, sf_dir), order_by=["time", "event_id"])


def split_long(spark, sf_dir):
    return splitting.split_long(_parsed(spark, sf_dir))


def split_partition_counts(spark, sf_dir):
    """Write one CSV per event, read each back, and count its rows and columns."""
    folder = scratch_path(spark)
    staged = stage_by_event(_parsed(spark, sf_dir), f"{folder}/parsed")
    paths = write_split(staged, f"{folder}/events")
    counts = []
    for path in paths.values():
        table = read_events_csv(spark, path)
        columns = F.lit(len(table.columns)).alias("n_columns")
        counts.append(table.groupBy("event").agg(F.count(F.lit(1)).alias("rows"), columns))
    return splitting.stack(counts)


def end_to_end_event_counts(spark, sf_dir):
    """Merge, deduplicate, clean and parse; then sizes per event."""
    raw = combine.merge_sources(*two_exports(spark, sf_dir)).select(*LOG)
    return (
        events_of(raw)
        .groupBy("event")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.size("params")).alias("params"),
            F.count_if(~F.col("params_ok")).alias("unreadable"),
        )
    )


def _processed(spark, sf_dir):
    """Two exports as CSV tables in one folder, through the whole pipeline."""
    folder = scratch_path(spark)
    for name, export in zip("ab", two_exports(spark, sf_dir)):
        write_events_csv(export.select(*LOG), f"{folder}/in/{name}.csv")
    return process_folder(spark, f"{folder}/in", f"{folder}/out")


def folder_pipeline_counts(spark, sf_dir):
    """What the whole pipeline counts on its way."""
    return spark.createDataFrame([_processed(spark, sf_dir).counts])


def folder_pipeline_dau(spark, sf_dir):
    """Daily users of the parsed log that the whole pipeline writes."""
    return users.dau(typed_events(spark.read.parquet(_processed(spark, sf_dir).parsed)))


def event_view_audit(spark, sf_dir):
    return audit_view(_parsed(spark, sf_dir))


# --- metrics on the event view -------------------------------------------------


# Show, completion, next round.
AD_STEPS = (ROLES.ad_show, ROLES.ad_done, ROLES.round_start)

# Operator and arguments; the event view comes first.
METRICS: dict[str, tuple] = {
    "dau": (users.dau,),
    "wau": (users.wau,),
    "mau": (users.mau,),
    "new_users": (users.new_users,),
    "churned_users": (users.churned_users,),
    "retention": (users.retention,),
    "user_tiers": (users.user_tiers,),
    "user_levels": (users.user_levels, "int(params['k'])"),
    "sessions": (behavior.sessions, SESSION_GAP_S),
    "session_duration_dist": (
        behavior.session_duration_dist,
        SESSION_GAP_S,
        DURATION_EDGES_S,
    ),
    "event_interval": (behavior.event_interval,),
    "round_stats": (behavior.round_stats, ROLES),
    "bet_histogram": (behavior.bet_histogram, 20),
    "bet_percentiles": (behavior.bet_percentiles,),
    "ad_completion": (ads.ad_completion, ROLES),
    "events_in_ads": (ads.events_in_ads, ROLES, 600),
    "ad_funnel_steps": (ads.funnel_steps, AD_STEPS, 24 * 3600),
    "reward_video_funnel": (ads.reward_video_funnel, ROLES),
    "reward_scene_rank": (ads.reward_scene_rank, ROLES),
    "button_clicks": (buttons.button_clicks, ROLES),
    "button_by_tier": (buttons.button_by_tier, ROLES),
    "button_by_ad_group": (buttons.button_by_ad_group, ROLES),
    "button_cube": (buttons.button_cube, ROLES),
    "exit_causes": (churn.exit_causes, ROLES, SESSION_GAP_S, 12 * 3600, 100.0),
    "exit_events": (churn.exit_events, SESSION_GAP_S),
    "loss_streak_churn": (churn.loss_streak_churn, ROLES),
    "survival_by_streak": (churn.survival_by_streak, ROLES),
    "bet_risk_churn": (churn.bet_risk_churn,),
    "ab_assign": (experiment.ab_assign, "exp1"),
    "ab_metrics": (experiment.ab_metrics, "exp1"),
    "ab_intervals": (experiment.ab_intervals, "exp1", AB_START),
}


def metric(name: str, **options) -> Query:
    operator, *args = METRICS[name]
    return lambda spark, sf_dir: operator(event_view(spark, sf_dir), *args, **options)


TABLES: dict[str, Query] = {
    query.__name__: query
    for query in (
        csv_scan_merge,
        csv_bad_rows,
        csv_multiline_scan,
        csv_roundtrip,
        union_all_sources,
        dedup_subset,
        dedup_all,
        stream_dedup,
        merge_audit,
        export_differences,
        clean_invalid_ids,
        clean_audit,
        top_ids_before,
        top_ids_after,
        null_handling,
        quality_report,
        distinct_events,
        event_counts,
        param_quote_repair,
        param_parse,
        param_bad_rows,
        param_keys_by_event,
        param_types,
        split_wide,
        drop_all_null_cols,
        event_preview,
        split_long,
        split_partition_counts,
        end_to_end_event_counts,
        folder_pipeline_counts,
        folder_pipeline_dau,
        event_view_audit,
    )
}


# Computed doubles are rounded, so that the last bit does not decide.
ROUNDED = {
    "event_interval": ("p50_us", "p90_us"),
    "bet_percentiles": ("p25", "p50", "p75", "p95"),
    "ab_metrics": ("lift", "z"),
    "ab_intervals": (
        "covariate", "mean", "slope",
        "difference", "difference_low", "difference_high",
        "adjusted", "adjusted_low", "adjusted_high",
    ),
    "survival_by_streak": ("survival",),
}


def comparable(name: str, query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plain_types(query(spark, sf_dir))
        return df.withColumns({c: F.round(c, 6) for c in ROUNDED.get(name, ())})

    return run


def all_queries() -> dict[str, Query]:
    found = {**TABLES, **{name: metric(name) for name in METRICS}}
    return {name: comparable(name, query) for name, query in found.items()}
