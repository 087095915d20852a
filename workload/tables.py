"""The ``events`` test table, dressed up as raw log files and as a typed event view.

Every function keeps every row of the table. See FIXTURES.md.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from playtrace.functions.params import parse_params
from playtrace.settings import Roles

# Which test events play which part. Stand-ins: they test operators only.
ROLES = Roles(
    round_start="signup",
    round_end="error",
    ad_show="view",
    ad_done="purchase",
    button="click",
    win="int(params['k']) % 2 = 0",
    scene="bigint(params['k']) % 4",
    button_id="bigint(params['k']) % 6",
)
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string"
)
AB_START = datetime.date(2024, 1, 15)
SESSION_GAP_S = 6 * 3600
DURATION_EDGES_S = (0, 3600, 3 * 3600, 6 * 3600, 12 * 3600, 24 * 3600)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def messy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with invalid ids and all kinds of param text."""
    fields = events(spark, sf_dir).selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        "props",
        "regexp_extract(props, '[0-9]+', 0) as k",
    )
    return fields.selectExpr(
        "event_id",
        """case user_id % 25
             when 0 then '00000000-0000-0000-0000-000000000000'
             when 1 then 'unknown-adid'
             when 2 then '0000-0000'
             when 3 then 'unknow-adid'
             when 4 then null
             else string(user_id) end as idfa""",
        "event_type as event",
        "string(ts) as time",
        """case event_id % 10
             when 1 then '   '
             when 2 then concat('""k"":""', k, '"",""scene"":""', int(k) % 4, '""')
             when 3 then concat('\"""k"":""', k, '\"""')
             when 4 then '"k":"","scene":"1"'
             when 5 then concat('"k":', k, ',"win":null')
             when 6 then 'broken'
             when 7 then props
             when 8 then props
             when 9 then concat('""\""k""\"":', k, ',""\""scene""\"":', int(k) % 4)
             end as param""",
    )


def two_exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log twice; in the second export ``error`` events carry whole seconds only."""
    first = messy_log(spark, sf_dir)
    whole_seconds = "if(event = 'error', substring(time, 1, 19), time) as time"
    return first, first.selectExpr("event_id", "idfa", "event", whole_seconds, "param")


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``E`` with late arrivals and leavers.

    Users divisible by 5 leave: their later events move 18 days back. Users that
    are 1 modulo 4 arrive late: their first three days move 3 days on.
    """
    retimed = events(spark, sf_dir).selectExpr(
        "string(user_id) as idfa",
        "event_type as event",
        """case
             when user_id % 5 = 0 and date(ts) > date '2024-01-12' then ts - interval 18 days
             when user_id % 4 = 1 and date(ts) < date '2024-01-04' then ts + interval 3 days
             else ts end as ts""",
        "value",
        "props",
        "event_id",
    )
    parsed = parse_params(retimed, "props")
    return parsed.selectExpr(
        "idfa", "event", "ts", "date(ts) as d", "value", "params", "event_id"
    )
