"""The same results in plain SQL over the test tables, for DuckDB.

Written from the definitions, not from the Spark code: windows and joins where
the operators use pre-aggregation, carried borders or subqueries.
"""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

# --- shared inputs -------------------------------------------------------------

R = """
R as (
  select event_id,
    case user_id % 25
      when 0 then '00000000-0000-0000-0000-000000000000'
      when 1 then 'unknown-adid'
      when 2 then '0000-0000'
      when 3 then 'unknow-adid'
      when 4 then null
      else cast(user_id as varchar) end as idfa,
    event_type as event,
    cast(ts as varchar) as time,
    case event_id % 10
      when 1 then '   '
      when 2 then '""k"":""' || k || '"",""scene"":""' || (cast(k as int) % 4) || '""'
      when 3 then '\"""k"":""' || k || '\"""'
      when 4 then '"k":"","scene":"1"'
      when 5 then '"k":' || k || ',"win":null'
      when 6 then 'broken'
      when 7 then props
      when 8 then props
      when 9 then '""\""k""\"":' || k || ',""\""scene""\"":' || (cast(k as int) % 4)
    end as param
  from (select *, regexp_extract(props, '[0-9]+', 0) as k from events) t
)"""

BOTH = (
    R
    + """,
M as (
  select * from R
  union all
  select event_id, idfa, event,
    case when event = 'error' then substring(time, 1, 19) else time end as time, param
  from R
)"""
)

VALID = """idfa not in ('00000000-0000-0000-0000-000000000000', 'unknown-adid',
  '0000-0000', 'unknow-adid')"""


def parsed(source: str) -> str:
    """CTEs that parse the params of ``source`` with DuckDB's JSON functions."""
    return f""",
S as (
  select *, replace(replace(replace(regexp_replace(param, '^\\s*\\{{(.*)\\}}\\s*$', '\\1', 's'),
    '""\""', '"'), '\"""', '"'), '""', '"') as repaired
  from {source}
),
P as (
  select *,
    coalesce(trim(param), '') = '' as blank,
    case when json_valid('{{' || repaired || '}}') then '{{' || repaired || '}}' end as js
  from S
),
K as (
  select event_id, idfa, event, time, param, key,
    json_extract_string(js, '$.' || key) as val
  from (select *, unnest(json_keys(js)) as key from P where not blank and js is not null) t
)"""


E = """
E as (
  select idfa, event, event_id, value, k, ts, cast(ts as date) as d
  from (
    select cast(user_id as varchar) as idfa, event_type as event, event_id, value,
      cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k,
      case
        when user_id % 5 = 0 and cast(ts as date) > date '2024-01-12'
          then ts - interval 18 day
        when user_id % 4 = 1 and cast(ts as date) < date '2024-01-04'
          then ts + interval 3 day
        else ts end as ts
    from events) t
)"""

# Every user, with last day and whether it lies more than 7 days back.
CHURN = """,
C as (
  select idfa, max(d) as last_d,
    max(d) < (select max(d) from E) - interval 7 day as churned
  from E group by idfa
)"""

SESSIONS = """,
G as (
  select *, lag(ts) over w as prev_ts, lead(ts) over w as next_ts
  from E window w as (partition by idfa order by ts, event_id)
),
N as (
  select *, sum(case when prev_ts is null
      or date_diff('microsecond', prev_ts, ts) > 21600000000 then 1 else 0 end)
    over (partition by idfa order by ts, event_id) as session_no
  from G
),
SE as (
  select idfa, cast(session_no as bigint) as session_no, min(ts) as start_ts,
    max(ts) as end_ts, count(*) as n_events,
    date_diff('microsecond', min(ts), max(ts)) as duration_us
  from N group by idfa, session_no
)"""

ROUNDS = """,
RO as (
  select idfa, ts, event_id, date_diff('microsecond', ts, next_ts) as duration_us,
    next_k % 2 = 0 as win
  from (
    select *, lead(event) over w as next_event, lead(ts) over w as next_ts,
      lead(k) over w as next_k
    from E where event in ('signup', 'error')
    window w as (partition by idfa order by ts, event_id)) t
  where event = 'signup' and next_event = 'error'
)"""

SHOWS = """,
SH as (
  select idfa, d, k % 4 as scene, coalesce(next_event = 'purchase', false) as completed
  from (
    select *, lead(event) over (partition by idfa order by ts, event_id) as next_event
    from E where event in ('view', 'purchase')) t
  where event = 'view'
)"""

TIERS = """,
U as (select idfa, count(*) as n_events from E group by idfa),
Q as (
  select quantile_cont(n_events, 0.25) as q1, quantile_cont(n_events, 0.5) as q2,
    quantile_cont(n_events, 0.75) as q3
  from U
),
T as (
  select idfa, n_events, cast(case when n_events <= q1 then 1 when n_events <= q2 then 2
    when n_events <= q3 then 3 else 4 end as bigint) as tier
  from U, Q
)"""


STREAKS = """,
Y as (
  select idfa, win, row_number() over (partition by idfa order by ts, event_id)
    - row_number() over (partition by idfa, win order by ts, event_id) as island
  from RO
),
X as (select idfa, win, island, count(*) as n from Y group by all),
W as (
  select idfa, coalesce(max(n) filter (where not win), 0) as longest_streak
  from X group by idfa
)"""


def by_churn(users: str, group: str) -> str:
    return f"""
select {group}, count(*) as users, count(*) filter (where churned) as churned,
  count(*) filter (where churned)::double / count(*) as churn_rate
from {users} join C using (idfa) group by {group}"""


def active(expression: str, name: str, count: str) -> str:
    return f"""with {E}
select cast({expression} as varchar) as {name}, count(distinct idfa) as {count}
from E group by {expression}"""


ARM = "cast(('0x' || substr(md5('exp1:' || idfa), 1, 8)) as bigint) % 2"

# What a draw of 32 bits has to reach for a Poisson weight of at least 1, 2, ...
POISSON_STEPS = [int(2**32 * p) for p in accumulate(exp(-1) / factorial(n) for n in range(12))]
POISSON_WEIGHT = " + ".join(f"(draw >= {step})::int" for step in POISSON_STEPS)

SQL: dict[str, str] = {
    # --- sources, merging, cleaning
    "csv_scan_merge": f"with {BOTH} select idfa, event, time, param from M",
    "csv_bad_rows": f"""with {R}
select cast(event_id as varchar) as event_id, event, time,
  case when event_id % 10 = 1 then null when event_id % 10 = 4 then 'k' else 'a,b' end as param,
  case when event_id % 10 = 4
    then cast(event_id as varchar) || ',' || event || ',' || time || ',"k","","scene",1' end as record
from R""",
    "csv_multiline_scan": f"""with {BOTH}
select idfa, event, time,
  case when event_id % 3 = 0
    then 'one "' || event_id || '",' || chr(10) || chr(10) || 'two""' || chr(10) || event || '"'
    else param end as param
from M""",
    "csv_roundtrip": f"""with {R}
select cast(event_id as varchar) as event_id, idfa, event, time, param from R where {VALID}""",
    "union_all_sources": f"with {BOTH} select * from M",
    "dedup_subset": f"""with {BOTH}
select event_id, idfa, event, time, param from (
  select *, row_number() over (partition by idfa, event, time order by event_id) as n from M
) t where n = 1""",
    "dedup_all": f"with {BOTH} select distinct * from M",
    "stream_dedup": f"""with {R},
V as (select * from R where {VALID}),
L as (select date_trunc('milliseconds', max(time::timestamp)) - interval 10 day as mark from V)
select idfa, event, time from V
union
select idfa, event, substring(time, 1, 19) from V, L
where event = 'error' and substring(time, 1, 19)::timestamp > mark""",
    "merge_audit": f"""with {BOTH},
D as (select distinct idfa, event, time from M)
select (select count(*) from M) as rows_before, 'idfa, event, time, param' as columns,
  (select count(*) from D) as rows_after,
  (select count(*) from M) - (select count(*) from D) as rows_removed""",
    "export_differences": f"""with {R},
A as (select idfa, event, time, param, count(*) as n from R group by all),
S as (
  select idfa, event, case when event = 'error' then substring(time, 1, 19) else time end as time, param from R
),
B as (
  select idfa, event, time, param, count(*) as n
  from (select * from S union all select * from S where event = 'click') group by all
)
select coalesce(A.event, B.event) as event, coalesce(A.time, B.time) as time,
  coalesce(A.idfa, B.idfa) as idfa, coalesce(A.param, B.param) as param,
  coalesce(A.n, 0) as n_left, coalesce(B.n, 0) as n_right
from A full join B on A.idfa is not distinct from B.idfa and A.event = B.event and A.time = B.time
  and A.param is not distinct from B.param
where coalesce(A.n, 0) <> coalesce(B.n, 0)""",
    "clean_invalid_ids": f"with {R} select * from R where {VALID}",
    "clean_audit": f"""with {R},
A as (select count(*) as n, count(*) filter (where {VALID}) as kept from R)
select n as original_rows, n - kept as deleted_rows, kept as remaining_rows,
  round((n - kept) * 100 / n::double, 2) as deleted_percent
from A""",
    "top_ids_before": f"""with {R}
select idfa, count(*) as rows from R group by idfa
order by rows desc, idfa asc nulls last limit 10""",
    "top_ids_after": f"""with {R}
select idfa, count(*) as rows from R where {VALID} group by idfa
order by rows desc, idfa asc nulls last limit 10""",
    "null_handling": f"""with {R}
select event_id, coalesce(idfa, 'none') as idfa, event, time, param from R
where param is not null and trim(param) <> '' and param <> 'broken'""",
    "quality_report": f"""with {R},
cells as (
  select 'idfa' as column_name, idfa as cell from R
  union all select 'event', event from R
  union all select 'time', time from R
  union all select 'param', param from R
),
per_column as (
  select column_name, count(*) as n, count(*) - count(cell) as nulls,
    count(*) filter (where trim(cell) = '') as blanks, count(distinct cell) as n_distinct
  from cells group by column_name
)
select column_name, 'rows' as metric, cast(n as varchar) as value from per_column
union all select column_name, 'nulls', cast(nulls as varchar) from per_column
union all select column_name, 'blanks', cast(blanks as varchar) from per_column
union all select column_name, 'distinct_values', cast(n_distinct as varchar) from per_column
union all select '*', 'duplicate_key_rows', cast((select count(*) from R)
  - (select count(*) from (select distinct idfa, event, time from R) t) as varchar)
union all select '*', 'invalid_id_rows',
  cast(count(*) filter (where idfa is null or not ({VALID})) as varchar) from R
union all select '*', 'min_time', min(time) from R
union all select '*', 'max_time', max(time) from R""",
    # --- params and split
    "distinct_events": f"with {R} select distinct event from R",
    "event_counts": f"""with {R}
select event, count(*) as rows from R where event is not null group by event""",
    "param_quote_repair": f"with {R}{parsed('R')} select event_id, repaired from S",
    "param_parse": f"""with {R}{parsed('R')},
A as (
  select event_id, string_agg(key || '=' || coalesce(val, 'null'), ';' order by key) as params,
    count(*) as n
  from K group by event_id
)
select P.event_id, coalesce(A.params, '') as params, coalesce(n, 0) as n_params,
  blank or js is not null as params_ok
from P left join A using (event_id)""",
    "param_bad_rows": f"""with {R}{parsed('R')}
select event_id, idfa, event, time, param from P where not blank and js is null""",
    "param_keys_by_event": f"""with {R}{parsed('R')}
select event, string_agg(key, ',' order by key) as keys
from (select distinct event, key from K) t group by event""",
    "param_types": f"""with {R}{parsed("R")}
select event, key,
  case json_type(js, '$.' || key) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean'
    when 'DOUBLE' then 'number' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'integer' end as type,
  count(*) as rows
from (select *, unnest(json_keys(js)) as key from P where not blank and js is not null) t
group by 1, 2, 3""",
    "split_wide": f"""with {R}{parsed('R')}
select idfa, event, time,
  case when list_contains(keys, 'k') then json_extract_string(js, '$.k') else '' end as k,
  case when list_contains(keys, 'scene') then json_extract_string(js, '$.scene') else '' end
    as scene,
  case when list_contains(keys, 'win') then json_extract_string(js, '$.win') else '' end as win
from (select *, coalesce(case when not blank then json_keys(js) end, []) as keys from P) t""",
    "drop_all_null_cols": f"""with {R}{parsed('R')}
select idfa, event, time,
  coalesce(case when not blank then json_extract_string(js, '$.k') end, '') as k,
  coalesce(case when not blank then json_extract_string(js, '$.scene') end, '') as scene
from P""",
    "event_preview": f"""with {R}
select event_id, idfa, event, time, param from (
  select *, row_number() over (partition by event order by time, event_id) as n from R
) t where n <= 5""",
    "split_long": f"""with {R}{parsed('R')}
select event, key, count(*) filter (where val <> '') as filled_rows from K group by event, key""",
    "split_partition_counts": f"""with {R}{parsed('R')},
C as (select event, count(distinct key) as n from K group by event)
select R.event, count(*) as rows, 3 + max(C.n) as n_columns
from R join C on R.event = C.event group by R.event""",
    "end_to_end_event_counts": f"""with {BOTH},
D as (
  select min(event_id) as event_id, idfa, event, time, min(param) as param
  from M where {VALID} group by idfa, event, time
){parsed('D')},
A as (select event, time, idfa, count(*) as n from K group by event, time, idfa)
select P.event, count(*) as rows, cast(sum(coalesce(n, 0)) as bigint) as params,
  count(*) filter (where not blank and js is null) as unreadable
from P left join A on P.event = A.event and P.time = A.time and P.idfa = A.idfa
group by P.event""",
    "folder_pipeline_counts": f"""with {BOTH},
D as (
  select idfa, event, time, min(param) as param from M group by idfa, event, time
),
V as (select row_number() over () as event_id, * from D where {VALID}){parsed('V')}
select (select count(*) from M) as rows_before, 'idfa, event, time, param' as columns,
  (select count(*) from D) as rows_after,
  (select count(*) from M) - (select count(*) from D) as rows_removed,
  (select count(*) from D) as original_rows,
  (select count(*) from V) as remaining_rows,
  (select count(*) from D) - (select count(*) from V) as deleted_rows,
  (select round((count(*) - count(*) filter (where {VALID})) * 100 / count(*)::double, 2) from D)
    as deleted_percent,
  (select count(*) from V where event is null) as rows_without_event,
  (select count(*) from P where not blank and js is null) as unreadable_params""",
    "folder_pipeline_dau": f"""with {BOTH}
select cast(cast(time as date) as varchar) as d, count(distinct idfa) as dau
from M where {VALID} group by 1""",
    "event_view_audit": f"""with {R}
select count(*) as rows, count(*) filter (where idfa is null) as null_ids,
  count(*) filter (where try_cast(time as timestamp) is null) as unreadable_times,
  count(*) filter (where idfa is not null and try_cast(time as timestamp) is not null) as rows_in_view
from R""",
    # --- users
    "dau": active("d", "d", "dau"),
    "wau": active("cast(date_trunc('week', d) as date)", "week", "wau"),
    "mau": active("cast(date_trunc('month', d) as date)", "month", "mau"),
    "new_users": f"""with {E}
select cast(d as varchar) as d, count(*) as new_users
from (select idfa, min(d) as d from E group by idfa) t group by d""",
    "churned_users": f"""with {E}{CHURN}
select idfa, cast(last_d as varchar) as last_d from C where churned""",
    "retention": f"""with {E},
F as (select idfa, min(d) as cohort_d from E group by idfa),
A as (select distinct idfa, d from E),
Z as (select cohort_d, count(*) as cohort_users from F group by cohort_d),
O as (select unnest([1, 3, 7, 14]) as day_n),
X as (
  select F.cohort_d, date_diff('day', F.cohort_d, A.d) as day_n, count(*) as n
  from F join A using (idfa) group by 1, 2
)
select cast(Z.cohort_d as varchar) as cohort_d, cohort_users,
  cast(O.day_n as bigint) as day_n, coalesce(X.n, 0) as retained_users,
  coalesce(X.n, 0)::double / cohort_users as retention_rate
from Z cross join O left join X on X.cohort_d = Z.cohort_d and X.day_n = O.day_n
where Z.cohort_d + O.day_n <= (select max(d) from E)""",
    "user_tiers": f"with {E}{TIERS} select * from T",
    "user_levels": f"with {E} select idfa, max(k) as level from E group by idfa",
    # --- behaviour
    "sessions": f"""with {E}{SESSIONS}
select idfa, session_no, cast(start_ts as varchar) as start_ts,
  cast(end_ts as varchar) as end_ts, n_events, duration_us
from SE""",
    "session_duration_dist": f"""with {E}{SESSIONS},
B as (select unnest([0, 3600, 10800, 21600, 43200, 86400]) as from_s)
select cast(from_s as bigint) as from_s, count(*) as sessions,
  cast(sum(n_events) as bigint) as events
from (
  select n_events, (select max(from_s) from B where from_s::bigint * 1000000 <= duration_us) as from_s
  from SE) t
group by from_s""",
    "event_interval": f"""with {E}{SESSIONS},
I as (select event, date_diff('microsecond', prev_ts, ts) as gap_us
  from G where prev_ts is not null)
select event, count(*) as n, round(quantile_cont(gap_us::double, 0.5), 6) as p50_us,
  round(quantile_cont(gap_us::double, 0.9), 6) as p90_us
from I group by event""",
    "round_stats": f"""with {E}{ROUNDS}
select count(*) as rounds, count(*) filter (where win) as wins,
  count(*) filter (where win)::double / count(*) as win_rate,
  sum(duration_us)::double / count(*) as avg_duration_us,
  min(duration_us) as min_duration_us, max(duration_us) as max_duration_us
from RO""",
    "bet_histogram": f"""with {E}
select floor(value / 20.0::double) * 20.0::double as bucket, count(*) as bets
from E where value is not null group by 1""",
    "bet_percentiles": f"""with {E}
select count(value) as n, round(quantile_cont(value, 0.25), 6) as p25,
  round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75,
  round(quantile_cont(value, 0.95), 6) as p95
from E""",
    # --- ads
    "events_in_ads": f"""with {E},
A as (
  select *, lead(event) over w as next_event, lead(ts) over w as next_ts
  from E where event in ('view', 'purchase')
  window w as (partition by idfa order by ts, event_id)
)
select a.k % 4 as scene, x.event, count(*) as events, count(distinct a.event_id) as ads,
  count(distinct a.idfa) as users
from A a join E x on x.idfa = a.idfa and x.ts > a.ts and x.ts < a.next_ts
where a.event = 'view' and a.next_event = 'purchase' and x.event not in ('view', 'purchase')
group by 1, 2""",
    "ad_funnel_steps": f"""with {E},
V as (
  select v.idfa, v.ts as t1,
    (select min(p.ts) from E p where p.event = 'purchase' and p.idfa = v.idfa and p.ts > v.ts) as t2
  from E v where v.event = 'view'
),
W as (
  select V.*,
    (select min(s.ts) from E s where s.event = 'signup' and s.idfa = V.idfa and s.ts > V.t2) as t3
  from V
),
N as (
  select count(*) as n1, count(*) filter (where t2 - t1 <= interval 24 hour) as n2,
    count(*) filter (where t3 - t1 <= interval 24 hour) as n3
  from W
)
select unnest([1, 2, 3])::bigint as step, unnest(['view', 'purchase', 'signup']) as event,
  unnest([n1, n2, n3]) as reached,
  unnest([n1 / n1::double, n2 / n1::double, n3 / n1::double]) as rate
from N""",
    "ad_completion": f"""with {E}{SHOWS}
select cast(d as varchar) as d, count(*) as shows, count(*) filter (where completed) as completed,
  count(*) filter (where completed)::double / count(*) as completion_rate
from SH group by SH.d""",
    "reward_video_funnel": f"""with {E}{SHOWS}
select scene, count(*) as shows, count(distinct idfa) as users,
  count(*) filter (where completed) as completed,
  count(*)::double / (select count(distinct idfa) from E) as shows_per_active_user,
  count(*) filter (where completed)::double / count(*) as completion_rate
from SH group by scene""",
    "reward_scene_rank": f"""with {E}{SHOWS},
X as (
  select scene, count(*) as shows, count(*) filter (where completed) as completed,
    count(*) filter (where completed)::double / count(*) as completion_rate
  from SH group by scene
)
select *, rank() over (order by completion_rate desc) as scene_rank from X""",
    # --- buttons
    "button_clicks": f"""with {E}
select k % 6 as button, count(*) as clicks, count(distinct idfa) as users
from E where event = 'click' group by 1""",
    "button_by_tier": f"""with {E}{TIERS}
select k % 6 as button, tier, count(*) as clicks, count(distinct idfa) as users,
  count(*)::double / count(distinct idfa) as clicks_per_user
from E join T using (idfa) where event = 'click' group by 1, 2""",
    "button_by_ad_group": f"""with {E}{SHOWS}
select k % 6 as button, idfa in (select idfa from SH where completed) as watched_ad,
  count(*) as clicks, count(distinct idfa) as users,
  count(*)::double / count(distinct idfa) as clicks_per_user
from E where event = 'click' group by 1, 2""",
    # --- churn
    "button_cube": f"""with {E}{SHOWS}{TIERS},
Y as (
  select k % 6 as button, tier, idfa in (select idfa from SH where completed) as watched_ad, idfa
  from E join T using (idfa) where event = 'click'
)
select button, tier, watched_ad, grouping(button) = 0 as by_button, grouping(tier) = 0 as by_tier,
  grouping(watched_ad) = 0 as by_ad_group, count(*) as clicks, count(distinct idfa) as users,
  count(*)::double / count(distinct idfa) as clicks_per_user
from Y group by cube (button, tier, watched_ad)""",
    "exit_causes": f"""with {E}{SESSIONS},
L as (
  select idfa, ts from N
  qualify row_number() over (partition by idfa, session_no order by ts desc, event_id desc) = 1
),
PR as (
  select *, lead(event) over w as next_event, lead(ts) over w as next_ts, lead(k) over w as next_k
  from E where event in ('signup', 'error')
  window w as (partition by idfa order by ts, event_id)
),
PA as (
  select *, lead(event) over w as next_event
  from E where event in ('view', 'purchase')
  window w as (partition by idfa order by ts, event_id)
),
RE as (select idfa, next_ts as ts, next_k % 2 = 0 as win from PR where event = 'signup' and next_event = 'error'),
AD as (select idfa, ts, coalesce(next_event = 'purchase', false) as done from PA where event = 'view'),
BE as (select idfa, ts, value from E where value is not null),
J as (
  select
    case when L.ts - RE.ts <= interval 12 hour then case when win then 'won' else 'lost' end else 'none' end as last_round,
    case when L.ts - AD.ts <= interval 12 hour then case when done then 'completed' else 'broken_off' end else 'none' end as last_ad,
    case when L.ts - BE.ts <= interval 12 hour then BE.value end as bet
  from L asof left join RE on L.idfa = RE.idfa and L.ts >= RE.ts
    asof left join AD on L.idfa = AD.idfa and L.ts >= AD.ts
    asof left join BE on L.idfa = BE.idfa and L.ts >= BE.ts
)
select last_round, last_ad, count(*) as exits, count(bet) as with_bet,
  count(*) filter (where bet >= 100) as high_bets, count(*)::double / (select count(*) from J) as share
from J group by 1, 2""",
    "exit_events": f"""with {E}{SESSIONS},
L as (
  select event, row_number() over (
    partition by idfa, session_no order by ts desc, event_id desc) as n
  from N
)
select event, count(*) as exits,
  count(*)::double / (select count(*) from SE) as share
from L where n = 1 group by event""",
    "loss_streak_churn": f"""with {E}{CHURN}{ROUNDS}{STREAKS}
{by_churn('W', 'longest_streak')}""",
    "survival_by_streak": f"""with {E}{CHURN}{ROUNDS}{STREAKS},
U as (
  select longest_streak, churned, date_diff('day', first_d, last_d) as days
  from W join C using (idfa) join (select idfa, min(d) as first_d from E group by idfa) t using (idfa)
),
Z as (
  select a.longest_streak, a.days, count(*) filter (where a.churned) as churned,
    count(*) filter (where not a.churned) as censored,
    (select count(*) from U b where b.longest_streak = a.longest_streak and b.days >= a.days) as at_risk
  from U a group by a.longest_streak, a.days
)
select longest_streak, days, at_risk, churned, censored,
  round(product(1 - churned::double / at_risk) over (partition by longest_streak order by days), 6)
    as survival
from Z""",
    "bet_risk_churn": f"""with {E}{CHURN},
H as (select quantile_cont(value, 0.9) as p90 from E),
X as (
  select idfa, cast(5 * floor(20 * count(*) filter (where value >= p90)::double / count(*))
    as bigint) as risk_percent
  from E, H where value is not null group by idfa
)
{by_churn('X', 'risk_percent')}""",
    # --- experiment
    "ab_assign": f"""with {E}
select idfa, {ARM} as arm from (select distinct idfa from E) t""",
    "ab_metrics": f"""with {E}{CHURN},
A as (
  select {ARM} as arm, count(*) as n, count(*) filter (where churned) as x
  from C group by 1
),
B as (
  select A.*, A.n as users, x::double / n as rate,
    (select x::double / n from A where arm = 0) as rate0,
    (select n from A where arm = 0) as n0, (select x from A where arm = 0) as x0
  from A
)
select arm, users, x as churned, users - x as retained, rate as churn_rate,
  round((rate - rate0) / nullif(rate0, 0), 6) as lift,
  round((rate - rate0) / nullif(sqrt((x + x0)::double / (n + n0)
    * (1 - (x + x0)::double / (n + n0)) * (1.0::double / n + 1.0::double / n0)), 0), 6) as z
from B""",
    "ab_intervals": f"""with {E},
U as (
  select idfa, {ARM} as arm,
    (count(*) filter (where d < date '2024-01-15'))::double as x,
    (count(*) filter (where d >= date '2024-01-15'))::double as y
  from E group by idfa
),
W as (
  select arm, x, y, 0 as b, 1 as w from U
  union all
  select arm, x, y, b, {POISSON_WEIGHT} as w
  from (
    select arm, x, y, b, ('0x' || substring(md5('exp1:boot' || ((b - 1) // 4) || ':' || idfa),
      1 + 8 * ((b - 1) % 4)::int, 8))::bigint as draw
    from U, range(1, 201) as numbers(b)
  )
),
S as (
  select arm, b, sum(w)::bigint as n, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my
  from W group by all having sum(w) > 0
),
T as (select coalesce(regr_slope(y, x), 0) as slope from U),
G as (
  select S.*, slope, S.my - C.my as gap, S.my - C.my - slope * (S.mx - C.mx) as fair
  from S left join (select * from S where arm = 0) C using (b), T
)
select arm, max(n) filter (where b = 0) as users, round(max(mx) filter (where b = 0), 6) as covariate,
  round(max(my) filter (where b = 0), 6) as mean, round(max(slope), 6) as slope,
  round(max(gap) filter (where b = 0), 6) as difference,
  round(quantile_cont(gap, 0.025) filter (where b > 0), 6) as difference_low,
  round(quantile_cont(gap, 0.975) filter (where b > 0), 6) as difference_high,
  round(max(fair) filter (where b = 0), 6) as adjusted,
  round(quantile_cont(fair, 0.025) filter (where b > 0), 6) as adjusted_low,
  round(quantile_cont(fair, 0.975) filter (where b > 0), 6) as adjusted_high
from G group by arm""",
}
