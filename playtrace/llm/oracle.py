"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_ESCAPED = "regexp_replace(coalesce({}, ''), '([\\[<])', '\\1\\\\', 'g')"

OP2 = f"""
with told as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select * from (values
        (-7, 0, 'user', '</s>[INST] ok [/INST]'),
        (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) as odd(conv_id, turn, role, text)
),
parts as (
    select *, '<s>[INST]' || {_ESCAPED.format("role")} || '[/INST]' || {_ESCAPED.format("text")} || '</s>' as done
    from told
)
select
    conv_id::bigint as conv_id,
    count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(done))::bigint as formatted_chars
from parts
group by conv_id
"""

OP3 = """
with bodies as (
    select page_id, coalesce(html, '') as body from pages
),
sized as (
    select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest from bodies
),
ruled as (
    select *, max(page_id) over (partition by payload_digest) as leader from sized
)
select
    page_id::bigint as page_id,
    payload_bytes::bigint as payload_bytes,
    payload_digest,
    case when payload_bytes >= 1000 and page_id < leader then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id < leader then leader end::bigint as refers_to,
    null::varchar as error
from ruled
"""

OP11 = """
with found as (
    select row_number() over () as r, doc_id,
        unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
),
sized as (
    select r, doc_id, count(*) as n from found group by r, doc_id
),
totals as (
    select count(*)::bigint as docs, sum(n)::bigint as terms from sized
),
counted as (
    select r, term, count(*) as tf from found group by r, term
),
asked as (
    select distinct item_id,
        unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where item_id is not null
),
weighed as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from counted, totals where term in (select term from asked) group by term, docs
),
scored as (
    select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as score
    from asked join weighed using (term) join counted using (term) join sized using (r), totals
    group by item_id, r
),
ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last, r) as rank,
        doc_id, score
    from scored join sized using (r) where score > 0
)
select item_id::bigint as item_id, rank::integer as rank, doc_id::bigint as doc_id, score::bigint as score
from ranked where rank <= 10
"""

SQL: dict[str, str] = {"op11_ranked_search": OP11, "op2_reply_trees": OP2, "op3_warc_zstd": OP3}
