"""DuckDB SQL of the queries that it can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
with item as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
gram as (
    select item, w[i : i + 12] as g from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item where len(w) > 0)),
doc as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
known as (select g, len(g) as n, list(distinct item) as items from gram group by g),
place as (
    select r, i, l.n as n, w[i : i + l.n - 1] as g
    from (select distinct n from known) l, doc, unnest(range(1, len(w) - l.n + 2)) as u(i)),
hit as (select r, i, p.n, items from place p join known k on p.g = k.g),
cover as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + n)) as x from hit) group by r),
item_of as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from (select r, unnest(items) as item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join cover using (r) left join item_of using (r)
"""

OP10 = r"""
with n as (
    select row_number() over () as r, doc_id, length(coalesce(text, '')) as n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
    first_value(r) over w = r as kept, sha256(norm) as text_sha256
from n window w as (partition by norm order by n desc, doc_id nulls last, r)
"""

OP6 = r"""
with page as (
    select row_number() over () as r, page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
        regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) as seg,
        timestamp '2024-01-01 00:00:00' + to_minutes(page_id * 7919 % 43200) as fetched_at
    from pages),
entry as (
    select event_id, ts, case event_type when 'error' then 'block' when 'signup' then 'allow' else 'remove' end as action,
        case event_id % 3 when 0 then 'domain:' || lower(regexp_replace(host, '^[^.]*\.', '')) when 1 then 'host:' || lower(host) else 'path:' || lower(host || '/' || seg) end as key
    from events join page on page_id = user_id),
one as (select key, ts, arg_max(action, event_id) as action from entry group by key, ts),
span as (select key, action, ts as since, lead(ts) over (partition by key order by ts) as until from one),
label as (select r, string_split(host, '.') as l from page where host <> ''),
asked as (
    select r, n as rank, 'domain:' || array_to_string(l[len(l) - n + 1 :], '.') as key from label, unnest(range(1, len(l) + 1)) as u(n)
    union all select r, 1000, 'host:' || host from page where host <> ''
    union all select r, 2000, 'path:' || host || '/' || seg from page where host <> ''),
met as (
    select p.r, rank, s.key, action, since from asked a join page p using (r) join span s on a.key = s.key
    where since <= fetched_at and (until is null or fetched_at < until) and action in ('block', 'allow')),
best as (select r, arg_max(action, rank) as action, arg_max(key, rank) as key, max(since) filter (rank = top) as since
    from (select *, max(rank) over (partition by r) as top from met) group by r)
select page_id, url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f') as fetched_at, coalesce(action, 'none') as verdict, key as rule,
    strftime(since, '%Y-%m-%d %H:%M:%S.%f') as since
from page left join best using (r)
"""



def _assigned(rows: str, books: str) -> str:
    """The nearest entry of every part of `rows` in `books`, and its squared distance."""
    return f"""
    select r, p, v, arg_min(e, struct_pack(d := d, e := e)) as e, min(d) as d from (
        select r, x.p, v, e, list_sum(list_transform(list_zip(v, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
        from {rows} x join {books} y on x.p = y.p)
    group by r, p, v"""


def _codes(rounds: int = 6) -> str:
    steps = ""
    for i in range(rounds):
        steps += f"""
a{i} as materialized ({_assigned("part", f"book{i}")}),
m{i} as (select p, e, k, cast(floor(sum(v[k]) / count(*)) as bigint) as c from (select p, e, v, unnest(range(1, len(v) + 1)) as k from a{i}) group by p, e, k),
book{i + 1} as materialized (
    select b.p, b.e, coalesce(n.v, b.b) as b from book{i} b left join (select p, e, list(c order by k) as v from m{i} group by p, e) n on b.p = n.p and b.e = n.e),"""
    return f"""
with kept as materialized (
    select row_number() over (order by vec_id nulls last) - 1 as r, vec_id, label, list_transform(embedding, lambda c: cast(floor(cast(c as double) * 4096) as bigint)) as x
    from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
part as materialized (
    select r, p, x[p * len(x) // 8 + 1 : (p + 1) * len(x) // 8] as v from kept, unnest(range(8)) as u(p)),
book0 as materialized (select p, r as e, v as b from part where r < 16),{steps}
last as materialized ({_assigned("part", f"book{rounds}")}),
coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from last group by r),
digest as (select sha256(string_agg(array_to_string(b, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join coded using (r), digest
"""


SQL = {"op6_url_filter": OP6, "op8_decontaminate": OP8, "op10_exact_dedup": OP10, "op13_codes": _codes()}
