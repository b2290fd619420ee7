"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP5 = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as sh
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.c as component_id, d.doc_id = c.c as kept
from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) c on c.a = d.doc_id
"""


def _spans(kind: str, pattern: str, cond: str = "true") -> str:
    """Rows (doc_id, k, kind, s, e) of the leftmost matches of a pattern; starts are sums of what lies before."""
    return f"""
select doc_id, s, s + length(m) as e, m, '{kind}' as kind from (
  select doc_id, m, coalesce(sum(length(gap) + length(m)) over (partition by doc_id order by i), 0) - length(m) as s
  from (select doc_id, unnest(regexp_extract_all(t, '{pattern}')) as m, unnest(regexp_split_to_array(t, '{pattern}')[:-2]) as gap, unnest(range(0, len(regexp_extract_all(t, '{pattern}')))) as i from d)
) where {cond}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: case when j % 2 = 1 then reverse({_DIGITS})[j]::int else (reverse({_DIGITS})[j]::int * 2) // 10 + (reverse({_DIGITS})[j]::int * 2) % 10 end)) % 10 = 0"

#: The base spans; the test tables hold no disguised ones, which SQL cannot express.
OP2 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (
  {_spans('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')} union all
  {_spans('ip', r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', "list_max(list_transform(string_split(m, '.'), lambda x: x::hugeint)) <= 255")} union all
  {_spans('card', r'[0-9](?:[\x20-]?[0-9])+', f"length({_DIGITS}) between 13 and 19 and {_LUHN}")} union all
  {_spans('phone', r'\+[0-9][\x20().0-9-]+[0-9]', f"length({_DIGITS}) between 9 and 15")}),
o as (select *, list_position(['email', 'ip', 'card', 'phone'], kind) as k from s),
g as (select doc_id, string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by k, s) as spans, count(*) filter (k = 1) as n_email, count(*) filter (k = 2) as n_ip, count(*) filter (k = 3) as n_card, count(*) filter (k = 4) as n_phone from o group by doc_id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join g using (doc_id)
"""

OP6 = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
h as (select doc_id, n, hex(b) as x from d),
w as (select doc_id, i, md5(substr(x, 2 * i + 1, 800)) as m from (select doc_id, x, unnest(range(0, n - 399)) as i from h where n >= 400)),
r as (select doc_id, i from w where m in (select m from w group by m having count(*) > 1)),
g as (select *, sum(fresh) over (partition by doc_id order by i) as run from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as fresh from r)),
s as (select doc_id, run, min(i) as a, max(i) + 400 as z from g group by doc_id, run),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before, row_number() over (partition by doc_id order by a desc) as last from s),
c as (select k.doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || max(case when last = 1 then substr(x, 2 * z + 1) end) as kept from k join h using (doc_id) group by k.doc_id)
select h.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from h left join c using (doc_id)
"""

#: All pairs; at the scale of the oracle's table no pair lies near the threshold, where hashing may miss it.
OP10 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as c from r group by a),
n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, vec_id = c.c as kept from embeddings join c on c.a = vec_id left join n on n.a = vec_id
"""

ORACLES = {
    "op2_pii": OP2,
    "op6_suffixes": OP6,
    "op10_pstable": OP10,
    "op5_minhash": OP5,
}
