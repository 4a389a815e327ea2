"""DuckDB SQL for the queries that SQL can express, each by plain brute force over whole tables."""

from __future__ import annotations

from codelode.llm.chat import END, ESCAPES, NEXT, TEXT, TURN
from codelode.llm.mixing import SLOPES, WEIGHTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint n, sha1(coalesce(html, '')) h from pages),
f as (select h, min(page_id) first_id from p group by h)
select page_id, n payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end record_type,
  case when page_id <> first_id then first_id end refers_to
from p join f using (h)"""

OP2 = f"""
with recursive w as (select doc_id, unnest(ws) w, unnest(range(len(ws))) i from (select doc_id, {WORDS} ws from documents)),
g as (select doc_id, count(*) over (partition by doc_id) n, lead(w, 4) over o is not null as whole, i, hash(concat_ws(' ', w, lead(w) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o)) g
  from w window o as (partition by doc_id order by i)),
l as (select doc_id, list(distinct g order by g) sh from g where whole or n < 5 and i = 0 group by doc_id),
s as (select doc_id, coalesce(sh, []) sh from documents left join l using (doc_id)),
r as (select sh, min(doc_id) id, len(sh) n from s where len(sh) > 0 group by sh),
x as (select id, n, unnest(sh) g from r),
hits as (select a.id a, b.id b, count(*) shared from x a join x b on a.g = b.g and a.id < b.id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by all),
links as (select a, b from hits join r ra on ra.id = a join r rb on rb.id = b where 100 * shared >= 75 * (ra.n + rb.n - shared)),
e as (select a, b from links union select b, a from links),
reach(id, other) as (select id, id from r union select reach.id, e.b from reach join e on e.a = reach.other),
c as (select id, min(other) root from reach group by id)
select s.doc_id, len(s.sh)::bigint n_shingles, coalesce(root, s.doc_id) component_id, coalesce(root, s.doc_id) = s.doc_id kept
from s left join r on r.sh = s.sh left join c on c.id = r.id"""


def _escaped(column: str) -> str:
    out = f"coalesce({column}, '')"
    for plain, coded in ESCAPES:
        out = f"replace({out}, '{plain}', '{coded}')"
    return out


OP3 = f"""
with a as (select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, {_escaped("role")} er, {_escaped("text")} ex,
  row_number() over (partition by conv_id order by turn nulls first, {_escaped("role")}, {_escaped("text")}) k from a),
b as (select *, lag(r) over (partition by conv_id order by k) is distinct from r as starts from t)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by k)) turns_sha256,
  coalesce(sum(length(x)) filter (where r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by k) filter (where r = 'assistant'), '')) loss_sha256,
  sum(length(ex) + case when starts then length(er) + {len(TURN) + len(TEXT) + len(END)} else {len(NEXT)} end)::bigint formatted_chars
from b group by conv_id"""

OP4 = f"""
with w as (select doc_id, {WORDS} ws from documents where doc_id is not null),
p as (select doc_id, ws, unnest(range(1, len(ws) - 48)) i from w),
g as (select doc_id, i - 1 s, hash(array_to_string(ws[i:i + 49], ' ')) h from p),
f as (select h from g group by h having count(distinct doc_id) > 1),
m as (select doc_id, s, s > lag(s) over (partition by doc_id order by s) + 50 is not false as fresh from (select distinct doc_id, s from g join f using (h))),
n as (select doc_id, s, sum(fresh::int) over (partition by doc_id order by s) island from m)
select doc_id, min(s)::bigint start_word, max(s + 50)::bigint end_word, (max(s + 50) - min(s))::bigint n_words from n group by doc_id, island"""

OP6 = rf"""
with z as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 15))::bigint h from documents),
u as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) k from z group by source),
v as (select *, {list(WEIGHTS)}[((k - 1) % {len(WEIGHTS)} + 1)::int]::double weight, {list(SLOPES)}[((k - 1) % {len(SLOPES)} + 1)::int]::double slope, source_size * 3.0::double cap from u),
r as (select *, row_number() over (order by cap / weight, k) step,
  ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0::double)) / sum(weight) over (order by cap / weight, k rows between current row and unbounded following) lev from v),
q as (select min_by(lev, step) lev from r where lev <= cap / weight),
s as (select source, source_size, slope, least(cap, coalesce((select lev from q) * weight, cap)) target from r),
o as (select z.doc_id, size, source_size, slope, target, case when source_size > 0 then round(target)::bigint // source_size else 0 end passes,
  coalesce(sum(size) over (partition by z.source order by h, z.doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint off from z join s on z.source is not distinct from s.source),
t as (select *, greatest(0, least(size, round(target)::bigint - passes * source_size - off))::bigint part from o),
c as (select *, case when size > 0 then passes + (part > 0)::bigint else 0 end copies from t)
select doc_id, size, source_size, target, (size * passes + part)::bigint taken,
  array_to_string(list_transform(list_transform(range(0, copies), lambda k: least(1::double, (k * source_size + off) / target)),
    lambda p: floor(1000000000 * case when slope = 0 then p else (sqrt((1 - slope) * (1 - slope) + 4 * slope * p) - (1 - slope)) / (2 * slope) end)::bigint), ',') positions_e9
from c"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAME = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_SPANS = {
    "assign": (rf"""({_NAME})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 12"),
    "access": (r"AKIA[A-Z0-9]+", 0, "length(v) >= 18"),
    "hex": (r"[0-9a-f]+", 0, "length(v) >= 16"),
    "opaque": (r"[A-Za-z0-9_-]+", 0, "length(v) >= 24 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')"),
}


def _matches(kind: int, name: str) -> str:
    """Rows (k, st, en, kind, v) of a kind's matches: the gaps and matches of a text, laid end to end."""
    pattern, group, holds = _SPANS[name]
    return f"""(select k, st, st + length(m) en, {kind} kind, v from (
  select k, m, v, (sum(length(gap)) over o + sum(length(m)) over o - length(m))::bigint st from (
    select k, generate_subscripts(ms, 1) i, unnest(ms) m, unnest(regexp_extract_all(t, '{pattern}', {group})) v, unnest(gaps[1:len(ms)]) gap from (
      select k, t, regexp_extract_all(t, '{pattern}') ms, string_split_regex(t, '{pattern}') gaps from d))
  window o as (partition by k order by i)) where {holds})"""


_JOINED = "string_agg(['assign', 'access', 'hex', 'opaque'][kind] || ':' || st || ':' || en, ',' order by st, kind, en)"
OP8 = f"""
with d as (select row_number() over () k, doc_id, coalesce(text, '') t, source from documents),
base as ({" union all ".join(_matches(i + 1, n) for i, n in enumerate(("assign", "access", "hex")))}),
free as (select * from {_matches(4, "opaque")} x where not exists (select 1 from base y where y.k = x.k and y.st < x.en and x.st < y.en)),
every as (select * from base union all select * from free),
own as (select v, count(distinct coalesce('=' || source, '?')) owners, count(distinct coalesce('=' || doc_id, '?')) repos from every join d using (k) group by v),
kept as (select every.*, owners, repos, owners <= 1 and repos <= 10 live from every join own using (v)),
b as (select k, count(*) filter (where kind = 1) n_assign, count(*) filter (where kind = 2) n_access, count(*) filter (where kind = 3) n_hex, {_JOINED} js from base group by k),
a as (select k, {_JOINED} filter (where kind < 4 or live) js, count(*) filter (where live) n_live, count(*) filter (where owners >= 2 or repos >= 11) n_example, max(owners) max_owners, max(repos) max_repos from kept group by k)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(b.js, '')) base_sha256, coalesce(a.js, '') spans, coalesce(n_live, 0)::bigint n_live, coalesce(n_example, 0)::bigint n_example,
  coalesce(max_owners, 0)::bigint max_owners, coalesce(max_repos, 0)::bigint max_repos
from d left join b using (k) left join a using (k)"""

ORACLES = {"op1_warc": OP1, "op2_minhash": OP2, "op3_chat_format": OP3, "op4_suffix_passages": OP4, "op6_mixing": OP6, "op8_secrets": OP8}
