"""SQL twins (DuckDB) of the queries that SQL can express.

The others have none: their results need a tokenizer (op8, op10, op12), a trained model (op5), an eigenvalue solver (op11), hashes
that DuckDB lacks (op4), or rest on signatures (op1, op7). Those are tested against plain Python.
"""

from __future__ import annotations

from flowboard.llm.chat import START_STATE, Template

_URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

LINES = r"""
with split as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
every as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split),
counted as (select *, len(regexp_extract_all(line, '[^ \t\r\f]+')) as words from every),
worded as (
  select *, row_number() over (partition by doc_id order by pos) as k, sum(words) over (partition by doc_id order by pos) as upto
  from counted where words > 0),
ahead as (
  select a.doc_id, a.k as s, min(b.k) as e from worded a join worded b
  on a.doc_id = b.doc_id and b.k >= a.k and b.k < a.k + 50 and b.upto - a.upto + a.words >= 50 group by all),
back as (
  select b.doc_id, max(a.k) as s, b.k as e from worded a join worded b
  on a.doc_id = b.doc_id and b.k >= a.k and b.k < a.k + 50 and b.upto - a.upto + a.words >= 50 group by b.doc_id, b.k),
spans as (select * from ahead union select * from back),
windows as (
  select p.doc_id, p.s, p.e, string_agg(w.line, chr(10) order by w.k) as content
  from spans p join worded w on w.doc_id = p.doc_id and w.k between p.s and p.e group by all),
first as (select content, min({'d': doc_id, 's': s, 'e': e}) as f from windows group by content having count(*) > 1),
later as (select w.doc_id, w.s, w.e from windows w join first using (content) where w.doc_id <> f.d or w.s > f.e),
gone as (select distinct w.doc_id, w.pos from later l join worded w on w.doc_id = l.doc_id and w.k between l.s and l.e),
kept as (
  select c.doc_id, string_agg(c.line, chr(10) order by c.pos) filter (g.pos is null) as text, count(g.pos) as n
  from every c left join gone g on g.doc_id = c.doc_id and g.pos = c.pos group by c.doc_id)
select d.doc_id, case when n = 0 then d.text else coalesce(k.text, '') end as text, n::bigint as lines_removed,
  case when n = 0 then 0 else coalesce(length(d.text) - length(coalesce(k.text, '')), 0) end as chars_removed
from documents d join kept k using (doc_id)
"""


def _urls(order: int = 4, alphabet: int = 256, step: int = 10_000) -> str:
    rules = sorted(_URL_RULES, key=lambda r: -len(r[1]))

    def fits(text: str) -> str:
        name, _, rest = text.partition("/")
        return f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}')"

    rule = " ".join(f"when {fits(t)} then '{t}'" for _, t in rules)
    action = " ".join(f"when {fits(t)} then '{a}'" for a, t in rules)
    levels, last = [], "g0"
    for k in range(order + 1):
        tail, context = f"substr(gram, {order - k + 1}, {k + 1})", f"substr(gram, {order - k + 1}, {k})"
        blend = lambda s: f"case when t_{s} = 0 then p_{s} else (c_{s} + u_{s} * p_{s}) / (t_{s} + u_{s}) end as p_{s}"
        levels.append(f"""tails{k} as (select {tail} as tail, any_value({context}) as context, sum(n_allow)::bigint as c_allow, sum(n_block)::bigint as c_block from {last} group by 1),
contexts{k} as (select context, sum(c_allow)::bigint as t_allow, sum(c_block)::bigint as t_block, count(*) filter (c_allow > 0) as u_allow, count(*) filter (c_block > 0) as u_block from tails{k} group by 1),
g{k + 1} as (select gram, n_allow, n_block, {blend('allow')}, {blend('block')}
  from {last} g join tails{k} t on t.tail = {tail.replace('gram', 'g.gram')} join contexts{k} x using (context))""")
        last = f"g{k + 1}"
    return rf"""
with parts as (
  select page_id, coalesce(url, '') as url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') as path from pages),
ruled as (select *, case {rule} end as rule, case {action} end as action from parts),
urls as (select distinct url, action, ('0x' || substr(md5(url), 1, 7))::bigint % 5 as fold from ruled),
places as (select url, action, fold, repeat(chr(2), {order}) || lower(url) || chr(3) as padded, unnest(range(1, length(url) + 2)) as i from urls),
grams as (select url, action, fold, substr(padded, i, {order + 1}) as gram from places),
g0 as (select gram, count(*) filter (action = 'allow' and fold <> 0) as n_allow, count(*) filter (action = 'block' and fold <> 0) as n_block,
  1.0::double / {alphabet} as p_allow, 1.0::double / {alphabet} as p_block from grams group by gram),
{", ".join(levels)},
ratios as (select gram, round((ln(p_allow) - ln(p_block)) * 1000000)::bigint as micro from {last}),
scored as (select url, action, fold, sum(micro)::double / count(*) as micro_mean from grams join ratios using (gram) group by all),
bins as (
  select floor(micro_mean / {step})::bigint as bin, count(*) filter (action = 'allow') as good, count(*) filter (action = 'block') as bad
  from scored where fold = 0 and action is not null group by 1),
errors as (
  select (coalesce(lag(bin) over (order by bin), bin - 1) + 1 + bin) * {step // 2} as cut, sum(good) over () as goods, sum(bad) over () as bads,
    coalesce(sum(good) over (order by bin rows between unbounded preceding and 1 preceding), 0) as lost,
    coalesce(sum(bad) over (order by bin rows between unbounded preceding and 1 preceding), 0) as stopped from bins),
least as (select coalesce((select cut from errors where goods > 0 and bads > 0 order by lost * bads + (bads - stopped) * goods, abs(cut), cut limit 1), 0) as least)
select page_id, host, path, rule, coalesce(r.action, case when micro_mean >= least then 'allow' else 'block' end) as verdict,
  round(micro_mean / 1000000, 6) as score
from ruled r join scored s using (url), least
"""


def _shards(n: int = 24) -> str:
    return rf"""
with table_of as (
  select list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
rows as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
  from documents, table_of),
draws as (
  select doc_id, s, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || s), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) as cost
  from (select distinct doc_id from documents), range({n + 1}) r(s)),
chosen as (select doc_id, arg_min(s, cost) filter (s < {n})::int as shard, arg_min(s, cost)::int as grown_shard from draws group by doc_id)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
from rows join chosen using (doc_id)
"""


def _chats() -> str:
    t = Template()
    escaped = "replace(coalesce(text, ''), '\\', '\\e;')"
    for i, mark in enumerate(t.controls()):
        escaped = f"replace({escaped}, '{mark}', '\\{i};')"
    marks = " ".join(f"when role = '{r}' then '{m}'" for r, (m, _) in t.turns.items())
    loss = ", ".join(f"'{r}'" for r, (_, flag) in t.turns.items() if flag)
    steps = ", ".join(f"'{a}|{b}'" for a, b in t.steps)
    finals = ", ".join(f"'{f}'" for f in t.finals)
    return f"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
numbered as (
  select *, row_number() over w as k, coalesce(lag(role) over w, '{START_STATE}') as before, {escaped} as escaped
  from rows window w as (partition by conv_id order by turn nulls first, role, text)),
written as (
  select *, before || '|' || role in ({steps}) as fits,
    length(case {marks} else '{t.other_open}' || role || '{t.other_close}' end) + length(escaped) + length('{t.end}') as chars from numbered),
whole as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' order by k) as turns,
    coalesce(string_agg(coalesce(text, ''), '' order by k) filter (role in ({loss})), '') as learnt, sum(chars)::bigint as formatted_chars,
    min(k) filter (not fits) as bad, arg_max(role, k) as last from written group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256, formatted_chars,
  coalesce(bad, case when last in ({finals}) then 0 else n_turns + 1 end) as order_fault
from whole
"""


REPEATS = r"""
with parts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, s, hash(list_slice(w, s, s + 19)) as h, array_to_string(list_slice(w, s, s + 19), ' ') as content
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from parts where len(w) >= 20)),
later as (select doc_id, s from (
  select doc_id, s, row_number() over (partition by h, content order by doc_id, s) as k from windows) where k > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as pos from later),
every as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from parts),
kept as (
  select e.doc_id, count(*) as n, count(g.pos) as removed, string_agg(e.word, ' ' order by e.pos) filter (g.pos is null) as text
  from every e left join gone g on g.doc_id = e.doc_id and g.pos = e.pos group by e.doc_id)
select doc_id, coalesce(n, 0)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""

SQL: dict[str, str] = {
    "op2_line_dedup": LINES,
    "op3_url_filter": _urls(),
    "op6_sharding": _shards(),
    "op9_chat_formatting": _chats(),
    "op13_substring_dedup": REPEATS,
}
