"""SQL of the spelling and the conversation operator, for checking results.

CRC-32 is computed byte by byte in a recursive query over all keys at once, as DuckDB has no function for it.
"""

_UPPER = "".join(map(chr, range(65, 91)))

# keys(k) are the texts; crc(k, h) their unsigned CRC-32
_CRC = """steps as (
  select i, i as c, 0 as n from range(256) t(i)
  union all
  select i, xor(c >> 1, (c & 1) * 3988292384), n + 1 from steps where n < 8),
bytes as (
  select k, hex(encode(k)) as x, 0 as p, 4294967295::bigint as c from keys
  union all
  select k, x, p + 1, xor(t.c, b.c >> 8) from bytes b
  join (select i, c from steps where n = 8) t on t.i = xor(b.c & 255, ('0x' || substr(x, 2 * p + 1, 2))::bigint)
  where 2 * p < length(x)),
crc as (select k, xor(c, 4294967295::bigint) as h from bytes where 2 * p = length(x))"""

SPELLING = f"""with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_UPPER.lower()}') as run
  from documents),
found as (select id || ':' || run as k, run, count(*) as c from runs where length(run) >= 6 group by all),
keys as (select distinct k from found),
{_CRC},
counted as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word,
         sum(c)::bigint as n
  from found join crc using (k) group by 1),
words as (select word, n from counted where length(word) >= 6 and n >= 5),
less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.v = b.v and a.i = b.i and a.word <> b.word
  union
  select a.word, b.word, b.n from less a join words b on a.v = b.word
  union
  select b.word, a.word, a.n from less a join words b on a.v = b.word),
ranked as (
  select word, near, near_n, count(*) over (partition by word) as n_near,
         row_number() over (partition by word order by near_n desc, near) as nth from near),
formed as (
  select w.word, w.n, coalesce(r.n_near, 0) as n_near,
         case when r.near_n >= 5 * w.n then r.near end as form, case when r.near_n >= 5 * w.n then r.near_n end as form_n
  from words w left join ranked r on r.word = w.word and r.nth = 1),
chain as (
  select word, word as reached from formed
  union all
  select c.word, f.form from chain c join formed f on f.word = c.reached where f.form is not null),
ends as (select c.word, c.reached as root from chain c join formed f on f.word = c.reached where f.form is null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n from formed f join ends e on e.word = f.word
"""

CONVERSATIONS = f"""with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
keys as (select distinct k from given),
{_CRC},
damaged as (
  select conv_id, turn, case when h % 20 = 4 then 'user' else role end as role,
         case h % 20 when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when h % 20 = 3 then 2 else 1 end)) as copy
  from given join crc using (k) where h % 20 <> 0),
placed as (
  select *, dense_rank() over (order by conv_id) as c,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as initial
  from damaged),
faulty as (
  select *, lead(initial) over (partition by c order by i) as following,
         case when not regexp_matches(text, '[^ \\t-\\r]') then 'blank'
              when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][ \\t-\\r]*$') then 'truncated' else '' end as fault
  from placed),
inserts(s, t, letters, cost, made) as (values
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 5, 'user:' || chr(10)), (1, 2, 'I', 5, 'user:' || chr(10)), (3, 2, 'I', 5, 'user:' || chr(10)), (2, 3, 'I', 5, 'assistant:' || chr(10)),
  (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
  (3, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 'II', 10, 'assistant:' || chr(10) || 'user:' || chr(10))),
uses(s, t, letter, cost, initial, role) as (values
  (0, 0, 'D', 2, null, null), (1, 1, 'D', 2, null, null), (2, 2, 'D', 2, null, null), (3, 3, 'D', 2, null, null),
  (0, 1, 'K', 0, 's', null), (0, 2, 'K', 0, 'u', null), (1, 2, 'K', 0, 'u', null), (2, 3, 'K', 0, 'a', null), (3, 2, 'K', 0, 'u', null),
  (0, 2, 'R', 1, null, 'user'), (1, 2, 'R', 1, null, 'user'), (2, 3, 'R', 1, null, 'assistant'), (3, 2, 'R', 1, null, 'user')),
edits as (
  select n.s, u.t, n.letters || u.letter as letters, n.cost + u.cost as cost, u.initial, u.letter, n.made, u.role
  from inserts n join uses u on n.t = u.s),
best as (
  select distinct c, 0::bigint as i, 0 as s, {{'cost': 0::bigint, 'audit': '', 'made': ''}} as way from faulty
  union all
  select b.c, b.i + 1, e.t,
         min({{'cost': b.way.cost + e.cost + case when f.fault = 'truncated' and e.letter <> 'D' then 5 else 0 end,
              'audit': b.way.audit || e.letters,
              'made': b.way.made || e.made || case when e.letter = 'D' then '' else coalesce(e.role, f.role) || ':' || f.text || chr(10) end}})
  from best b join faulty f on f.c = b.c and f.i = b.i + 1
  join edits e on e.s = b.s and (e.letter = 'D' or f.fault not in ('blank', 'duplicate')) and (e.initial is null or e.initial = f.initial)
  group by b.c, b.i + 1, e.t),
sized as (select c, any_value(conv_id) as conv_id, count(*) as n from faulty group by c),
done as (
  select z.conv_id, min({{'cost': b.way.cost + n.cost, 'audit': b.way.audit || n.letters, 'made': b.way.made || n.made}}) as way
  from sized z join best b on b.c = z.c and b.i = z.n join inserts n on n.s = b.s where n.t in (0, 3) group by all),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         sum((fault = 'blank')::int) as blank, sum((fault = 'duplicate')::int) as duplicate, sum((fault = 'truncated')::int) as truncated,
         sum((following is not null and initial || following not in ('su', 'ua', 'au'))::int) as illegal
  from faulty group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(d.way.cost, 0)::bigint as cost,
       coalesce(d.way.audit, '') as audit, sha256(left(coalesce(d.way.made, ''), greatest(length(coalesce(d.way.made, '')) - 1, 0))) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts n on n.conv_id is not distinct from o.conv_id
left join done d on d.conv_id is not distinct from o.conv_id
"""
