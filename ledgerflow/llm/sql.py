"""DuckDB SQL of the later operators: each from its definition, not from its code."""

from __future__ import annotations

#: Every level of every tree, bottom up; siblings are the other nodes under one parent.
OP13_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, source, text, cast(doc_id as varchar) as id,
         case when doc_id is null then '-' else strlen(cast(doc_id as varchar)) || ':' || doc_id end
         || case when source is null then '-' else strlen(source) || ':' || source end
         || case when lang is null then '-' else strlen(lang) || ':' || lang end
         || case when n_chars is null then '-' else strlen(cast(n_chars as varchar)) || ':' || n_chars end as head
  from documents),
crc as (
  select r, xor(4294967295::bigint, list_reduce(
      list_transform(string_split(id, ''), lambda c: ascii(c)::bigint),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::bigint)),
      4294967295::bigint)) as crc
  from d where id is not null),
l as (
  select d.r, doc_id, source,
         sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
         sha256(head || case when text is null then '-' else strlen(t2) || ':' || t2 end) as held
  from (select d.*, crc, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as t2 from d left join crc using (r)) d),
placed as (
  select *, coalesce('=' || source, '') as grp,
         row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as place
  from l),
up as (
  select grp, 0 as lvl, place as idx, leaf as node from placed
  union all
  select grp, lvl + 1, idx // 3, sha256(string_agg(node, '' order by idx))
  from (select *, count(*) over (partition by grp) as n from up) where n > 1 group by grp, lvl, idx // 3),
subroots as (
  select grp, max(lvl) as height, arg_max(node, lvl) as subroot from up group by grp),
top as (
  select 0 as lvl, row_number() over (order by encode(grp)) - 1 as idx, subroot as node from subroots
  union all
  select lvl + 1, idx // 3, sha256(string_agg(node, '' order by idx))
  from (select *, count(*) over () as n from top) where n > 1 group by lvl, idx // 3),
sides as (
  select grp, lvl as step, false as top_side, idx // 3 as parent, idx, node from up
  union all select '', lvl, true, idx // 3, idx, node from top),
names as (select grp, row_number() over (order by encode(grp)) - 1 as top_idx, height, subroot from subroots),
tall as (select max(lvl) as height, arg_max(node, lvl) as root from top),
walk as (
  select p.r, p.grp, false as in_top, 0 as lvl, p.place as idx, p.held as node, '' as proof, n.height, n.top_idx, n.subroot, tall.height as top_height
  from placed p join names n using (grp), tall
  union all
  select r, grp, in_top or lvl >= height, case when not in_top and lvl >= height then 0 else lvl + 1 end,
         case when not in_top and lvl >= height then top_idx else idx // 3 end,
         case when not in_top and lvl >= height then node else sha256(before || node || after) end,
         case when not in_top and lvl >= height then proof else proof || before || after end,
         height, top_idx, subroot, top_height
  from (
    select w.*,
           coalesce((select string_agg(s.node, '' order by s.idx) from sides s where s.top_side = w.in_top
                     and s.grp = case when w.in_top then '' else w.grp end and s.step = w.lvl and s.parent = w.idx // 3 and s.idx < w.idx), '') as before,
           coalesce((select string_agg(s.node, '' order by s.idx) from sides s where s.top_side = w.in_top
                     and s.grp = case when w.in_top then '' else w.grp end and s.step = w.lvl and s.parent = w.idx // 3 and s.idx > w.idx), '') as after
    from walk w)
  where not (in_top and lvl >= top_height))
select p.doc_id, p.leaf, w.subroot, tall.root, sha256(w.proof) as proof_sha256, w.node as folded_root, w.node = tall.root as verified
from placed p join walk w using (r), tall where w.in_top and w.lvl >= w.top_height
"""

#: All phrases of all texts, counted one by one.
OP12_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d)),
f as (
  select lang, m, w[k:k + m - 1] as phrase, count(*) as n
  from p, (values (1), (2), (3), (4)) as s(m), unnest(range(1, len(w) - m + 2)) as t(k) where len(w) >= m group by all),
totals as (select lang, sum(n) as n from f where m = 1 group by lang),
c as (select * from f where m > 1 and n >= 30),
cuts as (
  select c.lang, c.phrase, c.m, c.n as a, k, l.n as l, r.n as r, (2000000::hugeint * c.n) // (l.n + r.n) as score
  from c, unnest(range(1, c.m)) as t(k)
  join f l on l.lang = c.lang and l.phrase = c.phrase[1:k]
  join f r on r.lang = c.lang and r.phrase = c.phrase[k + 1:c.m]),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, phrase[s:s + q - 1] as phrase, max(n) as longer
  from c, unnest(range(2, m)) as t(q), unnest(range(1, m - q + 2)) as u(s) group by all),
kept as (
  select weakest.*, array_to_string(phrase, ' ') as text
  from weakest left join inner_ using (lang, phrase) where longer is null or 100 * longer < 80 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(text)) as rank from kept)
select lang, cast(rank as bigint) as rank, text as phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
       cast(totals.n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""

_HALF_MEAN, _HALF_DEV = "0.7978845608028654e0", "0.6028102749890869e0"

#: Patterns' matches placed by what lies between them; the battery from one row per symbol.
OP11_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
m as (
  select r, text, 0 as kind, regexp_extract_all(text, p) as held, string_split_regex(text, p) as rest, regexp_extract_all(text, p, 2) as part, 12 as least
  from d, (select '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' as p)
  union all
  select r, text, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 18 from d
  union all
  select r, text, 2, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), 16 from d
  union all
  select r, text, 3, regexp_extract_all(text, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}'), string_split_regex(text, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}'),
         regexp_extract_all(text, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}'), 20 from d),
e as (
  select r, kind, i, length(rest[i]) as gap, length(held[i]) as size, held[i] as run, length(part[i]) >= least as counts
  from m, unnest(range(1, len(held) + 1)) as t(i)),
placed as (select *, sum(gap + size) over (partition by r, kind order by i) - size as start, sum(gap + size) over (partition by r, kind order by i) as stop from e),
letters as (select r, regexp_replace(array_to_string(rest, ' '), '[^A-Za-z0-9]+', '', 'g') as letters from m where kind = 3 and len(held) > 0),
tested as (
  select row_number() over () as t, * from (
    select r, i, size, 0 as decoy, run from e where kind = 3
    union all
    select r, i, size, k + 1, substr(letters, cast(k * size + 1 as bigint), size) from e join letters using (r), unnest(range(0, 20)) as u(k)
    where kind = 3 and length(letters) >= (k + 1) * size)),
alphabets(no, symbols) as (values (1, '0123456789abcdef'), (2, '0123456789ABCDEF'), (3, 'abcdefghijklmnopqrstuvwxyz'), (4, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'),
  (5, 'abcdefghijklmnopqrstuvwxyz0123456789'), (6, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'),
  (7, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'), (8, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/')),
owned as (
  select t, arg_min(symbols, no) as symbols, any_value(own) as own
  from (select t, translate(rtrim(run, '='), '-_', '+/') as own from tested), alphabets where translate(own, symbols, '') = '' group by t),
signs as (
  select t, j, instr(symbols, substr(own, j, 1)) - 1 as v, length(symbols) as a
  from owned, unnest(range(1, length(own) + 1)) as u(j)),
pairs as (select *, lag(v) over (partition by t order by j) as before from signs),
sums as (
  select t, any_value(a)::double as a, count(*)::double as n, sum(v)::double as total, sum(v * v)::double as square, coalesce(sum(v * before), 0)::double as next,
         sum(case when 2 * v >= a then 1 else 0 end)::double as upper, 1.0e0 + sum(case when before is not null and (2 * v >= a) <> (2 * before >= a) then 1 else 0 end) as runs,
         arg_min(v, j)::double as first, arg_max(v, j)::double as last
  from pairs group by t),
common as (select t, sum(c * c)::double as squares from (select t, v, count(*) as c from signs group by t, v) group by t),
parts as (
  select *, a * squares / n - n as chi, 2 * upper * (n - upper) / n + 1 as expected, square - total * total / n as varied, 2 * total - first - last as ends, total / n as mean
  from sums join common using (t)),
tests as (
  select t, n, a as symbols, sqrt(2 * greatest(chi, 0.0e0)) - sqrt(2 * a - 3) as uneven,
         case when (expected - 1) * (expected - 2) / (n - 1) > 0 then abs(runs - expected) / sqrt((expected - 1) * (expected - 2) / (n - 1)) else sqrt(n) end as runs,
         case when varied > 0 then abs((next - mean * ends + (n - 1) * mean * mean) / varied) * sqrt(n) else sqrt(n) end as serial
  from parts where n > 1),
scored as (
  select tested.*, symbols, cast(least(greatest(floor((uneven + (runs - {_HALF_MEAN}) / {_HALF_DEV} + (serial - {_HALF_MEAN}) / {_HALF_DEV}) / sqrt(3.0e0) * 4), -20), 80) as int) as score
  from (select *, (size >= 20)::int + (size >= 24)::int + (size >= 32)::int + (size >= 48)::int + (size >= 64)::int + (size >= 128)::int as size_class from tested) tested
  join tests using (t)),
bars as (
  select size_class, symbols, max(score) as bar from (
    select size_class, symbols, s.score,
           (select count(*) from scored o where o.size_class = s.size_class and o.symbols = s.symbols and o.decoy = 0 and o.score <= s.score) as met,
           (select count(*) from scored o where o.size_class = s.size_class and o.symbols = s.symbols and o.decoy > 0 and o.score <= s.score) as ordinary,
           (select count(*) from scored o where o.size_class = s.size_class and o.decoy = 0) as runs,
           (select count(*) from scored o where o.size_class = s.size_class and o.decoy > 0) as decoys
    from (select distinct size_class, symbols, score from scored) s)
  where met > 0 and (ordinary + 1) * 1.0e0 / (decoys + 1) * runs <= met * 0.05e0 and score <= 9 group by size_class, symbols),
base as (select r, kind, start, stop from placed where kind < 3 and counts),
found as (
  select * from base
  union all
  select p.r, 3, p.start, p.stop from placed p join scored s on s.r = p.r and s.i = p.i and s.decoy = 0 join bars using (size_class, symbols)
  where p.kind = 3 and s.score <= bar and not exists (select 1 from base b where b.r = p.r and b.start <= p.start and b.stop >= p.stop)),
listed as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_random,
         string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) as base,
         string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as spans
  from found group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_random, 0) as n_random,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (r)
"""
