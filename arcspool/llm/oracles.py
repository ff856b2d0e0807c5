"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from arcspool.llm import quality_rules as qr


def op7(rules: tuple[qr.Rule, ...] = qr.RULES) -> str:
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(qr.STOP_WORDS))
    by = {
        "words": "n_words",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0)::double, 0)",
        "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0)::double, 0)",
        "stop_word_share": "coalesce(n_stop_words / nullif(n_words, 0)::double, 0)",
        "dup_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0)",
        "words_per_line": "coalesce(n_words / nullif(n_lines, 0)::double, 0)",
    }
    holds = [f"{by[r.measure]} >= {r.low}" for r in rules if r.low is not None] + [f"{by[r.measure]} <= {r.high}" for r in rules if r.high is not None]
    return rf"""
with w as (select row_number() over () as rid, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select rid, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8),
keyed as (select rid, i, array_to_string(ws[i:i+7], ' ') as k from win),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from keyed) where c > 1),
cover as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from again) group by rid),
m as (select w.rid, doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
    cast(len(list_filter(ws, lambda x: x in ({stop}))) as bigint) as n_stop_words,
    cast(coalesce(cover.n, 0) as bigint) as n_repeat_words
  from w left join cover using (rid)),
f as (select *, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
    (not base_failed and {' and '.join(holds)}) as kept from f"""


OP6 = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
    doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from t"""


def op5(period: int = 1000, block_docs: int = 16) -> str:
    return f"""
with recursive c as (select source, count(*) as n from documents group by source),
r as (select source, cast(floor(sqrt(n) * 1000000) as bigint) as r from c),
t as (select source, r, sum(r) over ()::bigint as total, {period} - count(*) over () as free from r),
q as (select source, 1 + (r * free) // total as q, (r * free) % total as rem from t),
p as (select source, cast(q + (row_number() over (order by rem desc, source nulls first) <= {period} - sum(q) over ())::int as bigint) as parts from q),
arr as (select list(parts order by source nulls first) as ms, list(source order by source nulls first) as ss from p),
s as (
    select 0::bigint as t, list_transform(ms, lambda x: 0::bigint) as alloc, null::bigint as chosen, null::bigint as k from arr
  union all
    select t + 1, list_transform(alloc, lambda a, i: a + (i = pick)::bigint), pick, alloc[pick]
    from (select t, alloc, list_position(ks, list_min(ks))::bigint as pick from (
        select t, alloc, list_transform(alloc, lambda a, i: case when a < ms[i] and (a * {period}) // ms[i] <= t
            then (((a + 1) * {period} + ms[i] - 1) // ms[i]) * 100000 + i else 1000000000000000 end) as ks from s, arr) where t < {period})),
slots as (select ss[chosen] as source, k, t - 1 as turn from s, arr where chosen is not null),
d as (select doc_id, source, row_number() over (partition by source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as nth from documents),
b as (select doc_id, source, nth // {block_docs} as block, nth % {block_docs} as place from d)
select b.doc_id, b.source, parts, cast(block as bigint) as block, cast(place as bigint) as place,
    cast((block * {period}) // parts as bigint) as release, cast(((block + 1) * {period} + parts - 1) // parts as bigint) as due,
    cast((block // parts) * {period} + turn as bigint) as slot
from b join p on b.source is not distinct from p.source
join slots on b.source is not distinct from slots.source and b.block % parts = slots.k"""
