"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LINES = r"""
lines as (
  select r, doc_id, generate_subscripts(l, 1) as place, unnest(l) as line
  from (select r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from docs)
),
keyed as (
  select *, regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as key
  from lines
),
owners as (
  select key, min(doc_id) as owner from keyed where length(key) >= 10
  group by key having count(distinct doc_id) >= 2
),
kept as (
  select r, any_value(k.doc_id) as doc_id, count(*) as n_lines,
    count(*) filter (owner is not null and owner <> k.doc_id) as n_dropped,
    coalesce(string_agg(line, chr(10) order by place)
      filter (owner is null or owner = k.doc_id), '') as kept_text
  from keyed k left join owners o on o.key = k.key and length(k.key) >= 10
  group by r
)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w
  from documents
),
grams as (
  select r, unnest(range(1, len(w) - 1)) as p,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g
  from docs where len(w) >= 3
),
twice as (select r, p from grams qualify count(*) over (partition by r, g) >= 2),
repeated as (
  select r, count(distinct p + o) as n from twice, (values (0), (1), (2)) as offsets(o) group by r
),
lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
worded as (select * from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts as (select r, count(*) as n, count(*) - count(distinct line) as dup from worded group by r),
counts as (
  select d.r, doc_id, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dup, 0)::bigint as n_dup_lines,
    coalesce(repeated.n, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in (
      'the','of','and','to','in','is','that','for','with','was','on','as','are','be','this','by',
      'it','from','at','or','an','der','die','und','den','das','ist','nicht','von','mit','ein',
      'eine','im','zu','des','auf','für','le','la','les','de','et','en','un','une','que','qui',
      'dans','pour','est','sur','par','du','au','el','los','las','y','del','se','una','con','por',
      'para','su','al','como','es')))::bigint as n_stop_words,
    coalesce(line_counts.n, 0)::bigint as n_lines
  from docs d left join repeated using (r) left join line_counts using (r)
),
based as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
    and (n_words = 0 or (word_chars between 2.0 * n_words and 20.0 * n_words
      and n_symbols <= 0.30 * n_words
      and n_stop_words between 0.03 * n_words and n_words))
    and (n_lines = 0 or n_dup_lines <= 0.50 * n_lines) as kept,
  n_stop_words, n_lines
from based
""",
    "op10_line_dedup": rf"""
with docs as (select row_number() over () as r, doc_id, text from documents),
{_LINES}
select doc_id, n_lines, n_dropped, sha256(kept_text) as kept_sha256 from kept
""",
    "op11_substring_dedup": rf"""
with docs as (
  select row_number() over () as r, doc_id, {_WORDS} as w from documents
),
windows as (
  select r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as g
  from (select *, unnest(range(1, len(w) - 48)) as p from docs where len(w) >= 50)
),
owned as (select r, doc_id, p, min(doc_id) over (partition by g) as owner from windows),
covered as (
  select r, list(distinct p + o) as gone
  from owned, range(50) as offsets(o) where owner < doc_id or owner is not null and doc_id is null group by r
),
marked as (
  select d.r, doc_id, len(w) as n_words, generate_subscripts(w, 1) as p, unnest(w) as word, gone
  from docs d left join covered using (r)
),
kept as (
  select m.r, string_agg(word, ' ' order by p) as kept_text, count(*) as n_kept
  from (select r, p, word from marked where gone is null
    union all
    select m.r, m.p, word from marked m
    where gone is not null and not list_contains(gone, p)) m
  group by m.r
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n_kept, 0))::bigint as n_removed,
  sha256(coalesce(kept_text, '')) as kept_sha256
from docs left join kept using (r)
""",
    "op12_hard_negatives": """
with parts as (
  select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i
  from embeddings where label is not null
),
used as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list(floor(256 * x) order by i) as q
  from parts group by vec_id, label having bool_and(coalesce(isfinite(x), false))
),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_dot_product(a.q, b.q)::bigint as score
  from used a join used b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
),
negatives as (
  select p.*, other_id as negative_id, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as rank
  from positives p join scored s on p.anchor_id = s.anchor_id and not same
    and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
from negatives where rank <= 3
""",
    "op13_prefix_trie": """
with bits as (
  select conv_id, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) as crc
  from (select distinct conv_id from conversations where conv_id is not null)
),
own as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    order by turn nulls first, role, text) as turns
  from conversations where conv_id is not null group by conv_id
),
rebuilt as (
  select o.conv_id, coalesce(b.turns, [])[1:h] || o.turns[h + 1:] as turns
  from own o join (select conv_id, xor(crc, 4294967295) % 9 as h from bits) using (conv_id)
    left join own b on b.conv_id = o.conv_id - o.conv_id % 5
),
members as (
  select conv_id, len(turns) as length, unnest(range(0, len(turns) + 1)) as depth, turns from rebuilt
),
placed as (
  select conv_id, length, depth, turns[1:depth] as prefix, turns[depth].text as text from members
),
nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
    (count(*) - 1) * coalesce(strlen(any_value(text)), 0) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth), '')) as ends_sha256
  from placed group by prefix, depth
),
children as (
  select prefix[1:depth - 1] as prefix, depth - 1 as depth, count(*) as n_children
  from nodes where depth > 0 group by 1, 2
),
counted as (
  select n.*, coalesce(n_children, 0) as n_children
  from nodes n left join children c on c.prefix = n.prefix and c.depth = n.depth
),
above as (
  select saved, n_children, prefix[1:up] as prefix, up as depth
  from (select *, unnest(range(0, depth + 1)) as up from counted)
),
sums as (
  select prefix, depth, sum(saved)::bigint as saved_tokens,
    count(*) filter (n_children = 0) as n_leaves
  from above group by prefix, depth
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
from counted c join sums s on s.prefix = c.prefix and s.depth = c.depth
  left join nodes p on p.depth = c.depth - 1 and p.prefix = c.prefix[1:c.depth - 1]
""",
}
