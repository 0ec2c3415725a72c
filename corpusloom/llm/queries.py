"""The queries opN_<name> over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers

from . import decontaminate, hammingjoin, linededup, lmscore, nearjoin, packing, prefixtrie, quality, substrings, suffixes, tokens, urlfilter, whitening
from .storage import table

TOKENIZER = "word_bpe_49k.json"


def op1_lm_scoring(spark, sf_dir):
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    return urlfilter.url_report(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    return suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op5_token_counts(spark, sf_dir):
    return tokens.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_line_dedup(spark, sf_dir):
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_substring_dedup(spark, sf_dir):
    return substrings.drop_repeated_windows(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op9_jaccard_join(spark, sf_dir):
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark, sf_dir):
    return prefixtrie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_hamming_join(spark, sf_dir):
    return hammingjoin.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_url_filters, op3_quality_rules, op4_suffix_dedup, op5_token_counts, op6_line_dedup, op7_packing, op8_substring_dedup, op9_jaccard_join, op10_decontamination, op11_whitening, op12_prefix_trie, op13_hamming_join)}

_WORDS = "list_filter(string_split(translate({t}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '')"
_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
with d as (select doc_id, {_WORDS.format(t="coalesce(text, '')")} as ws from documents),
w as (select doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d where len(ws) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as k from w) where k > 1),
g as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(i, i + 20)) as p from r) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string(case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
from d left join g using (doc_id)"""


def _near_sql(k: int, percent: int, more: str = "") -> str:
    """Documents linked by shingles of k words at a similarity of `percent`; more: further columns, from doc_id and m."""
    return f"""
with recursive d as (select doc_id, {_WORDS.format(t=_LOWER.format(t="text"))} as ws from documents),
s as materialized (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < {k} then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(list_slice(ws, i, i + {k - 1}), ' ')) end) as xs from d),
e as (select doc_id, len(xs) as n, unnest(xs) as x from s),
p as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
u as materialized (select a, b from p union select b, a from p),
r(doc_id, c) as (select a, a from u union select u.b, r.c from r join u on r.doc_id = u.a where r.c < u.b)
select doc_id, len(xs)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id{more}
from s left join (select doc_id, min(c) as m from r group by doc_id) using (doc_id)"""


OP9_SQL = _near_sql(5, 75)
OP13_SQL = _near_sql(4, 80, ", doc_id <= coalesce(m, doc_id) as kept")

_ALNUM = "regexp_extract_all({t}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
HITS_SQL = f"""
dw as (select doc_id, {_ALNUM.format(t=_LOWER.format(t="text"))} as ws from {{docs}}),
iw as (select item_id, {_ALNUM.format(t=_LOWER.format(t="text"))} as ws from benchmark),
win as (select distinct item_id, least(10, len(ws)) as k, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') as x
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from iw where len(ws) > 0)),
ks as (select distinct k from win),
occ as (select doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') as x from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from dw, ks where len(ws) >= k)),
hit as (select doc_id, k, i, item_id from occ join win using (k, x)),
cov as (select doc_id, count(distinct p)::bigint as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
its as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)"""
OP10_SQL = (
    "with "
    + HITS_SQL.format(docs="documents")
    + """ select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated from dw left join cov using (doc_id) left join its using (doc_id)"""
)

OP12_SQL = r"""
with ct as (select list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
h as (select c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1])), 4294967295) % 4 as h
  from (select distinct conv_id as c from conversations where conv_id is not null), ct),
own as (select conv_id as c, list({'r': role, 'x': txt} order by turn nulls first, md5(length(role) || ':' || role || txt)) as s
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null) group by conv_id),
b as (select o.c, coalesce(list_slice(f.s, 1, h.h), []) || coalesce(list_slice(o.s, h.h + 1, len(o.s)), []) as s from own o join h using (c) left join own f on f.c = o.c - o.c % 20),
p as (select c, d, list_slice(s, 1, d) as pre, d = len(s) as is_end from (select c, s, unnest(range(0, len(s) + 1)) as d from b)),
n as (select pre, d, min(c) as conv_id, count(*) as n_convs, string_agg(c::varchar, ',' order by c) filter (is_end) as ends,
  case when d = 0 then 0 else len(list_filter(string_split(translate(pre[d].x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda w: w <> '')) end as words from p group by pre, d),
k as (select n.*, q.conv_id as parent_conv_id, coalesce(m, 0) as n_children from n left join n q on q.d = n.d - 1 and q.pre = list_slice(n.pre, 1, n.d - 1)
  left join (select list_slice(pre, 1, d - 1) as pre, d - 1 as d, count(*) as m from n where d > 0 group by all) x on x.d = n.d and x.pre = n.pre),
a as (select list_slice(pre, 1, i) as pre, i as d, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * words) as saved from (select *, unnest(range(0, d + 1)) as i from k) group by all)
select conv_id, k.d::bigint as depth, parent_conv_id, n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from k join a on a.d = k.d and a.pre = k.pre"""

ORACLES = {
    "op13_hamming_join": OP13_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op2_url_filters": urlfilter.REPORT_SQL,
    "op3_quality_rules": quality.REPORT_SQL,
    "op6_line_dedup": linededup.REPORT_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_decontamination": OP10_SQL,
}
