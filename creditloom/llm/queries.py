"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from creditloom.llm.chats import chats_query
from creditloom.llm.decontaminate import contamination_query
from creditloom.llm.licenses import licence_query
from creditloom.llm.lines import lines_query
from creditloom.llm.near import near_query
from creditloom.llm.pack import pack
from creditloom.llm.periods import runs_query
from creditloom.llm.phrases import phrases
from creditloom.llm.quality import quality_query
from creditloom.llm.rules import BOILERPLATE, MENU, rules_query
from creditloom.llm.scratch import table
from creditloom.llm.substrings import dedup_query
from creditloom.llm.tokens import count_query
from creditloom.llm.urls import filter_urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return count_query(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op3_benchmark_decontamination",
    r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select coalesce(cast(item_id as varchar), '') as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (
  select item_id, least(10, len(w)) as k, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ')
         for i in range(1, greatest(1, len(w) - 9) + 1)]) as win from items where len(w) > 0),
doc_windows as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, unnest([array_to_string(w[j:j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) as win
  from docs, (select distinct k from item_windows) where len(w) >= k),
hits as (select d.doc_id, d.i, d.k, t.item_id from doc_windows d join item_windows t on d.k = t.k and d.win = t.win),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n, 0) as n_hit, coalesce(f.n, 0) as n_items,
       sha256(coalesce(f.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from docs d left join covered c on d.doc_id = c.doc_id left join found f on d.doc_id = f.doc_id""",
)
def op3_benchmark_decontamination(spark, sf_dir):
    return contamination_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op9_substring_dedup",
    r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (select doc_id, unnest(range(1, len(w) - 18)) as i, unnest([array_to_string(w[j:j + 19], ' ') for j in range(1, len(w) - 18)]) as win
         from docs where len(w) >= 20),
later as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as r from wins),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later where r > 1),
word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from docs),
kept as (select w.doc_id, string_agg(x, ' ' order by w.p) as t, count(*) as n from word w
         left join gone g on w.doc_id = g.doc_id and w.p = g.p where g.p is null group by w.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed,
       sha256(coalesce(k.t, '')) as kept_sha256
from docs d left join kept k on d.doc_id = k.doc_id""",
)
def op9_substring_dedup(spark, sf_dir):
    return dedup_query(table(spark, sf_dir, "documents"))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark, sf_dir):
    return near_query(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_quality_rules",
    r"""
with docs as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (
  select doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as v
  from (select doc_id, unnest(string_split(t, chr(10))) as x from docs) where regexp_matches(x, '[^\x20\x09-\x0D]')),
judged as (
  select doc_id, x, length(x) as size,
    length(x) - length(translate(x, '|>»•·', '')) >= 3
    or len(v) >= 4 and (length(x) - length(translate(x, '#*$%&|<>{}~^=_\', '')) > len(v) * cast(0.3 as double)
        or (length(x) - length(translate(x, '!?', ''))) * 2 >= len(v))
    or len(v) <= 10 and not regexp_matches(x, '[.!?…:;"'')\]][\x20\x09-\x0D]*$') and regexp_matches(lower(x), '^\W*({menu})\b')
    or regexp_matches(lower(x), '{boilerplate}')
    or len(v) >= 8 and len(list_distinct(v)) * 3 < len(v) as fails
  from lines),
line_figures as (select doc_id, count(*) - count(distinct x) as dup, sum(size) as total, sum(case when fails then size else 0 end) as lost
                 from judged group by doc_id),
wins as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest([array_to_string(w[j:j + 2], ' ') for j in range(1, len(w) - 1)]) as win
         from docs where len(w) >= 3),
twice as (select doc_id, i from wins qualify count(*) over (partition by doc_id, win) > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 3)) as p from twice) group by doc_id),
figures as (
  select d.doc_id, cast(len(w) as bigint) as n_words,
    cast(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
    coalesce(dup, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
    coalesce(cast(lost as double) / cast(total as double), 1.0) as lost_share
  from docs d left join line_figures l on d.doc_id = l.doc_id left join repeats r on d.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, cast(lost_share as double) as lost_share,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_share <= 0.5 as kept
from figures""".replace("{menu}", MENU).replace("{boilerplate}", BOILERPLATE),
)
def op4_quality_rules(spark, sf_dir):
    return rules_query(table(spark, sf_dir, "documents"))


@query("op8_license_scans")
def op8_license_scans(spark, sf_dir):
    return licence_query(table(spark, sf_dir, "documents"))


@query(
    "op10_url_filters",
    r"""
with recursive
p as (select page_id, coalesce(html, '') as html, url, case when position('://' in url) > 0 then url[position('://' in url) + 3:] end as rest,
        case when position('://' in url) > 1 then lower(url[:position('://' in url) - 1]) end as scheme from pages),
q as (select page_id, html, scheme, rest, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') as host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
n as (select *, scheme || '://' || host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as node from q),
tags as (
  select node, scheme, host, path, regexp_extract(t, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) as link from (select *, unnest(
    regexp_extract_all(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*>')) as t from n)
  union all
  select node, scheme, host, path, regexp_extract(t, '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) from (select *, unnest(
    regexp_extract_all(html, '(?is)<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>')) as t from n)),
targets as (
  select node, case when l = '' or starts_with(l, '#') then null when contains(l, '://') then l when starts_with(l, '//') then scheme || ':' || l
    when starts_with(l, '/') then scheme || '://' || host || l
    else scheme || '://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || l end as u
  from (select *, replace(trim(link), '&amp;', '&') as l from tags)),
edges as (
  select distinct node as a, lower(u[:position('://' in u) + 2]) || lower(regexp_extract(u[position('://' in u) + 3:], '^[^/?#]*'))
    || regexp_extract(u[position('://' in u) + 3:], '^[^/?#]*([^#]*)', 1) as b from targets where node is not null and u is not null),
both_ways as (select a, b from edges union select b, a from edges),
reach as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a),
seen as (select a, b, coalesce(regexp_extract(b, '://([^/?#]*)', 1), '') as host, coalesce(regexp_extract(b, '://[^/?#]*([^?#]*)', 1), '') as path from reach),
marks as (
  select a, case when ('.' || host like '%.example.net') and starts_with(path, '/en/') then 'allow'
      when ('.' || host like '%.example.com') and starts_with(path, '/de/') then 'block'
      when ('.' || host like '%.org') and starts_with(path, '/fr/') then 'allow'
      when ('.' || host like '%.net') and starts_with(path, '/') then 'block' end as v from seen),
alias as (select a, min(v) as v from marks group by a),
ruled as (
  select page_id, host, path, node, case when ('.' || host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
      when ('.' || host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
      when ('.' || host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
      when ('.' || host like '%.net') and starts_with(path, '/') then 'net/' end as rule from n)
select page_id, host, path, rule,
  coalesce(case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end, alias.v, 'allow') as verdict
from ruled left join alias on ruled.node = alias.a""",
)
def op10_url_filters(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query(
    "op1_line_dedup",
    r"""
with docs as (select doc_id, string_split(text, chr(10)) as x from documents),
lines as (
  select doc_id, i, list_sort(list_distinct(regexp_extract_all(c, '[^\x20\x09-\x0D]+'))) as s
  from (select doc_id, unnest(range(0, len(x))) as i, unnest(x) as c from docs)),
sets as (select s, min((doc_id, i)) as f, len(s) as n, row_number() over () as id from lines where len(s) > 0 group by s),
words as (select id, f, n, unnest(s) as w from sets),
pairs as (select b.id, a.n + b.n as total, count(*) as c from words a join words b on a.w = b.w and a.f < b.f
          and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 group by a.id, b.id, a.n + b.n),
alike as (select distinct id from pairs where c >= 0.8 * (total - c) - 1e-9),
gone as (select l.doc_id, l.i from lines l join sets s on l.s = s.s left join alike m on s.id = m.id where (l.doc_id, l.i) > s.f or m.id is not null),
per_doc as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as removed from gone group by doc_id)
select d.doc_id, coalesce(cast(len(d.x) as bigint), 0) as n_lines, coalesce(p.n, 0) as n_removed, coalesce(p.removed, '') as removed_lines
from docs d left join per_doc p on d.doc_id = p.doc_id""",
)
def op1_line_dedup(spark, sf_dir):
    return lines_query(table(spark, sf_dir, "documents"))


@query(
    "op11_chat_formatting",
    r"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns as (select *, coalesce(role, '') as r, coalesce(text, '') as t from rows),
escaped as (
  select *, replace(r, '\', '\\') as r1, replace(t, '\', '\\') as t1 from turns),
sized as (
  select *, length(r1) + length(t1) + length('<|turn|><|text|><|end|>')
    + (select sum((length(r1) - length(replace(r1, c, '')) + length(t1) - length(replace(t1, c, ''))) // length(c)) from
       (select unnest(['<|turn|>', '<|text|>', '<|end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|im_start|>',
        '<|im_end|>', '<|endoftext|>', '<|eot_id|>']) as c)) as chars
  from escaped)
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, role nulls first, text nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
""",
)
def op11_chat_formatting(spark, sf_dir):
    return chats_query(table(spark, sf_dir, "conversations"))


@query(
    "op12_phrase_collocations",
    r"""
with words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
counted as (
  select lang, k, phrase, count(*) as f from (
    select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase
    from words, (select unnest(range(1, 6)) as k) where len(w) >= k)
  group by all having k = 1 or count(*) >= 100),
totals as (select lang, sum(f)::hugeint as n from counted where k = 1 group by lang),
longer as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counted where k > 1),
inside as (
  select lang, part, max(a) as most from (
    select lang, a, array_to_string(w[:k - 1], ' ') as part from longer where k > 2
    union all select lang, a, array_to_string(w[2:], ' ') from longer where k > 2)
  group by all),
cuts as (
  select l.lang, l.phrase, l.a, l.c, x.f as l, y.f as r, (1000 * l.a::hugeint * n) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, k)) as c from longer) l
  join counted x on x.lang = l.lang and x.phrase = array_to_string(l.w[:l.c], ' ')
  join counted y on y.lang = l.lang and y.phrase = array_to_string(l.w[l.c + 1:], ' ')
  join totals t on t.lang = l.lang),
best as (select *, row_number() over (partition by lang, phrase order by score, c) as place from cuts),
ranked as (
  select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
  from best b left join inside i on i.lang = b.lang and i.part = b.phrase
  where place = 1 and (i.most is null or i.most < b.a))
select r.lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked r join totals t on t.lang = r.lang where rank <= 2000
""",
)
def op12_phrase_collocations(spark, sf_dir):
    return phrases(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return runs_query(table(spark, sf_dir, "documents"))
