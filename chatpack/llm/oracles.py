"""DuckDB SQL for the queries of this subpackage that SQL can express.

Queries whose results come from a compressor, a language model, trees or fingerprints have none;
tests/llm compares those with brute force. Of four of them the columns that the fixed rules give are queries
of their own, so that SQL checks them over whole tables.
"""

from __future__ import annotations

#: Slots go one by one: of the released blocks the one with the earliest deadline, ties by source.
MIXING = """
with recursive sized as (
  select s, n, cast(floor(sqrt(n) * 1024) as hugeint) as w, cast(ceil(n / 64.0) as bigint) as b
  from (select coalesce(source, '(none)') as s, count(*) as n from documents group by 1)
), every as (
  select list({'s': s, 'w': w, 'b': b} order by s) as l, cast(sum(w) as hugeint) as total from sized
), run as (
  select 0::bigint as now, list_transform(l, lambda x: 0::bigint) as nxt, 0::bigint as pick, 0::bigint as block, 0::bigint as slot from every
  union all
  select case when c is null then least_release else now + 1 end,
    list_transform(nxt, lambda v, k: case when k = c.k then v + 1 else v end), coalesce(c.k, 0), case when c is null then 0 else nxt[c.k] end, now
  from (
    select now, nxt, list_min(list_transform(open, lambda x: x.r)) as least_release, list_min(list_filter(open, lambda x: x.r <= now)) as c
    from (
      select now, nxt, list_filter(list_transform(l, lambda x, k: {'d': ((nxt[k] + 1) * total + x.w - 1) // x.w, 's': x.s, 'k': k, 'r': cast(nxt[k] * total // x.w as bigint), 'more': nxt[k] < x.b}), lambda x: x.more) as open
      from run, every
    ) where len(open) > 0
  )
), plan as (
  select l[pick].s as s, block, slot, cast(block * total // l[pick].w as bigint) as release, cast(((block + 1) * total + l[pick].w - 1) // l[pick].w as bigint) as deadline
  from run, every where pick > 0
), ranked as (
  select doc_id, source, coalesce(source, '(none)') as s, row_number() over (partition by coalesce(source, '(none)') order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as k
  from documents
)
select r.doc_id, r.source, r.k // 64 as block, r.k % 64 as place, p.slot, p.release, p.deadline
from ranked r join plan p on p.s = r.s and p.block = r.k // 64
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SECRET_COUNTS = r"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:(?i)(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12)) as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 18)) as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 16)) as n_hex
from documents
"""

URL_RULES = r"""
with cut as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(url[instr(url, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(url[instr(url, '://') + 3:], '(?s)^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), rules as (
  select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, rule_host, rule_path)
)
select page_id, host, path, arg_max(rule_host || rule_path, len(rule_host || rule_path)) as rule, arg_max(verdict, len(rule_host || rule_path)) as rule_verdict
from cut left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
group by page_id, host, path
"""

LICENSE_PLACES = rf"""
with w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), found as (
  select doc_id, words, list_filter(range(len(words)), lambda k: words[k + 1 : k + 4] = ['under', 'the', 'mit', 'license']) as mit,
    list_filter(range(len(words)), lambda k: words[k + 1 : k + 4] = ['apache', 'license', 'version', '2']) as apache,
    list_filter(range(len(words)), lambda k: words[k + 1 : k + 3] = ['cc', 'by', 'nc']) as cc
  from w
)
select doc_id, len(words) as n_words, len(mit) + len(apache) + len(cc) as n_base,
  list_min(list_concat(mit, apache, cc)) as first_word, list_max(list_concat(mit, apache, cc)) as last_word,
  concat_ws(',', case when len(apache) > 0 then 'apache-2' end, case when len(cc) > 0 then 'cc-by-nc' end, case when len(mit) > 0 then 'mit' end) as base_labels
from found
"""

QUALITY_COUNTS = r"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select r, k, list_slice(words, k, k + 4) as five from (select r, words, unnest(range(1, len(words) - 3)) as k from w)
), again as (
  select r, k from (select r, k, count(*) over (partition by r, five) as n from windows) where n > 1
), covered as (
  select r, count(distinct k + j) as n_repeat_words from again, range(0, 5) t(j) group by r
), lines as (
  select r, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
), counts as (
  select r, doc_id, len(words) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: len(x))), 0) as bigint) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols from w
)
select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed
from counts left join lines using (r) left join covered using (r)
"""

SUFFIXES = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), parts as (
  select doc_id, 500 * p as base, substr(h, 1000 * p + 1, 1198) as part from (select doc_id, h, unnest(range(length(h) // 1000 + 1)) as p from d)
), strings as (
  select doc_id, base + i as s, md5(substr(part, 2 * i + 1, 200)) as own from (select doc_id, base, part, unnest(range(length(part) // 2 - 99)) as i from parts)
), later as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by own order by doc_id, s) as k from strings) where k > 1
), numbered as (
  select doc_id, s, sum(case when s <= before + 100 then 0 else 1 end) over (partition by doc_id order by s) as run
  from (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from later)
), runs as (
  select doc_id, min(s) as a, max(s) + 100 as b, lag(max(s) + 100, 1, 0) over (partition by doc_id order by min(s)) as before from numbered group by doc_id, run
), cut as (
  select doc_id, count(*) as n_spans, cast(sum(b - a) as bigint) as n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
  from runs join d using (doc_id) group by doc_id
)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut using (doc_id)
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = rf"""
with t as (
  select r, doc_id, unnest({_TERMS}) as term from (select row_number() over () as r, doc_id, text from documents)
), sizes as (
  select r, doc_id, count(*) as n from t group by r, doc_id
), total as (
  select count(*) as docs, cast(sum(n) as bigint) as length from sizes
), q as (
  select i, item_id, term, count(*) as times
  from (select i, item_id, unnest({_TERMS}) as term from (select row_number() over () as i, item_id, text from benchmark)) group by i, item_id, term
), tf as (
  select r, term, count(*) as tf from t where term in (select term from q) group by r, term
), w as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term, docs
), scores as (
  select i, item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) as bigint) as score
  from q join tf using (term) join w using (term) join sizes using (r), total group by i, item_id, r, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10
"""

#: crc32 goes byte by byte over a table of 256 steps; near words share what is left when a letter is taken out.
SPELLING = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps
), runs as (
  select coalesce(cast(doc_id as varchar), '') as id, run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 7 group by all
), coded as (
  select run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(b) // 2), lambda k: cast('0x' || substr(b, 2 * k + 1, 2) as bigint))),
    lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) as h
  from (select run, times, hex(encode(id || ':' || run)) as b from runs), crc
), words as (
  select word, cast(sum(times) as bigint) as n
  from (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from coded)
  where length(word) >= 7 group by word having sum(times) >= 2
), cut as (
  select word, n, k, left(word, k) as head, substr(word, k + 2) as tail from (select word, n, unnest(range(length(word))) as k from words)
), near as (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.head = b.head and a.tail = b.tail and a.k = b.k and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.head || a.tail = b.word
  union select b.word, a.word, a.n from cut a join words b on a.head || a.tail = b.word
), best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as form, max(other_n) as form_n from near group by word
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * n then form end as form, case when form_n >= 10 * n then form_n end as form_n from words w left join best using (word)
), walk as (
  select word, word as root from forms union all select walk.word, forms.form from walk join forms on forms.word = walk.root where forms.form is not null
)
select word, form, last_root as root, n, n_near, form_n
from forms join (select walk.word, walk.root as last_root from walk join forms on forms.word = walk.root where forms.form is null) using (word)
"""

ORACLE_SQL = {
    "op2_mixing": MIXING,
    "op11_suffixes": SUFFIXES,
    "op12_ranked": RANKED,
    "op13_spelling": SPELLING,
    "secret_counts": SECRET_COUNTS,
    "url_rules": URL_RULES,
    "license_places": LICENSE_PLACES,
    "quality_counts": QUALITY_COUNTS,
}
