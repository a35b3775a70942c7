"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import (
    best_fit_packing,
    chat_format,
    collocation,
    edit_fingerprint,
    language_id,
    line_dedup,
    quality_rules,
    secret_scan,
    simhash_dedup,
    source_mix,
    spelling,
    substring_dedup,
    url_filter,
)
from wayfold.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("component")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


def op4_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.linked(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=spelling.TYPO_EVERY))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.top(collocation.mined(table(spark, sf_dir, "documents")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_secret_scan, op3_best_fit_packing, op4_edit_fingerprint, op5_substring_dedup, op6_source_mix,
    op7_language_id, op8_simhash_dedup, op9_chat_format, op10_quality_rules,
    op11_spelling_variants, op12_collocations, op13_line_dedup)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _crc_table() -> list[int]:
    """The check sums of single bytes, by the rule of CRC-32 (reversed polynomial 0xEDB88320)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC = f"({_crc_table()}::bigint[])"

ORACLE = {
    "op5_substring_dedup": rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
win as (select r, p, list_aggregate(w[p:p + 34], 'string_agg', ' ') as s from d, unnest(range(1, greatest(len(w) - 33, 1))) as u(p)),
twice as (select s from win group by s having count(*) > 1),
gone as (select distinct r, p + k as i from win join twice using (s), unnest(range(0, 35)) as v(k)),
word as (select r, i, w[i] as x from d, unnest(range(1, len(w) + 1)) as u(i)),
kept as (select word.r, string_agg(x, ' ' order by i) as t from word anti join gone using (r, i) group by word.r),
cnt as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r) left join cnt using (r)""",
    "op10_quality_rules": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
ln as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
gram as (select r, p, w[p:p + 2] as g from d, unnest(range(1, greatest(len(w) - 1, 1))) as u(p)),
rep as (select r, p from gram qualify count(*) over (partition by r, g) > 1),
cov as (select r, count(distinct p + k)::bigint as n from rep, unnest(range(0, 3)) as v(k) group by r),
m as (select d.r, doc_id, len(w)::bigint as n_words, length(list_aggregate(w, 'string_agg', ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(ls) as n_lines,
  len(list_filter(w, lambda x: list_contains([{", ".join("'" + x + "'" for x in quality_rules.STOP_WORDS)}], lower(x)))) as n_stop_words
  from d join ln using (r) left join cov using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"{a}::double{f' / greatest({b}, 1)' if b else ''} between {lo} and {'1e308' if hi == float('inf') else hi}" for a, b, lo, hi in quality_rules.THRESHOLDS)} as kept
from f""",
    "op1_url_filter": r"""
with recursive p as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(h, q, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (select host, path, h || q as rule, verdict from (select distinct host, path from u) join rules
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
  qualify row_number() over (partition by host, path order by length(h || q) desc, verdict) = 1),
link as (select page_id, host || path as a, regexp_replace(regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '^[^:]*://', '') as b from u),
edge as (select a, b from link where b <> '' union select b, a from link where b <> ''),
reach(a, b) as (select a, a from edge union select reach.a, edge.b from reach join edge on reach.b = edge.a),
bad as (select distinct reach.a from reach join u on reach.b = u.host || u.path join fit using (host, path) where verdict = 'block')
select page_id, u.host, u.path, rule, coalesce(verdict, case when bad.a is not null then 'block' else 'allow' end) as verdict
from u left join fit using (host, path) left join bad on bad.a = u.host || u.path""",
    "op12_collocations": r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
ws as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
total as (select lang, sum(len(w))::bigint as n from ws group by lang),
gram as (select lang, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase, k, count(*) as f
  from ws, unnest(range(1, 6)) as a(k), unnest(range(1, len(w) - k + 2)) as b(i) group by all having f >= 100),
cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as v from gram where k > 1),
cut as (select c.lang, c.phrase, c.k, c.a, total.n, j, x.f as l, y.f as r, (1000::hugeint * c.a * total.n) // (x.f::hugeint * y.f) as score
  from cand c join total using (lang), unnest(range(1, c.k)) as u(j)
  join gram x on x.lang = c.lang and x.phrase = list_aggregate(c.v[1:j], 'string_agg', ' ') join gram y on y.lang = c.lang and y.phrase = list_aggregate(c.v[j + 1:], 'string_agg', ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, j) = 1),
inner_of as (select lang, list_aggregate(v[s:s + m - 1], 'string_agg', ' ') as phrase, max(a) as longer from cand, unnest(range(2, k)) as a(m), unnest(range(1, k - m + 2)) as b(s) group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score::bigint as score
from cut left join inner_of using (lang, phrase) where longer is null or 100 * longer < 100 * a qualify rank <= 2000""",
    "op13_line_dedup": r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
ln as (select r, doc_id, i, ls[i] as line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from d, unnest(range(1, len(ls) + 1)) as u(i)),
shared as (select k, max(doc_id) as last from ln where length(k) >= 40 group by k having count(distinct r) >= 5),
t as (select ln.*, shared.k is not null and doc_id is distinct from last as gone from ln left join shared using (k))
select doc_id, count(*) as n_lines, count_if(gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from t group by r, doc_id""",
    "op11_spelling_variants": rf"""
with runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents),
r as (select doc_id, w, count(*) as n, string_split(coalesce(doc_id::varchar, '') || ':' || w, '') as cs from runs group by doc_id, w),
b as (select w, n, flatten(list_transform(cs, lambda x: case when ord(x) < 128 then [ord(x)] else [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] end)) as bs from r),
h as (select w, n, xor(list_reduce([4294967295::bigint] || bs::bigint[], lambda c, y: xor(c >> 8, {_CRC}[(xor(c, y) & 255) + 1])), 4294967295::bigint) as h from b),
t as (select case when h % 97 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
d as (select word, sum(n)::bigint as n from t where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from d, unnest(range(1, length(word) + 1)) as u(i)),
near as (select distinct a.word, b.word as other, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, d.word, d.n from cut a join d on d.word = a.rest union select d.word, a.word, a.n from cut a join d on d.word = a.rest),
best as (select word, count(*) as n_near, arg_min(other, (-m, encode(other))) as other, max(m) as m from near group by word),
f as (select d.word, n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * n then other end as form, case when m >= 2 * n then m end as form_n from d left join best using (word)),
root as (with recursive up(word, x) as (select word, word from f union all select up.word, f.form from up join f on f.word = up.x where f.form is not null)
  select up.word, up.x as root from up join f on f.word = up.x where f.form is null)
select word, form, root, n, n_near, form_n from f join root using (word)""",
}
