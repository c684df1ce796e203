"""The registered queries of the numbered operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from crowdlake.llm import collocations, licenses, mixing, pii, piece_scan, quality, sharding, simhash, token_counts, topk, toxicity, url_filter, whitening
from crowdlake.llm.common import table

#: The vocabulary of the token queries, in a package that is installed wherever tasks run.
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- 4: quality rules

ORACLES["op4_quality_rules"] = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
grams as (select r, i, words[i:i+4] as g from (select r, words, unnest(range(1, len(words) - 3)) as i from w)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
covered as (select r, count(distinct i + k) as n from (select r, i, unnest(range(0, 5)) as k from twice) group by r),
m as (select w.*, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from w left join covered using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
    not (base_failed or 10 * n_symbols > n_words or 5 * n_dup_lines > 2 * len(string_split(t, chr(10)))
    or word_chars < 2 * n_words or word_chars > 14 * n_words
    or 10 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > 6 * greatest(length(t) - length(regexp_replace(t, '\p{L}', '', 'g')), 1)
    or 2 * (length(t) - length(replace(t, '!', ''))) > n_words
    or 2 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > greatest(word_chars, 1)) as kept from b
"""


@query
def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


# ---------------------------------------------------------------- 6: mixing

ORACLES["op6_mixing"] = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as o from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1e0 as w
    from d group by source),
c as (select *, 3e0 * source_size as cap, 3e0 * source_size / w as ratio from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0e0))
    / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as level from c),
t as (select source, source_size, least(cap, coalesce((select max(level) from l where ratio > level) * w, cap)) as target from l),
v as (select d.*, source_size, target, sum(size) over (partition by d.source order by o, size rows unbounded preceding) as served
    from d join t on d.source is not distinct from t.source),
f as (select doc_id, o, size, source_size, target, row_number() over () as r, served from v),
e as (select f.*, case when target > 0 then cast(source_size * e + served as double) / target else e end as finish from f, unnest(range(0, 3)) as u(e)),
k as (select finish, sum(size) over (order by finish) as total from e),
x as (select max(finish) as cut from k where total <= (select sum(size) from d))
select doc_id, cast(any_value(size) as bigint) as size, any_value(source_size) as source_size, any_value(target) as target,
    cast(sum(case when finish <= cut then size else 0 end) as bigint) as taken from e, x group by r, doc_id
"""


@query
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


# ---------------------------------------------------------------- 10: URL filters

#: The rules that the query applies.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

ORACLES["op10_url_filters"] = r"""
with rules(action, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p as (select row_number() over () as r, page_id,
    case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select r, page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from p),
u as (select r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
m as (select u.r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) as rule,
    arg_max(action, length(rules.host || rules.path)) as action
    from u join rules on (u.host = rules.host or ends_with(u.host, '.' || rules.host)) and starts_with(u.path, rules.path) group by u.r)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from u left join m using (r)
"""


@query
def op10_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


# ---------------------------------------------------------------- 5: exact top-k search

ORACLES["op5_exact_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query
def op5_exact_top_k(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# ---------------------------------------------------------------- 8: SimHash near-duplicates


@query
def op8_simhash_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    printed = simhash.with_fingerprint(docs).select("doc_id", "fingerprint")
    return simhash.grouped(printed)


# ---------------------------------------------------------------- 3: piece encoding and decoding


@query
def op3_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = piece_scan.decode(piece_scan.encode(docs, VOCABULARY), VOCABULARY)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    return both.select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", same.alias("round_trip"))


# ---------------------------------------------------------------- 7: token counts


@query
def op7_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, VOCABULARY).select("doc_id", "n_bytes", "n_tokens", "over_limit")


# ---------------------------------------------------------------- 1: toxicity


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


# ---------------------------------------------------------------- 2: personal data


@query
def op2_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.annotated(docs, pii.fit(docs)).select("doc_id", *pii.ADDED)


# ---------------------------------------------------------------- 9: license scans


@query
def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- 11: whitening of embeddings


@query
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# ---------------------------------------------------------------- 12: collocations

ORACLES["op12_collocations"] = r"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
    from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (select lang, k, w[i:i+k-1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
    from (select lang, w, unnest(range(1, 6)) as k from p))),
f as materialized (select lang, k, g, count(*) as f from g group by all having count(*) >= 100),
n as (select lang, sum(len(w)) as n from p group by lang),
cuts as (select f.lang, f.k, f.g, f.f as a, c, n.n, x.f as l, y.f as r,
    (1000::hugeint * f.f::hugeint * n.n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
    from (select *, unnest(range(1, k)) as c from f where k > 1) f join n using (lang)
    join f x on x.lang = f.lang and x.k = c and x.g = f.g[1:c] join f y on y.lang = f.lang and y.k = f.k - c and y.g = f.g[c+1:]),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, c) = 1),
inner_ as (select distinct lang, g[i:j] as g, f from (select *, unnest(range(i + 1, k + 1)) as j
    from (select *, unnest(range(1, k)) as i from f where k > 2)) where j - i + 1 < k),
kept as (select b.* from best b where not exists (select 1 from inner_ i where i.lang = b.lang and i.g = b.g and i.f >= b.a)),
ranked as (select *, array_to_string(g, ' ') as phrase,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
    cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""


@query
def op12_collocations(spark, sf_dir):
    return collocations.mined(table(spark, sf_dir, "documents").select("lang", "text"))


# ---------------------------------------------------------------- 13: sharding

ORACLES["op13_sharding"] = r"""
with recursive bits(i, k, c) as (select i::ubigint, 0, i::ubigint from range(256) t(i)
    union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where k < 8),
tbl as (select list(c order by i) as t from bits where k = 8),
d as (select row_number() over () as row, doc_id, encode(coalesce(text, '')) as t, text from documents),
b as (select row, doc_id, (octet_length(t) + 1)::bigint as size, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::ubigint) as bytes from d),
c as (select row, doc_id, size, xor(list_reduce(list_prepend(4294967295::ubigint, bytes),
    lambda a, x: xor(a >> 8, tbl.t[(xor(a, x) & 255)::int + 1])), 4294967295::ubigint)::bigint as crc from b, tbl),
h as (select *, md5(coalesce(doc_id::varchar, 'text ' || crc::varchar)) as key from c),
v as (select *, ('0x' || key[1:3])::int as v from h),
s as (select v, coalesce(sum(size), 0)::bigint as bytes, count(size) as n from range(4096) r(v) left join v using (v) group by v),
o as (select *, row_number() over (order by bytes desc, v) as k from s),
deal(k, v, shard, loads) as (
    select 0::bigint, -1::bigint, -1::bigint, list_transform(range(16), lambda x: 0::bigint)
    union all
    select o.k, o.v, e.e - 1, list_transform(deal.loads, lambda x, i: case when i = e.e then x + o.bytes else x end)
    from deal join o on o.k = deal.k + 1, lateral (select list_position(deal.loads, list_min(deal.loads))::bigint as e) e),
m as (select deal.v, shard, coalesce(sum(n) over (partition by shard order by deal.v rows between unbounded preceding and 1 preceding), 0) as start
    from deal join s on s.v = deal.v)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard::int as shard,
    (start + row_number() over (partition by v order by key, size, crc, row) - 1)::bigint as slot, cast(null as int) as grown_shard
from v join m using (v)
"""


@query
def op13_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(docs, keep_text=False).drop("virtual_slot")
