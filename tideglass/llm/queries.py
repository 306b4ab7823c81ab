"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import binary, decontaminate, langid, licenses, mixing, near_dedup, rewrite, sharding, tokencount, topk, toxicity, variants, warc
from tideglass.llm.shared import crc_mod, drop, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op5_minhash_near_dedup"] = op5_minhash_near_dedup
ORACLE_SQL["op5_minhash_near_dedup"] = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh
  from w
), e as materialized (select doc_id, len(sh) as n, unnest(sh) as x from s),
common as materialized (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links as materialized (select a, b from common union all select b, a from common),
reach(doc_id, r) as (
  select a, a from links union select reach.doc_id, links.b from reach join links on links.a = reach.r
), comp as (select doc_id, min(r) as c from reach group by doc_id)
select s.doc_id, len(sh)::bigint as n_shingles, coalesce(c, s.doc_id) as component_id, coalesce(c, s.doc_id) = s.doc_id as kept
from s left join comp on comp.doc_id = s.doc_id
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES["op1_toxicity"] = op1_toxicity


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op8_benchmark_decontamination"] = op8_benchmark_decontamination
ORACLE_SQL["op8_benchmark_decontamination"] = rf"""
with d as materialized (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), i as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), iw as materialized (
  select distinct item_id, case when len(ws) < 10 then len(ws) else 10 end as n, array_to_string(ws[k:k+9], ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as k from i where len(ws) > 0)
), dw as (
  select doc_id, l.n, k, array_to_string(ws[k:k+l.n-1], ' ') as win
  from (select distinct n from iw) l, lateral (select doc_id, ws, unnest(range(1, len(ws) - l.n + 2)) as k from d where len(ws) >= l.n)
), occ as materialized (select doc_id, item_id, k, iw.n from dw join iw on iw.win = dw.win and iw.n = dw.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from occ) group by doc_id),
it as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from occ) group by doc_id
)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


def op8_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op8_longest_matches"] = op8_longest_matches
ORACLE_SQL["op8_longest_matches"] = rf"""
with d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), i as (
  select item_id::varchar as item_id, md5(coalesce(text, '')) as h, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from (select distinct item_id, text from benchmark)
), iw as materialized (
  select item_id, h, k - 1 as item_at, case when len(ws) < 10 then len(ws) else 10 end as n, array_to_string(ws[k:k+9], ' ') as win
  from (select item_id, h, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as k from i where len(ws) > 0)
), dw as (
  select r, doc_id, l.n, k - 1 as place, array_to_string(ws[k:k+l.n-1], ' ') as win
  from (select distinct n from iw) l, lateral (select r, doc_id, ws, unnest(range(1, len(ws) - l.n + 2)) as k from d where len(ws) >= l.n)
), occ as (
  select item_id, h, item_at, iw.n, r, doc_id, place,
    item_at - row_number() over (partition by item_id, h, r, item_at - place order by item_at) as run
  from dw join iw on iw.win = dw.win and iw.n = dw.n
), m as (
  select *, n + max(item_at) over (partition by item_id, h, r, item_at - place, run) - item_at as n_words from occ
), b as (
  select *, row_number() over (partition by item_id, h, item_at order by n_words desc, doc_id nulls last, place) as k,
    count(*) over (partition by item_id, h, item_at) as n_found from m
)
select item_id, h as item_md5, item_at::bigint as item_at, n_words::bigint as n_words, doc_id, place::bigint as doc_at, n_found::bigint as n_found
from b where k = 1
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES["op9_language_id"] = op9_language_id


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES["op10_token_binary"] = op10_token_binary


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"))


QUERIES["op2_hash_tree_sharding"] = op2_hash_tree_sharding


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op3_pivotal_mixing"] = op3_pivotal_mixing


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


QUERIES["op4_pivot_top_k"] = op4_pivot_top_k
ORACLE_SQL["op4_pivot_top_k"] = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), "license", "dice", F.col("unit").cast("long").alias("unit"))


def _templates_sql() -> str:
    rows = (f"('{name}', [{', '.join(repr(g) for g in licenses.bigrams(text))}])" for name, text in licenses.TEMPLATES)
    return "select * from (values " + ", ".join(rows) + ") as x(license, g)"


QUERIES["op7_license_scan"] = op7_license_scan
ORACLE_SQL["op7_license_scan"] = rf"""
with t as materialized ({_templates_sql()}),
d as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') as p from documents),
u as (
  select doc_id, 0 as unit, replace(p, chr(10), ' ') as s from d
  union all
  select doc_id, unnest(range(1, len(ls) + 1)) as unit, unnest(ls) as s from (select doc_id, string_split(p, chr(10)) as ls from d)
), w as (select doc_id, unit, list_filter(string_split(s, ' '), lambda x: x <> '') as ws from u),
g as materialized (
  select doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as g from w where len(ws) >= 2
), m as (
  select doc_id, unit, license, 2.0::double * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) as dice
  from g join t on len(g.g) <= 4 * len(t.g)
), k as (select * from m where dice >= {licenses.THRESHOLD}),
a as (
  select doc_id, count(*) as n, string_agg(distinct license, ',' order by license) as licenses,
    min(row(-dice, unit, license)) as best from k group by doc_id
)
select d.doc_id, coalesce(n, 0)::bigint as n_matches, coalesce(licenses, '') as licenses, best[3] as license,
  -best[1] as dice, best[2]::bigint as unit
from d left join a using (doc_id)
"""


def op7_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.whole(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("passages", lambda m: F.struct(m.dice.alias("dice"), (-m.at).alias("at"), m.license.alias("license"))))
    found = found.withColumn("best", best).select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.size("passages").cast("long").alias("n_passages"), F.array_join("licenses", ",").alias("licenses"), "best")
    return found.select("doc_id", "n_matches", "n_passages", "licenses", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), (-F.col("best.at")).cast("long").alias("at"))


def _passages_sql() -> str:
    """Templates (k, license, n words, g bigrams) of licenses.whole."""
    every = licenses.TEMPLATES + licenses.TEXTS
    words = lambda text: len("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())
    rows = (f"({k}, '{name}', {words(text)}, [{', '.join(repr(g) for g in licenses.bigrams(text))}])" for k, (name, text) in enumerate(every))
    return "select * from (values " + ", ".join(rows) + ") as x(k, license, n, g)"


QUERIES["op7_license_passages"] = op7_license_passages
ORACLE_SQL["op7_license_passages"] = rf"""
with t as materialized ({_passages_sql()}),
tg as materialized (select k, n, len(g) as size, unnest(g) as x from t),
p as materialized (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') as p from documents),
u as (
  select doc_id, replace(p, chr(10), ' ') as s from p
  union all
  select doc_id, unnest(string_split(p, chr(10))) as s from p
), w as (select doc_id, list_filter(string_split(s, ' '), lambda x: x <> '') as ws from u),
g as materialized (
  select doc_id, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as g from w where len(ws) >= 2
), units as (
  select doc_id, license from g join t on len(g.g) <= 4 * len(t.g)
  where 2.0::double * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) >= {licenses.THRESHOLD}
), dw as (select doc_id, list_filter(string_split(replace(p, chr(10), ' '), ' '), lambda x: x <> '') as ws from p),
dg as materialized (select doc_id, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) as g from dw where len(ws) >= 2),
pos as materialized (select doc_id, unnest(g) as x, unnest(range(len(g))) as i from dg),
shared as materialized (select doc_id, k, i, n, size, x from pos join tg using (x)),
dice as (
  select a.doc_id, a.k, a.i, any_value(a.n) as n, any_value(a.size) as size, count(distinct b.x) as hits
  from shared a join shared b on a.doc_id = b.doc_id and a.k = b.k and b.i between a.i and a.i + a.n - 2 group by a.doc_id, a.k, a.i
), likely as (select * from dice where 2 * hits >= {licenses.THRESHOLD} * size),
wins as materialized (
  select doc_id, k, i, n, 2.0::double * hits / (len(list_distinct(g[i + 1:i + n - 1])) + size) as dice from likely join dg using (doc_id)
), found as materialized (select * from wins where dice >= {licenses.THRESHOLD}),
kept as (
  select doc_id, license, dice, i from found m join t using (k) where not exists (
    select 1 from found o where o.doc_id = m.doc_id and o.k = m.k and abs(o.i - m.i) < m.n and (o.dice > m.dice or (o.dice = m.dice and o.i < m.i)))
), named as (select doc_id, license from units union all select doc_id, license from kept),
a as (select doc_id, string_agg(distinct license, ',' order by license) as licenses from named group by doc_id),
b as (select doc_id, count(*) as n, max(row(dice, -i, license)) as best from kept group by doc_id),
c as (select doc_id, count(*) as n from units group by doc_id)
select d.doc_id, coalesce(c.n, 0)::bigint as n_matches, coalesce(b.n, 0)::bigint as n_passages, coalesce(licenses, '') as licenses,
  best[3] as license, best[1] as dice, (-best[2])::bigint as "at"
from p d left join a using (doc_id) left join b using (doc_id) left join c using (doc_id)
"""


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


QUERIES["op6_edit_aware_counts"] = op6_edit_aware_counts


def _script(docs: DataFrame) -> DataFrame:
    """The edits of tokencount.script as a table."""
    h, n = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.length("text").cast("long")
    edit = lambda seq, place, removed, put: F.struct(F.lit(seq).alias("seq"), place.cast("long").alias("place"), removed.cast("long").alias("removed"), put.alias("put"))
    half = F.floor(n / 2)
    note = F.concat(F.lit(" ["), (h % 9973).cast("string"), F.lit("] revised "))
    odd = h % 2 == 1
    end = edit(2, F.when(odd, n).otherwise(F.greatest(n - 40, F.lit(0))), F.when(odd, 0).otherwise(15), F.when(odd, " The end.").otherwise(""))
    three = F.array(edit(0, half, F.least(half, 20 + h % 60), F.lit("")), edit(1, h % (n + 1), F.lit(0), note), end)
    return docs.where(F.length("text") > 0).select("doc_id", F.inline(three))


def op6_stored_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, how = table(spark, sf_dir, "documents").select("doc_id", "text"), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    stored = tokencount.trees(docs, *how)
    edited = tokencount.apply_edits(stored, _script(docs), *how)
    drop(stored)
    return edited.select("doc_id", "n_rows", "n_tokens", "n_edits", "n_reencoded")


QUERIES["op6_stored_trees"] = op6_stored_trees


def op11_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES["op11_dictionary_warc"] = op11_dictionary_warc


def op12_merge_sort_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.sorted_and_rewritten(table(spark, sf_dir, "clients"))


QUERIES["op12_merge_sort_rewrite"] = op12_merge_sort_rewrite


def op13_rare_first_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES["op13_rare_first_variants"] = op13_rare_first_variants
