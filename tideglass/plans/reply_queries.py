"""Queries of model replies over the conversations, with their DuckDB SQL: judging and search replies in all the forms they come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import control
from tideglass.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Judging replies around a number `n`: bare, fenced with and without a mark, nested, as strings, out of range, null, broken, prose, a list, empty.
FORMS = [
    '{"score": %n, "marginal_gain_estimate": 7.5}', 'I think:\\n```json\\n{"score": %n}\\n```\\nscore 3', '```\\n{"marginal_gain_estimate": "-4", "score": %n}\\n``` bye',
    '{"meta": {"score": 1, "deep": [{"score": 2}]}, "score": "%n"}', '{"score": 2%n0, "marginal_gain_estimate": -900}', '{"score": null} Score: %n', '{"score": null}', '{"score": %n, "marginal_gain_estimate": "high"}',
    '{"score": %n, ', 'The Score:  1, final score %n', '[%n, 2]', '```json\\n{"score": %n\\n```', "{'score': %n} score: 12", '{"note": "score 77"}', '',
]
#: Search replies around a number: a list, marked, between backticks, fenced without a mark, objects without fields, prose, urls alone.
SEARCHES = [
    '[{"title": "T%n", "url": "http://a/%n", "snippet": "s"}, {"url": "http://b"}]', 'Here: ```json\\n[{"title": null, "url": "http://c/%n"}]\\n``` http://out', '`[{"title": "one"}, {"title": 2}]`',
    '```\\n[{"title": "lost"}]\\n``` http://lost', 'Title: first %n\\nhttp://x/%n more\\ntitle second\\nhttps://y/%n\\nhttp://z', '{"title": "no list", "url": "http://d/%n"}',
    '[1, {"title": "x", "url": "http://e"}]', 'nothing', '[]', 'http://1 http://2 http://3 http://4 http://5 http://6/%n',
]


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return add


def _reply(forms: list[str]):
    """The form that the row's numbers pick, with the text's length in it; every form's turn comes with the text itself once."""
    pick = F.element_at(F.array(*[F.lit(f.replace("\\n", "\n")) for f in forms], F.lit("%n")), ((F.col("conv_id") * 7 + F.col("turn")) % (len(forms) + 1) + 1).cast("int"))
    made = F.replace(pick, F.lit("%n"), (F.length(F.coalesce("text", F.lit(""))) % 97).cast("string"))
    return F.when(pick == "%n", F.col("text")).otherwise(made)


def _reply_sql(forms: list[str]) -> str:
    listed = ", ".join("'" + f.replace("'", "''").replace("\\n", "' || chr(10) || '") + "'" for f in [*forms, "%n"])
    return f"select conv_id, turn, case when pick = '%n' then text else replace(pick, '%n', (length(coalesce(text, '')) % 97)::varchar) end as t from (select *, ([{listed}])[(conv_id * 7 + turn) % {len(forms) + 1} + 1] as pick from conversations)"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "reply_scores",
    f"""with r as ({_reply_sql(FORMS)}),
b as (select conv_id, turn, coalesce(t, '') as t, {_TRIM.format("case when contains(t, '```') then regexp_replace(split_part(t, '```', 2), '^json', '') else coalesce(t, '') end")} as j from r),
p as (select *, case when json_valid(j) and json_type(case when json_valid(j) then j end) = 'OBJECT' then j::json end as o from b),
v as (select *, case when o is null then null when json_exists(o, '$.score') then try_cast(json_extract_string(o, '$.score') as double) else 50.0 end as s,
  case when o is null then null when json_exists(o, '$.marginal_gain_estimate') then try_cast(json_extract_string(o, '$.marginal_gain_estimate') as double) else 0.0 end as g,
  try_cast(regexp_extract_all(t, '(?i)score[\\s:]*(\\d+)', 1)[-1] as double) as f from p)
select conv_id, turn, least(greatest(case when s is not null and g is not null then s else coalesce(f, s, 50.0) end, 0.0), 100.0)::double as score,
  least(greatest(case when s is not null and g is not null then g else 0.0 end, -100.0), 100.0)::double as gain_estimate from v""",
)
def reply_scores(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", _reply(FORMS))
    return rows.select("conv_id", "turn", *[v.alias(k) for k, v in control.parse_reply(F.col("t")).items()])


@query(
    "search_results",
    f"""with r as ({_reply_sql(SEARCHES)}),
b as (select conv_id, turn, case when contains(t, '`json') then split_part(split_part(t, '`json', 2), '`', 1) when contains(t, '`') then split_part(t, '`', 2) else coalesce(t, '') end as t from r),
j as (select *, {_TRIM.format("t")} as s from b), p as (select *, case when json_valid(s) then s::json end as o from j),
l as (select *, case when json_type(o) = 'ARRAY' and len(list_filter(json_transform(o, '["JSON"]'), lambda x: json_type(x) <> 'OBJECT')) = 0 then json_transform(o, '["JSON"]') end as items from p),
u as (select *, regexp_extract_all(t, 'https?://[^\\s]+') as urls, regexp_extract_all(t, '(?i)title[:\\s]+([^\\n]+)', 1) as titles from l),
x as (select conv_id, turn, i - 1 as rank, items is not null as typed, items[i] as item, urls[i] as url, titles[i] as title
  from (select *, unnest(range(1, least(5, case when items is not null then len(items) else len(urls) end) + 1)) as i from u))
select conv_id, turn, rank::int as rank, case when not typed then coalesce(title, url[1:50]) when json_exists(item, '$.title') then json_extract_string(item, '$.title') else '' end as title,
  case when not typed then url when json_exists(item, '$.url') then json_extract_string(item, '$.url') else '' end as url,
  case when not typed then '' when json_exists(item, '$.snippet') then json_extract_string(item, '$.snippet') else '' end as snippet from x""",
)
def search_results(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", _reply(SEARCHES))
    return rows.select("conv_id", "turn", F.inline(control.parse_search(F.col("t"))))
