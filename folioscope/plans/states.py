"""Queries on saved editor states, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import states as S
from folioscope.operators.engine import Profile, validate
from folioscope.plans.records import _P5, flat_states
from folioscope.plans.rules import name_of
from folioscope.session import table
from folioscope.sources.imports import from_states

WORD = "анализ"


def states_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far every state is."""
    return S.progress(flat_states(spark, d))


def states_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Which structural elements every state has."""
    return S.readiness(flat_states(spark, d))


def states_search(spark: SparkSession, d: str) -> DataFrame:
    """Top sections in which a word occurs."""
    return S.search(flat_states(spark, d), WORD)


def states_replace_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often a word occurs in all parts of every state."""
    return S.replacements(flat_states(spark, d), WORD)


def states_title_case(spark: SparkSession, d: str) -> DataFrame:
    """Headings that title case changes."""
    return S.retitled(flat_states(spark, d))


def states_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions without label and number."""
    return S.bare_captions(flat_states(spark, d))


def states_empty_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the states that show nothing."""
    return S.empty_paragraphs(flat_states(spark, d))


def states_header_merges(spark: SparkSession, d: str) -> DataFrame:
    """Header cells of the tables in the states that extend over blank cells."""
    b = flat_states(spark, d)["block"].where("kind = 'table'")
    return b.select("state_id", "node_path", F.inline(S.header_merges(F.col("headers"))))


def states_reference_targets(spark: SparkSession, d: str) -> DataFrame:
    """What references of every state can name."""
    return S.reference_targets(flat_states(spark, d))


def states_citation_options(spark: SparkSession, d: str) -> DataFrame:
    """What citations of every state can name."""
    return S.citation_options(flat_states(spark, d))


def states_diff(spark: SparkSession, d: str) -> DataFrame:
    """How the top sections of every version of a document differ from the version before."""
    order = table(spark, d, "builder_states").select("state_id", "doc_id", "saved_at").distinct()
    return S.versions_diff(flat_states(spark, d), order)


def _state_rule(code: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = from_states(spark, table(spark, d, "builder_states"))
        return validate(c, Profile(), codes=[code], suppress=False).select(F.col("doc_id").alias("state_id"), "severity", "location", "detail")

    query.__doc__ = f"Violations of rule {code} in the saved states, for rules that find little in the tables."
    query.__name__ = "states_" + name_of(code)
    return query


QUERIES = {
    f.__name__: f
    for f in (states_progress, states_readiness, states_search, states_replace_counts, states_title_case, states_captions, states_empty_paragraphs, states_header_merges, states_reference_targets, states_citation_options, states_diff, *map(_state_rule, ("B.01", "B.10", "M.02", "M.04", "T.07")))
}

_NODES = _P5[: _P5.rindex("select state_id, path as node_path")].rstrip() + r""",
node as (select state_id, path, parent, kind as tag, v, split_part(path, '/', 1) as top, v ->> 'kind' as kind from w where role = 'node'),
txt as (select state_id, parent as path, string_agg(coalesce(v ->> 'text', ''), '' order by cast(regexp_extract(path, '(\d+)$', 1) as int)) as t from node where tag = 'run' and kind = 'text' group by all),
blk as (select node.*, coalesce(nullif(v ->> 'text', ''), t, '') as t from node left join txt using (state_id, path) where tag = 'block'),
sec as (select *, v ->> 'heading' as heading, coalesce(try_cast(v ->> 'is_bibliography' as boolean), false) as is_bib, case when json_type(v, '$.references') = 'ARRAY' then v ->> '$.references[*]' else [] end as refs from node where tag = 'section')
"""
_SHOWN = r"trim(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g')) <> ''"
_NORM = r"trim(lower(regexp_replace(coalesce(heading, ''), '[\s\p{Z}]+', ' ', 'g')))"
_LIST = "case when json_type(v, '$.{0}') = 'ARRAY' then v ->> '$.{0}[*]' else [] end"
_STRINGS = f""", s as (select state_id, path, top, unnest(list_concat([heading], case when is_bib then refs else [] end)) as s from sec
union all select state_id, path, top, unnest(case kind when 'paragraph' then [v ->> 'text'] when 'list' then {_LIST.format('items')} when 'figure' then [v ->> 'caption']
 when 'table' then list_concat([v ->> 'caption'], {_LIST.format('headers')}, case when json_type(v, '$.rows') = 'ARRAY' then v ->> '$.rows[*][*]' else [] end) else [] end) from blk
union all select r.state_id, r.path, r.top, r.v ->> 'text' from node r join blk on blk.state_id = r.state_id and blk.path = r.parent and blk.kind = 'paragraph' where r.tag = 'run' and r.kind = 'text')"""
_PREFIX = r"'^(?:{0}[\s\p{Z}]+\d+(?:\.\d+)*(?:[\s\p{Z}]*[—–\-.:][\s\p{Z}]*|[\s\p{Z}]+|$))+', ''"

SQL = {
    "states_progress": f"""{_NODES}, b as (select state_id, top, count(*) filter (kind = 'paragraph') as paragraphs, count(*) filter (kind = 'paragraph' and {_SHOWN}) as nonempty_paragraphs, count(*) filter (kind = 'table') as tables, count(*) filter (kind = 'figure') as figures,
 count(*) filter (kind = 'formula') as formulas, sum(case when kind = 'list' then len({_LIST.format('items')}) else 0 end) as list_items, sum(case when kind = 'paragraph' and {_SHOWN} then len(list_filter(regexp_split_to_array(t, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) else 0 end) as words,
 bool_or((kind = 'paragraph' and {_SHOWN}) or kind in ('table', 'figure', 'formula', 'list')) as filled from blk group by all),
r as (select state_id, top, sum(case when is_bib then len(refs) else 0 end) as sources from sec group by all)
select state_id, count(*) as sections, count(*) filter (coalesce(filled, false) or sources > 0) as filled_sections, {", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in ("paragraphs", "nonempty_paragraphs", "tables", "figures", "formulas", "list_items", "words", "sources"))}
from r left join b using (state_id, top) group by state_id""",
    "states_readiness": f"""{_NODES}, h as (select *, {_NORM} as n from sec where parent = '')
select state_id, bool_or(n = 'титульный лист') as title_page, bool_or(n = 'содержание') as contents, bool_or(n = 'введение') as introduction, bool_or(coalesce(regexp_matches(heading, '^\\s*\\d+(\\.\\d+)*\\.?\\s'), false) or starts_with(n, 'глава ')) as main_part,
bool_or(n = 'заключение') as conclusion, bool_or(is_bib or n = 'литература' or (starts_with(n, 'список') and (contains(n, 'источник') or contains(n, 'литератур')))) as sources, bool_or(starts_with(n, 'приложение')) as appendices from h group by state_id""",
    "states_search": f"{_NODES}{_STRINGS} select distinct state_id, top as node_path from s where contains(lower(s), '{WORD}')",
    "states_replace_counts": f"{_NODES}{_STRINGS} select state_id, cast(sum((length(s) - length(replace(s, '{WORD}', ''))) // {len(WORD)}) as bigint) as hits from s where s is not null group by state_id having hits > 0",
    "states_title_case": f"""{_NODES}, n as (select state_id, path as node_path, heading, array_to_string(list_transform(string_split(heading, ' '), lambda w: case when regexp_matches(w, '^\\p{{L}}') then upper(w[1]) || w[2:] else w end), ' ') as new_heading from sec)
select * from n where heading <> new_heading""",
    "states_captions": f"""{_NODES}, c as (select state_id, path as node_path, kind, regexp_replace(v ->> 'caption', '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as c from blk where kind in ('table', 'figure') and v ->> 'caption' is not null)
select state_id, node_path, kind, trim(case kind when 'table' then regexp_replace(c, {_PREFIX.replace('{0}', 'Таблица')}) else regexp_replace(c, {_PREFIX.replace('{0}', 'Рисунок')}) end) as caption from c""",
    "states_empty_paragraphs": f"{_NODES} select state_id, path as node_path from blk where kind = 'paragraph' and not {_SHOWN}",
    "states_header_merges": f"""{_NODES}, h as (select state_id, path as node_path, {_LIST.format('headers')} as hs from blk where kind = 'table'),
c as (select state_id, node_path, unnest(hs) as x, generate_subscripts(hs, 1) - 1 as col, len(hs) as n from h), f as (select * from c where trim(x) <> ''), g as (select *, coalesce(lead(col) over (partition by state_id, node_path order by col), n) - col as colspan from f)
select state_id, node_path, cast(col as int) as col, cast(colspan as int) as colspan from g where colspan > 1""",
}

# Blocks as the rules read them: text of the text runs, else the caption or the old text; in order, blocks before subsections.
_BLOCKS = f"""{_NODES}, shown as (select state_id, parent as path, string_agg(case when coalesce(kind, 'text') = 'text' then coalesce(v ->> 'text', '') else '' end, '' order by cast(regexp_extract(path, '(\\d+)$', 1) as int)) as t from node where tag = 'run' group by all),
b as (select n.state_id, n.path, n.parent, n.kind, n.v, case when s.path is not null then s.t else coalesce(case when n.kind in ('figure', 'table') then n.v ->> 'caption' end, n.v ->> 'text', '') end as t,
 row_number() over (partition by n.state_id order by list_transform(string_split(n.path, '/'), lambda x: struct_pack(l := x[1], n := cast(x[2:] as int)))) as o from node n left join shown s on s.state_id = n.state_id and s.path = n.path where n.tag = 'block'),
f as (select *, case when kind = 'formula' and trim(coalesce(v ->> 'latex', '')) <> '' and coalesce(try_cast(v ->> 'numbered' as boolean), true) then 1 end as own from b),
g as (select *, case when own = 1 then sum(own) over (partition by state_id order by o) end as num from f)"""
_STYLED = "kind = 'paragraph' and not regexp_matches(t, '(?i)^\\s*(?:Рисунок|Таблица)\\s+\\d+\\s*[—–-]')"


def _found(severity: str, kind: str, cond: str, detail: str = "''", more: str = "") -> str:
    return f"{_BLOCKS}{more} select state_id, '{severity}' as severity, '{kind}[' || path || ']' as location, {detail} as detail from g where {cond}"


SQL |= {
    "states_rule_b01": _found("error", "table", f"kind = 'table' and not {_SHOWN}"),
    "states_rule_b10": _found("warning", "table", "kind = 'table' and json_type(v, '$.rows') = 'ARRAY' and len(list_filter(v ->> '$.rows[*][*]', lambda x: trim(coalesce(x, '')) <> '')) = 0"),
    "states_rule_m02": f"""{_BLOCKS}, h as (select *, max(case when kind = 'paragraph' and regexp_matches(t, '(?i)^\\s*(?:где|здесь)(?:[^\\p{{L}}\\p{{N}}_]|$)') then 1 else 0 end) over (partition by state_id order by o rows between 1 following and 3 following) as told from g)
select state_id, 'warning' as severity, 'formula[' || path || ']' as location, cast(cast(num as bigint) as varchar) as detail from h where num is not null and coalesce(told, 0) = 0""",
    "states_rule_m04": f"""{_BLOCKS}, said as (select state_id, unnest(list_concat(regexp_extract_all(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])формул(?:а|е|у|ы|ой|ах|ам)?\\s+\\(?(\\d+)\\)?', 1), regexp_extract_all(t, '(?:^|[^A-Za-zА-Яа-яЁё])\\((\\d+)\\)', 1))) as n from g where {_STYLED})
select state_id, 'warning' as severity, 'formula[' || path || ']' as location, cast(cast(num as bigint) as varchar) as detail from g where num is not null and not exists (select 1 from said where said.state_id = g.state_id and try_cast(said.n as int) = g.num)""",
    "states_rule_t07": f"""{_BLOCKS}, e as (select *, not {_SHOWN} as hollow, row_number() over (partition by state_id, parent order by o) - row_number() over (partition by state_id, parent, {_SHOWN} order by o) as i from g where kind = 'paragraph')
select state_id, 'warning' as severity, 'paragraph[' || arg_min(path, o) || ']' as location, cast(count(*) as varchar) as detail from e where hollow group by state_id, parent, i having count(*) > 1""",
    "states_reference_targets": f"""{_BLOCKS}, s as (select state_id, path from sec where is_bib and parent = ''),
t as (select g.*, row_number() over (partition by g.state_id, kind order by o) as n from g where (kind in ('figure', 'table') or (kind = 'formula' and coalesce(try_cast(v ->> 'numbered' as boolean), true)))
 and not exists (select 1 from s where s.state_id = g.state_id and s.path = split_part(g.path, '/', 1)))
select state_id, path as node_path, case kind when 'figure' then 'fig-' when 'table' then 'tbl-' else 'formula-' end || n as target_id, case kind when 'figure' then 'Рисунок ' when 'table' then 'Таблица ' else 'Формула ' end || n || ': ' ||
case when kind = 'formula' then coalesce(nullif(case when length(v ->> 'latex') > 30 then left(v ->> 'latex', 30) || '…' else v ->> 'latex' end, ''), '(пусто)') else coalesce(nullif(v ->> 'caption', ''), '(без подписи)') end as label from t""",
    "states_citation_options": f"""{_NODES}, b as (select state_id, arg_min(refs, cast(path[2:] as int)) as r from sec where is_bib and parent = '' group by state_id),
i as (select state_id, regexp_replace(unnest(r), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as s, generate_subscripts(r, 1) as i from b)
select state_id, 'bib-' || i as source_id, '[' || i || '] ' || case when length(s) > 60 then left(s, 57) || '…' else s end as label from i where s <> ''""",
}
