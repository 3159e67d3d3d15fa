"""One query per rule of the catalogue over the current documents, and the union of all rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import rules as catalogue
from folioscope.operators.engine import RULES, Profile, validate, validate_in_parts
from folioscope.sources.corpus import from_tables

#: Parameters that make the rules speak to these tables, where the base profile's would find nothing or everything.
PARAMS = {
    "T.01": {"font": "Serif One"},
    "X.05": {"terms": {"метод": ["способ", "приём"], "installation": ["pumping station"]}},
    "X.03": {"banned_phrases": ["вышло плохо", "clearly", "es klappte"]},
    "R.13": {"suspicious_domains": ["lane.example", "vik.example"]},
    "I.03": {"format": "Рисунок {num} — {title}", "allow_dot_after_number": True},
    "I.11": {"format": "Рисунок {num} – {title}"},
    "B.12": {"format": "Таблица {num} – {title}"},
    "A.02": {"threshold": 0},
    "X.06": {"custom_patterns": ["анализ", "analysis"], "max_per_paragraph": 0},
}


def name_of(code: str) -> str:
    return "rule_" + code.lower().replace(".", "")


def _rule(code: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = from_tables(spark, d)
        return validate(c, Profile(params=PARAMS), codes=[code], suppress=False).select("doc_id", "severity", "location", "detail")

    query.__doc__ = f"Violations of rule {code} in the current documents."
    query.__name__ = name_of(code)
    return query


def rule_union(spark: SparkSession, d: str) -> DataFrame:
    """All violations of all enabled rules, without what sections disable."""
    return validate_in_parts(from_tables(spark, d).written(), Profile(disabled=set(catalogue.OFF), params=PARAMS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name_of(c): _rule(c) for c in sorted(RULES) if c != "R.15"} | {"rule_union": rule_union}

_CURRENT = """
with blk as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, block_id order by loaded_at desc, is_deleted) rn from blocks) where rn = 1 and not coalesce(is_deleted, false)),
sec as (select * exclude (rn), sec_level as lvl, array_to_string(list_transform(list_filter(coalesce(heading, []), lambda h: h.kind = 'text'), lambda h: coalesce(h.text, '')), '') as txt
        from (select *, row_number() over (partition by doc_id, sec_id order by loaded_at desc, is_deleted) rn from sections) where rn = 1 and not coalesce(is_deleted, false)),
bib as (select * exclude (rn) from (select *, row_number() over (partition by doc_id, entry_id order by loaded_at desc, is_deleted) rn from bibliography) where rn = 1 and not coalesce(is_deleted, false)),
run as (select distinct doc_id, block_id, run_id, run_ord, kind, text, bold, font, size_pt, source_id, target_id from runs where block_id is not null),
tx as (select doc_id, block_id, coalesce(string_agg(case when kind = 'text' then coalesce(text, '') end, '' order by run_ord nulls first, run_id), '') as text from run group by doc_id, block_id),
bt as (select blk.*, coalesce(tx.text, '') as text,
        case when lower(coalesce(style_name, '')) like 'caption%' or lower(coalesce(style_name, '')) like 'название%' then 'caption'
             when lower(style_name) = 'footnote text' then 'footnote' when lower(style_name) in ('header', 'footer') then 'header_footer'
             when lower(coalesce(style_name, '')) like 'heading%' then 'heading' else 'body' end as cat
       from blk left join tx using (doc_id, block_id)),
par as (select * from bt where block_type = 'paragraph'),
docs as (select distinct doc_id from documents)
"""
_NORM = "lower(trim(regexp_replace(txt, '[\\s\\p{Z}]+', ' ', 'g')))"
_NUM = {"figure": "^Рис(?:унок)?\\.?\\s+(\\d+)", "table": "^Таблица\\s+(\\d+)"}
_SAID = {"figure": "(?i)рис(?:унок|унке|унков|унках|унка|унку|унком)?\\.?\\s+(\\d+)", "table": "(?i)табл(?:ица|ице|ицу|иц|ицах|ицы)?\\.?\\s*(\\d+)"}
_PLAIN = "par where cat <> 'caption' and not regexp_matches(text, '(?i)^\\s*(?:Рисунок|Таблица)\\s+\\d+\\s*[—–-]')"


def _p(cond: str, severity: str, detail: str = "''", extra: str = "") -> str:
    return f"{_CURRENT} select doc_id, '{severity}' as severity, 'paragraph[' || block_id || ']' as location, {detail} as detail from par {extra} where {cond}"


def _h(cond: str, severity: str, detail: str = "txt") -> str:
    return f"{_CURRENT} select doc_id, '{severity}' as severity, 'section[' || sec_id || ']' as location, {detail} as detail from sec where {cond}"


def _o(kind: str, cond: str, severity: str, detail: str = "''") -> str:
    return f"{_CURRENT} select doc_id, '{severity}' as severity, '{kind}[' || block_id || ']' as location, {detail} as detail from bt where block_type = '{kind}' and {cond}"


def _e(cond: str, severity: str, detail: str = "''") -> str:
    return f"{_CURRENT} select doc_id, '{severity}' as severity, 'bibliography[' || entry_id || ']' as location, {detail} as detail from bib where {cond}"


def _nums(kind: str) -> str:
    return f"""num as (select doc_id, block_id, block_ord, container_id, cast(nullif(regexp_extract(trim(text), '{_NUM[kind]}', 1), '') as int) as num from bt where block_type = '{kind}'),
obj as (select * from num where num is not null),
said as (select doc_id, block_id, block_ord, try_cast(unnest(regexp_extract_all(text, '{_SAID[kind]}', 1)) as int) as num from {_PLAIN})"""


def _breaks(kind: str) -> str:
    return f"""{_CURRENT}, {_nums(kind)},
a as (select *, row_number() over (partition by doc_id, num order by block_ord, block_id) as nth, first_value(block_id) over (partition by doc_id, num order by block_ord, block_id) as f from obj),
b as (select *, coalesce(lag(num) over (partition by doc_id, nth = 1 order by block_ord, block_id), 0) + 1 as want from a)
select doc_id, 'error' as severity, '{kind}[' || block_id || ']' as location, case when nth > 1 then 'duplicate of ' || f else want || ',' || num end as detail from b where nth > 1 or num <> want"""


def _unsaid(kind: str) -> str:
    return f"""{_CURRENT}, {_nums(kind)}
select doc_id, 'error' as severity, '{kind}[' || block_id || ']' as location, cast(num as varchar) as detail from obj where not exists (select 1 from said where said.doc_id = obj.doc_id and said.num = obj.num)"""


def _nowhere(kind: str) -> str:
    return f"""{_CURRENT}, {_nums(kind)}
select doc_id, 'error' as severity, 'paragraph[' || block_id || ']' as location, cast(num as varchar) as detail from said where not exists (select 1 from obj where said.doc_id = obj.doc_id and said.num = obj.num) and num is not null"""


def _tree(heading: str) -> str:
    return f"""root as (select doc_id, sec_id as root from (select *, row_number() over (partition by doc_id order by sec_ord, sec_id) k from sec where lvl = 1 and {_NORM} = '{heading}') where k = 1),
below as (select distinct doc_id, sec_id, unnest(list_append(coalesce(sec_path, []), sec_id)) as root from sec),
tree as (select root.doc_id, root.root, below.sec_id from root join below using (doc_id, root))"""


_RUNS = "join run using (doc_id, block_id)"
_FIELD = "nullif(entry_fields['{}'], '')"
_F = _FIELD.format
_AUTHOR = f"lower({_F('author')})"
_RAW = "coalesce(trim(entry_fields['raw']), '')"

_W = "[^\\p{L}\\p{N}_]"
_UNIT = "|".join(re.escape(u) for u in sorted(catalogue.SI_UNITS, key=len, reverse=True))
_EDGE = "(?:[\\s.,;:!?)\\]/\\-]|$)"
_NAMES = "|".join(u for u in catalogue.TEXT_UNITS if u[0].isalnum())
_SIGNS = "|".join(u for u in catalogue.TEXT_UNITS if not u[0].isalnum())


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _each(pattern: str, severity: str, group: int = 1, table: str = "par", cond: str = "true") -> str:
    """A row for each match of a pattern in the paragraphs."""
    return f"{_CURRENT} select doc_id, '{severity}' as severity, 'paragraph[' || block_id || ']' as location, unnest(regexp_extract_all(text, '{pattern}', {group})) as detail from {table} where {cond}"


def _heading(level: int, upper: bool) -> str:
    case = f"select doc_id, 'error' as severity, 'section[' || sec_id || ']' as location, 'case' as detail from sec where lvl = {level} and trim(txt) <> '' and trim(txt) <> upper(trim(txt)) union all " if upper else ""
    return f"""{_CURRENT}, hr as (select doc_id, sec_id, unnest(heading) as h from sec where lvl = {level} and trim(txt) <> ''), r as (select * from hr where h.kind = 'text' and trim(h.text) <> '')
{case} select doc_id, 'error' as severity, 'section[' || sec_id || ']' as location, 'size' as detail from r where abs(h.size_pt - 14) > 0.1 union all select doc_id, 'error', 'section[' || sec_id || ']', 'bold' from r where not h.bold"""


def _caption(kind: str, word: str, prefix: str, dot: bool) -> str:
    good = f"regexp_matches(trim(text), '^{word} (?:[А-Я]\\.)?\\d+(?:\\.\\d+)* [—–-] \\S.*\\s*$')" + (f" or regexp_matches(trim(text), '^{prefix}\\s+\\d+(?:\\.\\d+)?\\.\\s+\\S')" if dot else "")
    return _o(kind, f"trim(text) <> '' and not ({good})", "error", "text")


_CITED = """tok as (select doc_id, block_id, unnest(regexp_extract_all(inner_, '\\d+(?:\\s*[-–]\\s*\\d+)?')) as t from (select doc_id, block_id, unnest(regexp_extract_all(text, '\\[(\\d+(?:\\s*[-–]\\s*\\d+|\\s*,\\s*\\d+)*)\\]', 1)) as inner_ from par)),
ab as (select doc_id, block_id, cast(regexp_extract(t, '^\\d+') as bigint) as a, cast(regexp_extract(t, '\\d+$') as bigint) as b from tok),
cite as (select doc_id, block_id, unnest(case when b < a then [a, b] else range(a, b + 1) end) as num from ab)"""

SQL: dict[str, str] = {
    "rule_t01": _p("run.kind = 'text' and trim(run.text) <> '' and cat <> 'header_footer' and run.font <> 'Serif One'", "error", "run.font", _RUNS),
    "rule_t02": _p("run.kind = 'text' and trim(run.text) <> '' and abs(run.size_pt - case cat when 'body' then 14 when 'caption' then 12 when 'footnote' then 10 end) > 0.1", "error", "cast(run.size_pt as varchar)", _RUNS),
    "rule_t03": _p("cat = 'body' and abs(line_spacing - 1.5) > 0.01", "error", "cast(line_spacing as varchar)"),
    "rule_t04": _p("cat = 'body' and abs(first_line_indent_cm - 1.25) > 0.05", "error", "cast(first_line_indent_cm as varchar)"),
    "rule_t05": _p("cat = 'body' and alignment <> 'justify'", "error", "alignment"),
    "rule_t08": _p("cat <> 'header_footer' and exists (select 1 from run where run.doc_id = par.doc_id and run.block_id = par.block_id and kind = 'text' and regexp_matches(run.text, '  +'))", "warning"),
    "rule_t10": _p("length(text) > length(replace(text, '\"', ''))", "warning", "cast(length(text) - length(replace(text, '\"', '')) as varchar)"),
    "rule_t11": _p("contains(text, ' - ')", "warning"),
    "rule_t13": _p("regexp_matches(text, '[А-ЯЁ]\\. [А-ЯЁ]\\. [А-ЯЁ][а-яё]+')", "info", "cast(len(regexp_extract_all(text, '[А-ЯЁ]\\. [А-ЯЁ]\\. [А-ЯЁ][а-яё]+')) as varchar)"),
    "rule_s03": _h("lvl = 1 and N not in ('введение','заключение','список использованных источников','список литературы','реферат','содержание','перечень сокращений','приложение','титульный лист','нормативные ссылки','термины и определения','определения','обозначения и сокращения','перечень сокращений и обозначений','') and not starts_with(N, 'задание') and not starts_with(N, 'приложение') and not regexp_matches(N, '^глава\\s+\\S+') and not regexp_matches(N, '^\\d+(\\.\\d+)*\\.?\\s+\\S')".replace("N", _NORM), "warning"),
    "rule_s01": f"""{_CURRENT}, need as (select doc_id, unnest(['Введение', 'Заключение', 'Список использованных источников']) as h from docs)
select doc_id, 'error' as severity, 'document' as location, h as detail from need where not exists (select 1 from sec where sec.doc_id = need.doc_id and lvl = 1 and ({_NORM} = lower(h) or (h like 'Список%' and {_NORM} = 'список литературы')))""",
    "rule_s05": f"""{_CURRENT}, {_tree('заключение')}
select t.doc_id, 'warning' as severity, 'section[' || t.root || ']' as location, cast(count(p.block_id) as varchar) as detail from tree t
left join par p on p.doc_id = t.doc_id and p.container_id = t.sec_id and trim(p.text) <> '' group by t.doc_id, t.root having count(p.block_id) < 3""",
    "rule_s07": f"""{_CURRENT} select doc_id, 'warning' as severity, 'section[' || sec_id || ']' as location, txt as detail from sec where lvl = 1 and {_NORM} not in ('содержание', 'перечень сокращений', 'реферат')
and not exists (select 1 from bt where bt.doc_id = sec.doc_id and bt.container_id = sec.sec_id and (block_type in ('table', 'figure') or (block_type = 'paragraph' and trim(text) <> '')))
and not exists (select 1 from sec s where s.doc_id = sec.doc_id and s.parent_id = sec.sec_id)""",
    "rule_h05": f"""{_CURRENT}, h as (select *, lag(lvl) over (partition by doc_id order by sec_ord, sec_id) as before from sec)
select doc_id, 'error' as severity, 'section[' || sec_id || ']' as location, before || ',' || lvl as detail from h where lvl > before + 1""",
    "rule_h03": _h("regexp_matches(txt, '^\\d+(\\.\\d+)*\\.\\s')", "error", "regexp_extract(txt, '^(\\d+(\\.\\d+)*)\\.\\s', 1)"),
    "rule_h08": _h("regexp_matches(txt, '(\\.|…)\\s*$')", "warning"),
    "rule_i01": _o("figure", "trim(text) = ''", "error"),
    "rule_b01": _o("table", "trim(text) = ''", "error"),
    "rule_i05": _breaks("figure"),
    "rule_b09": _breaks("table"),
    "rule_i06": _unsaid("figure"),
    "rule_b08": _unsaid("table"),
    "rule_c01": _nowhere("figure"),
    "rule_c02": _nowhere("table"),
    "rule_i08": _o("figure", "dpi < 150", "warning", "cast(dpi as varchar)"),
    "rule_i09": _o("figure", "alignment <> 'center'", "warning", "alignment"),
    "rule_m01": _o("formula", "trim(coalesce(latex, '')) <> ''", "warning"),
    "rule_r02": f"""{_CURRENT}, e as (select *, {_AUTHOR} as k from bib),
l as (select *, lag(k) over w as bk, lag(entry_id) over w as bid from e window w as (partition by doc_id order by ordinal, entry_id)),
f as (select *, row_number() over (partition by doc_id order by ordinal, entry_id) as n from l where bk > k)
select doc_id, 'warning' as severity, 'bibliography[' || entry_id || ']' as location, bid as detail from f where n = 1""",
    "rule_r03": f"""{_CURRENT}, need as (select * from (values ('book', 'author'), ('book', 'year'), ('book', 'place'), ('article', 'author'), ('article', 'year'), ('web', 'url'), ('web', 'access_date'), ('standard', 'year')) n(t, f))
select doc_id, 'error' as severity, 'bibliography[' || entry_id || ']' as location, f as detail from bib join need on entry_type = t where nullif(entry_fields[f], '') is null""",
    "rule_r04": f"""{_CURRENT}, e as (select doc_id, entry_id, entry_type, {_RAW} as raw from bib),
a as (select *, 'length' as detail from e where length(raw) < 15
 union all select *, 'year' from e where length(raw) >= 15 and not regexp_matches(raw, '(^|[^\\p{{L}}\\p{{N}}_])(19|20)\\d{{2}}([^\\p{{L}}\\p{{N}}_]|$)')
 union all select *, 'final_dot' from e where length(raw) >= 15 and not ends_with(raw, '.')
 union all select *, 'separator' from e where length(raw) >= 15 and not regexp_matches(raw, '[—–/:]')
 union all select *, 'web_url' from e where length(raw) >= 15 and entry_type = 'web' and not contains(raw, 'URL:') and not contains(raw, '(дата обращения:'))
select doc_id, 'error' as severity, 'bibliography[' || entry_id || ']' as location, detail from a""",
    "rule_r08": _e(f"(entry_type = 'web' or {_F('url')} is not null) and {_F('access_date')} is null", "error"),
    "rule_r09": _e(f"try_cast(trim({_F('year')}) as int) >= 2020 and regexp_matches(trim({_F('year')}), '^[+-]?\\d+$') and {_F('doi')} is null and {_F('url')} is null", "info", _F("year")),
    "rule_r11": f"""{_CURRENT} select docs.doc_id, 'warning' as severity, 'bibliography' as location, cast(count(bib.entry_id) as varchar) as detail from docs left join bib using (doc_id) group by docs.doc_id having count(bib.entry_id) < 20""",
    "rule_r12": f"""{_CURRENT}, l as (select doc_id, coalesce({_F('language')}, case when regexp_matches({_RAW}, '^[А-ЯЁа-яё]') then 'ru' when regexp_matches({_RAW}, '^[A-Za-z]') then 'en' end) as lang from bib),
s as (select doc_id, avg(case when lang = 'en' then 1.0 else 0.0 end) as share from l where lang in ('ru', 'en') group by doc_id)
select doc_id, 'info' as severity, 'bibliography' as location, case when share < 0.1 then 'min' else 'max' end as detail from s where share < 0.1 or share > 0.5""",
    "rule_r13": _e(f"contains(lower({_F('url')}), 'lane.example') or contains(lower({_F('url')}), 'vik.example')", "warning", f"case when contains(lower({_F('url')}), 'lane.example') then 'lane.example' else 'vik.example' end"),
    "rule_x03": f"""{_CURRENT}, b as (select unnest(['вышло плохо', 'clearly', 'es klappte']) as phrase),
shown as (select doc_id, block_id, coalesce(string_agg(case when kind in ('text', 'xref') then coalesce(text, '') end, '' order by run_ord nulls first, run_id), '') as t from run group by doc_id, block_id)
select par.doc_id, 'info' as severity, 'paragraph[' || par.block_id || ']' as location, phrase as detail from par join shown using (doc_id, block_id) join b on contains(lower(t), phrase)""",
    "rule_x05": f"""{_CURRENT}, f as (select doc_id, bool_or(contains(lower(text), 'способ')) as a, bool_or(contains(lower(text), 'приём')) as b, bool_or(contains(lower(text), 'pumping station')) as c from par group by doc_id),
d as (select doc_id, 'метод: ' || concat_ws(', ', case when a then 'способ' end, case when b then 'приём' end) as detail from f where a or b union all select doc_id, 'installation: pumping station' from f where c)
select doc_id, 'info' as severity, 'document' as location, detail from d""",
    "rule_c06": f"""{_CURRENT}, r as (select par.doc_id, run.block_id, run.kind, coalesce(trim(case when run.kind = 'xref' then run.target_id else run.source_id end), '') as k from bt par join run using (doc_id, block_id) where run.kind in ('xref', 'citation')),
known as (select doc_id, 'xref' as kind, block_id as k from blk union select doc_id, 'xref', sec_id from sec union select doc_id, 'citation', entry_id from bib)
select doc_id, case when k = '' then 'error' else 'warning' end as severity, 'paragraph[' || block_id || ']' as location, kind || ' ' || k as detail from r
where not exists (select 1 from known where known.doc_id = r.doc_id and known.kind = r.kind and known.k = r.k)""",
    "rule_v01": f"""{_CURRENT}, w as (select doc_id, sum(len(list_filter(regexp_split_to_array(t, '[\\s\\p{{Z}}]+'), lambda x: x <> ''))) as n from
 (select bt.doc_id, coalesce(string_agg(case when run.kind in ('text', 'xref') then coalesce(run.text, '') end, '' order by run_ord nulls first, run_id), '') as t from bt left join run using (doc_id, block_id) where block_type in ('paragraph', 'table') group by bt.doc_id, bt.block_id) group by doc_id)
select docs.doc_id, 'warning' as severity, 'document' as location, case when coalesce(n, 0) / 250.0 < 25 then 'short' else 'long' end as detail from docs left join w using (doc_id) where coalesce(n, 0) / 250.0 < 25 or coalesce(n, 0) / 250.0 > 50""",
    "rule_h01": _heading(1, True),
    "rule_h02": _heading(2, False),
    "rule_h06": f"""{_CURRENT}, kid as (select doc_id, container_id as sec_id, 0 as sub, block_ord as o, block_id as i, block_type = 'paragraph' and trim(text) = '' as hollow from bt
 union all select doc_id, parent_id, 1, sec_ord, sec_id, false from sec where parent_id is not null),
f as (select doc_id, sec_id, arg_min(hollow, (sub, o, i)) as hollow from kid group by doc_id, sec_id)
select sec.doc_id, 'warning' as severity, 'section[' || sec.sec_id || ']' as location, case when hollow is null then 'nothing' else 'empty' end as detail from sec left join f using (doc_id, sec_id) where trim(txt) <> '' and coalesce(hollow, true)""",
    "rule_s02": f"""{_CURRENT.replace("with blk", "with recursive blk")}, rk(n, k) as (values {", ".join(f"('{n}', {k})" for k, h in enumerate(catalogue.EXPECTED_ORDER) for n in (x.lower() for x in (h, *catalogue.HEADING_ALIASES.get(h, []))))}),
h as (select doc_id, sec_id, txt, k, row_number() over (partition by doc_id order by sec_ord, sec_id) as j from sec join rk on rk.n = {_NORM} where lvl = 1),
chain as (select doc_id, j, k, 1 as len from h union select h.doc_id, h.j, h.k, c.len + 1 from chain c join h on h.doc_id = c.doc_id and h.j > c.j and h.k > c.k),
best as (select doc_id, j, max(k) as k, max(len) as len from chain group by doc_id, j),
step as (select b.doc_id, b.j, arg_min(a.j, (-a.len, a.j)) as up from best b left join best a on a.doc_id = b.doc_id and a.j < b.j and a.k < b.k group by b.doc_id, b.j),
keep as (select doc_id, arg_min(j, (-len, j)) as j from best group by doc_id union select s.doc_id, s.up from keep join step s on s.doc_id = keep.doc_id and s.j = keep.j where s.up is not null)
select doc_id, 'error' as severity, 'section[' || sec_id || ']' as location, txt as detail from h where not exists (select 1 from keep where keep.doc_id = h.doc_id and keep.j = h.j)""",
    "rule_s04": f"""{_CURRENT}, {_tree('введение')}, t as (select tree.doc_id, root, lower(text) as t from tree join par on par.doc_id = tree.doc_id and par.container_id = tree.sec_id union all select tree.doc_id, root, lower(txt) from tree join sec using (doc_id, sec_id)),
e as (select unnest([{_texts(catalogue.INTRO_ELEMENTS)}]) as e)
select doc_id, 'warning' as severity, 'section[' || root || ']' as location, e as detail from t, e group by doc_id, root, e having not coalesce(bool_or(contains(t, e)), false)""",
    "rule_i03": _caption("figure", "Рисунок", "Рис(?:унок)?", True),
    "rule_b03": _caption("table", "Таблица", "Таблица", False),
    "rule_i04": f"""{_CURRENT} select distinct bt.doc_id, 'warning' as severity, 'figure[' || bt.block_id || ']' as location, cast(run.size_pt as varchar) as detail from bt {_RUNS} where block_type = 'figure' and kind = 'text' and trim(run.text) <> '' and abs(run.size_pt - 12) > 0.1""",
    "rule_t12": f"""{_CURRENT}, m as (select doc_id, block_id, len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)? (?:(?:{_NAMES})(?:{_W}|$)|(?:{_SIGNS}))')) as n from par)
select doc_id, 'info' as severity, 'paragraph[' || block_id || ']' as location, cast(n as varchar) as detail from m where n > 0""",
    "rule_u01": _each(f"(\\d+ (?:{_UNIT})){_EDGE}", "warning"),
    "rule_u02": _each(f"(\\d+[.,](?:{_UNIT})){_EDGE}", "error"),
    "rule_c04": f"""{_CURRENT}, {_CITED}, n as (select doc_id, count(*) as n from bib group by doc_id)
select cite.doc_id, 'error' as severity, 'paragraph[' || block_id || ']' as location, cast(num as varchar) as detail from cite left join n using (doc_id) where num < 1 or num > coalesce(n.n, 0)""",
    "rule_c05": f"""{_CURRENT}, a as (select doc_id, upper(regexp_extract(txt, '^\\s*Приложение\\s+([A-Za-zА-ЯЁа-яё])(?:{_W}|$)', 1)) as l from sec where lvl = 1 and regexp_matches(txt, '(?i)^\\s*Приложение(?:{_W}|$)')),
m as (select doc_id, block_id, upper(unnest(regexp_extract_all(text || ' ', '(?i)(?:приложени[еияй]|прил\\.)\\s+([А-Яа-яЁё]){_W}', 1))) as l from {_PLAIN})
select doc_id, 'error' as severity, 'paragraph[' || block_id || ']' as location, l as detail from m where not exists (select 1 from a where a.doc_id = m.doc_id and a.l = m.l)""",
    "rule_r05": f"""{_CURRENT}, said as (select doc_id, try_cast(unnest(regexp_extract_all(text, '\\[\\s*(\\d+)\\s*[,\\-–\\]:]', 1)) as int) as num from par
union all select par.doc_id, bib.ordinal from par {_RUNS} join bib on bib.doc_id = par.doc_id and bib.entry_id = trim(run.source_id) where run.kind = 'citation')
select doc_id, 'warning' as severity, 'bibliography[' || entry_id || ']' as location, cast(ordinal as varchar) as detail from bib where not exists (select 1 from said where said.doc_id = bib.doc_id and said.num = bib.ordinal)""",
    "rule_r10": f"""{_CURRENT}, y as (select doc_id, case when regexp_matches(trim({_F('year')}), '^[+-]?\\d+$') then try_cast(trim({_F('year')}) as int) end as y from bib),
s as (select doc_id, avg(case when y >= 2015 then 1.0 else 0.0 end) as share from y where y is not null group by doc_id)
select doc_id, 'warning' as severity, 'bibliography' as location, cast(cast(round(share, 6) as double) as varchar) as detail from s where share < 0.5""",
    "rule_v02": f"""{_CURRENT}, root as (select doc_id, sec_id as root, h from (select *, {_NORM} as h, row_number() over (partition by doc_id, {_NORM} order by sec_ord, sec_id) k from sec where lvl = 1 and {_NORM} in ('введение', 'заключение')) where k = 1),
below as (select distinct doc_id, sec_id, unnest(list_append(coalesce(sec_path, []), sec_id)) as root from sec),
shown as (select doc_id, block_id, coalesce(string_agg(case when kind in ('text', 'xref') then coalesce(text, '') end, '' order by run_ord nulls first, run_id), '') as t from run group by doc_id, block_id),
w as (select bt.doc_id, container_id as sec_id, sum(len(list_filter(regexp_split_to_array(coalesce(t, ''), '[\\s\\p{{Z}}]+'), lambda x: x <> ''))) as n from bt left join shown using (doc_id, block_id) where block_type in ('paragraph', 'table') group by all),
v as (select root.doc_id, root.root, h, cast(coalesce(sum(n), 0) as bigint) as n from root join below using (doc_id, root) left join w on w.doc_id = root.doc_id and w.sec_id = below.sec_id group by all)
select doc_id, 'warning' as severity, 'section[' || root || ']' as location, cast(n as varchar) as detail from v where n < case h when 'введение' then 800 else 500 end or n > case h when 'введение' then 1500 else 1200 end""",
    "rule_v04": f"""{_CURRENT}, shown as (select doc_id, block_id, coalesce(string_agg(case when kind in ('text', 'xref') then coalesce(text, '') end, '' order by run_ord nulls first, run_id), '') as t from run group by doc_id, block_id),
w as (select bt.doc_id, sum(case when block_type in ('paragraph', 'table') then len(list_filter(regexp_split_to_array(coalesce(t, ''), '[\\s\\p{{Z}}]+'), lambda x: x <> '')) else 0 end) as n, count(*) filter (block_type = 'figure') as f, count(*) filter (block_type = 'table') as tb from bt left join shown using (doc_id, block_id) group by bt.doc_id),
d as (select docs.doc_id, greatest(coalesce(n, 0) / 250.0 / 10, 1.0) as tens, coalesce(f, 0) as f, coalesce(tb, 0) as tb from docs left join w using (doc_id))
select doc_id, 'info' as severity, 'document' as location, 'figures' as detail from d where f < tens union all select doc_id, 'info', 'document', 'tables' from d where tb < tens""",
    "rule_x02": f"""{_CURRENT}, shown as (select doc_id, block_id, coalesce(string_agg(case when kind in ('text', 'xref') then coalesce(text, '') end, '' order by run_ord nulls first, run_id), '') as t from run group by doc_id, block_id),
m as (select par.doc_id, par.block_id, regexp_extract(' ' || t || ' ', '(?i){_W}({"|".join(catalogue.FIRST_PERSON)}){_W}', 1) as w from par join shown using (doc_id, block_id))
select doc_id, 'warning' as severity, 'paragraph[' || block_id || ']' as location, w as detail from m where w <> ''""",
    "rule_x07": f"""{_CURRENT}, s as (select doc_id, block_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+([А-ЯA-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as s from par),
n as (select doc_id, block_id, len(list_filter(regexp_split_to_array(s, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) as n from s)
select doc_id, 'info' as severity, 'paragraph[' || block_id || ']' as location, cast(n as varchar) as detail from n where n > 35""",
    "rule_x08": f"""{_CURRENT}, w as (select doc_id, block_id, list_filter(list_transform(regexp_extract_all(text, '[А-Яа-яёЁA-Za-z]+'), lambda x: lower(x)), lambda x: length(x) >= 4 and x not in ({_texts(catalogue.STOP_WORDS)})) as k from par where cat not in ('heading', 'caption') or lower(style_name) like 'название%'),
u as (select doc_id, block_id, unnest(k) as word, generate_subscripts(k, 1) as i from w), g as (select *, i - lag(i) over (partition by doc_id, block_id, word order by i) as gap from u)
select distinct doc_id, 'info' as severity, 'paragraph[' || block_id || ']' as location, word as detail from g where gap < 3""",
    "rule_k01": f"""{_CURRENT}, h as (select doc_id, regexp_replace({_NORM}, '\\.+$', '') as n from sec where lvl = 1),
k as (select distinct doc_id, case when n = 'титульный лист' then 'title' when starts_with(n, 'приложение') then 'appendix' when n in ({_texts(catalogue.FRONT)}) or starts_with(n, 'задание') then 'frontmatter' when n <> '' then 'main' end as k from h),
t as (select doc_id, unnest(['title', 'frontmatter', 'frontmatter', 'main', 'appendix']) as k from docs)
select doc_id, 'error' as severity, 'page_sections' as location, 'absent ' || k as detail from t where not exists (select 1 from k where k.doc_id = t.doc_id and k.k = t.k)""",
    "rule_a01": f"""{_CURRENT}, t as (select doc_id, block_id, block_ord, unnest(p) as p, generate_subscripts(p, 1) as i, p as pieces from (select doc_id, block_id, block_ord, string_split(regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from par)),
u as (select doc_id, block_id, block_ord, i, split_part(p, chr(2), 1) as w, replace(array_to_string(pieces[i + 1:], ''), chr(2), '') as rest, split_part(p, chr(2), 2) as gap, replace(array_to_string(pieces[:i - 1], ''), chr(2), '') as before from t where i > 1),
f as (select doc_id, w, arg_min((block_id, gap || rest, before), (block_ord, block_id, i)) as f from u where regexp_full_match(w, '[A-ZА-ЯЁ]{{2,10}}') and w not in ({_texts(catalogue.KNOWN_ABBREVIATIONS)}) group by doc_id, w)
select doc_id, 'warning' as severity, 'paragraph[' || f[1] || ']' as location, w as detail from f where not regexp_matches(f[2], '^[\\s\\p{{Z}}]*\\([^)]*[^\\s\\p{{Z}})][^)]*\\)') and not regexp_matches(f[3], '[A-Za-zА-Яа-яЁё][\\s\\p{{Z}}]*\\([\\s\\p{{Z}}]*$')""",
    "rule_t07": f"""{_CURRENT}, e as (select *, trim(text) = '' as hollow, row_number() over (partition by doc_id, container_id order by block_ord, block_id) - row_number() over (partition by doc_id, container_id, trim(text) = '' order by block_ord, block_id) as g from par)
select doc_id, 'warning' as severity, 'paragraph[' || arg_min(block_id, (block_ord, block_id)) || ']' as location, cast(count(*) as varchar) as detail from e where hollow group by doc_id, container_id, g having count(*) > 1""",
    "rule_a02": f"""{_CURRENT}, w as (select doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) as w from par), n as (select doc_id, count(distinct w) as n from w where regexp_full_match(w, '[A-ZА-ЯЁ]{{2,10}}') group by doc_id)
select doc_id, 'warning' as severity, 'document' as location, cast(n as varchar) as detail from n where n > 0 and not exists (select 1 from sec where sec.doc_id = n.doc_id and regexp_matches({_NORM}, 'список сокращений|перечень сокращений|обозначения и сокращения'))""",
    "rule_i11": _o("figure", "regexp_extract(trim(text), '^Рис(?:унок)?\\s+\\d+(?:\\.\\d+)?\\s*([—–-])\\s*\\S', 1) not in ('', '–')", "info", "regexp_extract(trim(text), '^Рис(?:унок)?\\s+\\d+(?:\\.\\d+)?\\s*([—–-])\\s*\\S', 1)"),
    "rule_b12": _o("table", "regexp_extract(trim(text), '^Таблица\\s+\\d+(?:\\.\\d+)?\\s*([—–-])\\s*\\S', 1) not in ('', '–')", "info", "regexp_extract(trim(text), '^Таблица\\s+\\d+(?:\\.\\d+)?\\s*([—–-])\\s*\\S', 1)"),
    "rule_x06": f"""{_CURRENT}, n as (select doc_id, block_id, len(regexp_extract_all(text, '(?i)анализ')) + len(regexp_extract_all(text, '(?i)analysis')) + len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x in ({_texts([x for x in catalogue.BUREAUCRATIC if " " not in x and chr(92) not in x])})))
 + len(regexp_extract_all(' ' || text || ' ', '(?i){_W}(?:представляе|представляю)т\\s+собой{_W}')) + len(regexp_extract_all(' ' || text || ' ', '(?i){_W}в\\s+качестве{_W}')) as n from par)
select doc_id, 'info' as severity, 'paragraph[' || block_id || ']' as location, cast(n as varchar) as detail from n where n > 0""",
}


def _nested(sql: str) -> str:
    """A statement of this module as a subquery beside the current tables."""
    rest = sql.replace(_CURRENT, "").replace(_CURRENT.replace("with blk", "with recursive blk"), "").strip()
    return f"(with recursive {rest[1:]})" if rest.startswith(",") else f"({rest})"


def _union_sql() -> str:
    """The findings of all enabled rules with SQL, without what sections disable; the others find nothing in these tables.

    Where a finding lies is read from its location.
    """
    codes = [c for c in sorted(RULES) if c not in catalogue.OFF and name_of(c) in SQL]
    found = "\nunion all ".join(f"select '{c}' as check_code, doc_id, severity, location, cast(detail as varchar) as detail from {_nested(SQL[name_of(c)])}" for c in codes)
    return f"""{_CURRENT}, found as ({found}),
placed as (select f.*, coalesce(b.container_id, case when starts_with(location, 'section[') then location[9:-2] end) as sec
 from found f left join blk b on b.doc_id = f.doc_id and f.location in ('paragraph[' || b.block_id || ']', 'figure[' || b.block_id || ']', 'table[' || b.block_id || ']', 'formula[' || b.block_id || ']') and regexp_extract(f.location, '\\[(.*)\\]$', 1) = b.block_id),
below as (select distinct doc_id, sec_id, unnest(list_append(coalesce(sec_path, []), sec_id)) as up from sec),
quiet as (select distinct below.doc_id, below.sec_id as sec, c.code from below join (select doc_id, sec_id as up, unnest(disabled_checks) as code from sec) c using (doc_id, up))
select doc_id, check_code, severity, location, detail from placed v where not exists (select 1 from quiet q where q.doc_id = v.doc_id and q.sec = v.sec and q.code in ('*', v.check_code))"""


SQL["rule_union"] = _union_sql()
