"""Queries on statistics, reports, comparisons, history and imports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import text_of
from folioscope.operators import bibliography as B
from folioscope.operators import reports as R
from folioscope.operators.engine import Profile, validate, validate_in_parts
from folioscope.operators.fixers import fix
from folioscope.operators import rules as RULE_VALUES
from folioscope.operators.rules import OFF
from folioscope.plans.rules import _CURRENT, rule_union
from folioscope.plans.rules import SQL as RULE_SQL
from folioscope.session import materialize, table
from folioscope.sources.corpus import Corpus, from_tables
from folioscope.sources.imports import from_markdown, from_states, to_html, to_markdown
from folioscope.streaming.check import check_stream, submissions_per_window

_LAYOUT = ["T.01", "T.02", "T.03", "T.04", "T.05", "T.08", "I.08", "I.09"]


def _layout(c: Corpus, spacing: float = 1.5) -> DataFrame:
    return validate(c, Profile(params={"T.01": {"font": "Serif One"}, "T.03": {"line_spacing": spacing}}), codes=_LAYOUT, suppress=False)


def _violations(spark: SparkSession, d: str) -> DataFrame:
    return _layout(from_tables(spark, d))


def _every_violation(spark: SparkSession, d: str) -> DataFrame:
    """What rule_union finds: violations of all enabled rules, without what sections disable."""
    return rule_union(spark, d)


def document_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.document_stats(from_tables(spark, d))


def section_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.section_stats(from_tables(spark, d))


def entry_types(spark: SparkSession, d: str) -> DataFrame:
    return R.entry_types(from_tables(spark, d))


def severity_pivot(spark: SparkSession, d: str) -> DataFrame:
    return R.severity_pivot(_violations(spark, d))


def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.category_rollup(_violations(spark, d))


def top_codes(spark: SparkSession, d: str) -> DataFrame:
    return R.top_codes(_violations(spark, d))


def severity_pivot_all(spark: SparkSession, d: str) -> DataFrame:
    """severity_pivot over all enabled rules."""
    return R.severity_pivot(_every_violation(spark, d))


def category_rollup_all(spark: SparkSession, d: str) -> DataFrame:
    """category_rollup over all enabled rules."""
    return R.category_rollup(_every_violation(spark, d))


def top_codes_all(spark: SparkSession, d: str) -> DataFrame:
    """top_codes over all enabled rules."""
    return R.top_codes(_every_violation(spark, d))


def violation_diff(spark: SparkSession, d: str) -> DataFrame:
    """Violations fixed and introduced when the profile asks for another line spacing."""
    c = from_tables(spark, d)
    c.made["blocks"] = materialize(c.relation("blocks"), "blocks")  # read by both runs
    return R.violation_diff(_layout(c), _layout(c, 1.15))


def violations_by_section(spark: SparkSession, d: str) -> DataFrame:
    """Layout violations counted per top-level section and its number in the document."""
    c = from_tables(spark, d)
    return R.placed(_layout(c), c).groupBy("doc_id", F.col("top").alias("sec_id"), "top_no").agg(F.count("*").alias("violations"))


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Layout violations of every document as lines of Markdown."""
    return R.markdown_report(_violations(spark, d))


def suppress_disabled(spark: SparkSession, d: str) -> DataFrame:
    """Layout violations left after sections switched checks off."""
    return validate(from_tables(spark, d), Profile(params={"T.01": {"font": "Serif One"}}), codes=_LAYOUT)


def profile_values(spark: SparkSession, d: str) -> DataFrame:
    """Names and versions of profiles, taken from the profile they extend where open."""
    return R.inherited(table(spark, d, "profiles"), "profile_id", "extends_id", ["profile_name", "profile_version"])


def history_recent(spark: SparkSession, d: str) -> DataFrame:
    return R.recent(table(spark, d, "submissions"), 50).select("id", "filename", "created_at", "error_count")


def history_by_profile(spark: SparkSession, d: str) -> DataFrame:
    """Submissions, errors and the latest submission per profile; redelivered rows count once."""
    s = table(spark, d, "submissions").distinct()
    return s.groupBy("profile_id").agg(F.count("*").alias("submissions"), F.sum("error_count").alias("errors"), F.max("created_at").alias("latest"))


def states_retained(spark: SparkSession, d: str) -> DataFrame:
    return R.retained(table(spark, d, "builder_states").distinct(), keep=1).select("state_id", "doc_id", "saved_at")


def states_changed(spark: SparkSession, d: str) -> DataFrame:
    return R.changed_versions(table(spark, d, "builder_states").distinct()).select("state_id", "doc_id", "hash")


def history_delete(spark: SparkSession, d: str) -> DataFrame:
    """Submissions left per month after those of uninstalled profiles (extending another) were deleted."""
    gone = table(spark, d, "profiles").where("extends_id is not null").select("profile_id")
    left = R.without(table(spark, d, "submissions").distinct(), gone, ["profile_id"])
    return left.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("submissions"))


def find_replace_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    return t.select("doc_id", R.replace_counts(t, "text", "анализ").alias("hits")).where("hits > 0")


def bib_classify(spark: SparkSession, d: str) -> DataFrame:
    e = from_tables(spark, d).entries
    return e.select("doc_id", "entry_id", B.entry_type(F.coalesce(F.col("fields")["raw"], F.lit(""))).alias("kind"))


def bib_fields(spark: SparkSession, d: str) -> DataFrame:
    e = from_tables(spark, d).entries.where("fields['raw'] is not null")
    f = B.entry_fields(F.col("fields")["raw"])
    return e.withColumn("f", f).select("doc_id", "entry_id", *[F.col("f")[k].alias(k) for k in ("author", "year", "url", "doi", "access_date", "place", "language")])


def autofill_sources(spark: SparkSession, d: str) -> DataFrame:
    """Standards named in the text that the bibliography lacks."""
    return B.missing_sources(from_tables(spark, d), r"СТО\s+\d+(?:\.\d+)*\s*[-–—]\s*\d{4}")


def fix_log(spark: SparkSession, d: str) -> DataFrame:
    """What the fixers change, counted per fixer."""
    _, log = fix(from_tables(spark, d))
    return log.groupBy("fixer_code").agg(F.count("*").alias("changes"))


def fix_spacing(spark: SparkSession, d: str) -> DataFrame:
    c, _ = fix(from_tables(spark, d), codes=["T.03", "T.05"])
    return c.blocks.where("block_type = 'paragraph'").select("doc_id", "block_id", "line_spacing", "alignment")


def _fixed_runs(spark: SparkSession, d: str, codes: list[str]) -> DataFrame:
    """The inline elements of paragraphs after the fixers named."""
    c, _ = fix(from_tables(spark, d), codes=codes)
    return c.blocks.where("block_type = 'paragraph'").select("doc_id", "block_id", F.explode("runs").alias("r"))


def fix_fonts(spark: SparkSession, d: str) -> DataFrame:
    """Fonts and sizes of all runs of paragraphs after the fixers of both."""
    return _fixed_runs(spark, d, ["T.01", "T.02"]).select("doc_id", "block_id", "r.run_ord", "r.font", "r.size_pt")


def fix_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all runs of paragraphs after the fixers of blanks, dashes, quotation marks and initials."""
    return _fixed_runs(spark, d, ["T.08", "T.09", "T.10", "T.11", "T.13"]).where("r.kind = 'text'").select("doc_id", "block_id", "r.run_ord", "r.text")


def fix_units(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all runs of paragraphs after the fixers of numbers and their units."""
    return _fixed_runs(spark, d, ["T.12", "U.01", "U.02"]).where("r.kind = 'text'").select("doc_id", "block_id", "r.run_ord", "r.text")


def fix_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Headings after their fixers: numbered in order, without full stops at the end."""
    c, _ = fix(from_tables(spark, d), codes=["H.03", "H.04", "H.08"])
    return c.secs.select("doc_id", "sec_id", text_of("heading").alias("heading"))


def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty lines of the document texts, in place."""
    t = table(spark, d, "documents")
    lines = t.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where("line <> ''").select("doc_id", "line_no", F.length("line").alias("chars"))


def import_markdown(spark: SparkSession, d: str) -> DataFrame:
    c = from_markdown(spark, table(spark, d, "documents").select("doc_id", "text"))
    return c.blocks.groupBy("doc_id", "block_type").agg(F.count("*").alias("blocks"))


def import_states(spark: SparkSession, d: str) -> DataFrame:
    """Violations of all enabled rules in the saved states, counted per rule."""
    c = from_states(spark, table(spark, d, "builder_states")).written()
    return validate_in_parts(c, Profile(disabled=set(OFF))).groupBy("check_code").agg(F.count("*").alias("violations"))


def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    return to_markdown(from_tables(spark, d))


def export_html(spark: SparkSession, d: str) -> DataFrame:
    return to_html(from_tables(spark, d))


def stream_check(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form of the row-local rules, over the blocks at rest."""
    return check_stream(from_tables(spark, d).blocks, ["T.03", "T.05", "T.08"]).groupBy("check_code").agg(F.count("*").alias("violations"))


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming window counts, over the submissions at rest."""
    s = table(spark, d, "submissions").where("created_at is not null").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return submissions_per_window(s).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "profile_id", "submissions", "errors")


_ALL = (
    document_stats, section_stats, entry_types, severity_pivot, category_rollup, top_codes, severity_pivot_all, category_rollup_all, top_codes_all, violation_diff, violations_by_section, report_markdown, suppress_disabled, profile_values, history_recent,
    history_by_profile, states_retained, states_changed, history_delete, find_replace_counts, bib_classify, bib_fields, autofill_sources, fix_log, fix_spacing, fix_fonts, fix_spaces, fix_units, fix_numbering,
    scan_lines, import_markdown, import_states, export_markdown, export_html, stream_check, window_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

_V = f"""{_CURRENT}, v as (
select doc_id, 'T.01' as check_code, 'error' as severity, 'paragraph[' || block_id || ']' as location, run.font as detail, container_id as sec from par join run using (doc_id, block_id) where run.kind = 'text' and trim(run.text) <> '' and cat <> 'header_footer' and run.font <> 'Serif One'
union all select doc_id, 'T.02', 'error', 'paragraph[' || block_id || ']', cast(run.size_pt as varchar), container_id from par join run using (doc_id, block_id) where run.kind = 'text' and trim(run.text) <> '' and abs(run.size_pt - case cat when 'body' then 14 when 'caption' then 12 when 'footnote' then 10 end) > 0.1
union all select doc_id, 'T.03', 'error', 'paragraph[' || block_id || ']', cast(line_spacing as varchar), container_id from par where cat = 'body' and abs(line_spacing - 1.5) > 0.01
union all select doc_id, 'T.04', 'error', 'paragraph[' || block_id || ']', cast(first_line_indent_cm as varchar), container_id from par where cat = 'body' and abs(first_line_indent_cm - 1.25) > 0.05
union all select doc_id, 'T.05', 'error', 'paragraph[' || block_id || ']', alignment, container_id from par where cat = 'body' and alignment <> 'justify'
union all select doc_id, 'T.08', 'warning', 'paragraph[' || block_id || ']', '', container_id from par where cat <> 'header_footer' and exists (select 1 from run where run.doc_id = par.doc_id and run.block_id = par.block_id and kind = 'text' and regexp_matches(run.text, '  +'))
union all select doc_id, 'I.08', 'warning', 'figure[' || block_id || ']', cast(dpi as varchar), container_id from bt where block_type = 'figure' and dpi < 150
union all select doc_id, 'I.09', 'warning', 'figure[' || block_id || ']', alignment, container_id from bt where block_type = 'figure' and alignment <> 'center')
"""
_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> ''))"
_SHOWN = "trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) <> ''"
_B = f"""count(*) filter (block_type = 'paragraph') as paragraphs, count(*) filter (block_type = 'paragraph' and {_SHOWN}) as nonempty_paragraphs, count(*) filter (block_type = 'figure') as figures,
count(*) filter (block_type = 'table') as tables, count(*) filter (block_type = 'formula') as formulas, count(*) filter (block_type = 'list') as lists,
cast(sum(case when block_type = 'paragraph' then {_WORDS} else 0 end) as bigint) as words, cast(sum(case when block_type = 'paragraph' and {_SHOWN} then length(text) else 0 end) as bigint) as chars,
cast(0 as bigint) as list_items, {", ".join(f"count(*) filter (block_type = 'paragraph' and has_{k}) as paragraphs_with_{k}" for k in ("formula", "xref", "citation"))}"""
_KINDS = f"""kinds as (select doc_id, block_id, {", ".join(f"bool_or(kind = '{k}') as has_{k}" for k in ("formula", "xref", "citation"))} from run group by all),
bk as (select bt.*, kinds.* exclude (doc_id, block_id) from bt left join kinds using (doc_id, block_id))"""
_SUB = "(select distinct id, filename, profile_id, created_at, received_at, error_count, warning_count, info_count from submissions)"
_RAW = "coalesce(entry_fields['raw'], '')"
_N = "[^\\p{L}\\p{N}_]"

SQL = {
    "document_stats": f"""{_CURRENT}, {_KINDS}, b as (select doc_id, {_B} from bk group by doc_id),
s as (select doc_id, count(*) as sections, count(*) filter (lvl = 1) as sections_1, count(*) filter (lvl = 2) as sections_2, count(*) filter (lvl = 3) as sections_3 from sec group by doc_id),
e as (select doc_id, count(*) as entries from bib group by doc_id)
select doc_id, coalesce(paragraphs, 0) as paragraphs, coalesce(nonempty_paragraphs, 0) as nonempty_paragraphs, coalesce(figures, 0) as figures, coalesce(tables, 0) as tables, coalesce(formulas, 0) as formulas, coalesce(lists, 0) as lists,
coalesce(words, 0) as words, coalesce(chars, 0) as chars, coalesce(sections, 0) as sections, coalesce(sections_1, 0) as sections_1, coalesce(sections_2, 0) as sections_2, coalesce(sections_3, 0) as sections_3, coalesce(entries, 0) as entries,
coalesce(list_items, 0) as list_items, coalesce(paragraphs_with_formula, 0) as paragraphs_with_formula, coalesce(paragraphs_with_xref, 0) as paragraphs_with_xref, coalesce(paragraphs_with_citation, 0) as paragraphs_with_citation, cast(0 as bigint) as page_sections,
coalesce(round(case when nonempty_paragraphs > 0 then words / nonempty_paragraphs end, 1), 0.0) as words_per_paragraph from docs left join b using (doc_id) left join s using (doc_id) left join e using (doc_id)""",
    "section_stats": f"""{_CURRENT}, {_KINDS}, h as (select doc_id, sec_id as container_id, coalesce(sec_path[1], sec_id) as top from sec),
b as (select bk.doc_id, top, {_B} from bk left join h using (doc_id, container_id) group by bk.doc_id, top),
t as (select doc_id, sec_id as top from sec where lvl = 1), f as (select coalesce(b.doc_id, t.doc_id) as doc_id, coalesce(b.top, t.top) as top, b.* exclude (doc_id, top) from b full join t on t.doc_id = b.doc_id and t.top = b.top)
select f.doc_id, f.top as sec_id, sec.txt as heading, sec.sec_ord, {", ".join(f"coalesce({x}, 0) as {x}" for x in R._COUNTERS)} from f left join sec on sec.doc_id = f.doc_id and sec.sec_id = f.top""",
    "entry_types": f"{_CURRENT} select doc_id, entry_type, count(*) as entries from bib group by all",
    "severity_pivot": f"{_V} select doc_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos, count(*) as total from v group by doc_id",
    "category_rollup": f"{_V}, c as (select doc_id, split_part(check_code, '.', 1) as category from v) select doc_id, category, count(*) as violations, grouping(doc_id) * 2 + grouping(category) as level from c group by rollup (doc_id, category)",
    "top_codes": f"{_V} select check_code, count(*) as violations from v group by check_code order by violations desc, check_code limit 5",
    "suppress_disabled": f"""{_V}, below as (select distinct doc_id, sec_id, unnest(list_append(coalesce(sec_path, []), sec_id)) as up from sec),
quiet as (select distinct below.doc_id, below.sec_id as sec, c.code from below join (select doc_id, sec_id as up, unnest(disabled_checks) as code from sec) c using (doc_id, up))
select doc_id, check_code, severity, location, detail from v where not exists (select 1 from quiet q where q.doc_id = v.doc_id and q.sec = v.sec and q.code in ('*', v.check_code))""",
    "profile_values": """with recursive c(profile_id, up, n, v, k) as (select profile_id, extends_id, profile_name, profile_version, 0 from profiles
union all select c.profile_id, p.extends_id, coalesce(c.n, p.profile_name), coalesce(c.v, p.profile_version), c.k + 1 from c join profiles p on p.profile_id = c.up where c.k < 31)
select profile_id, arg_max(n, k) as profile_name, arg_max(v, k) as profile_version from c group by profile_id""",
    "history_recent": f"select id, filename, created_at, error_count from {_SUB} order by created_at desc nulls last, id desc limit 50",
    "history_by_profile": f"select profile_id, count(*) as submissions, cast(sum(error_count) as bigint) as errors, max(created_at) as latest from {_SUB} group by profile_id",
    "states_retained": "select state_id, doc_id, saved_at from (select *, row_number() over (partition by doc_id order by saved_at desc nulls last, state_id desc) k from (select distinct * from builder_states)) where k = 1",
    "states_changed": "select state_id, doc_id, hash from (select *, lag(hash) over (partition by doc_id order by saved_at nulls first, state_id) b from (select *, sha256(coalesce(payload, '')) as hash from (select distinct * from builder_states))) where hash is distinct from b",
    "history_delete": f"select strftime(created_at, '%Y-%m') as month, count(*) as submissions from {_SUB} s where not exists (select 1 from profiles p where p.extends_id is not null and p.profile_id = s.profile_id) group by 1",
    "find_replace_counts": "select doc_id, cast((length(text) - length(replace(text, 'анализ', ''))) / 6 as int) as hits from documents where contains(text, 'анализ')",
    "bib_fields": f"""{_CURRENT} select doc_id, entry_id, coalesce(nullif(regexp_extract({_RAW}, '^[А-ЯЁ][а-яё]+\\s[А-ЯЁ]\\.\\s?[А-ЯЁ]\\.'), ''), nullif(regexp_extract({_RAW}, '^[A-Z][a-z]+,?\\s[A-Z]\\.\\s?[A-Z]\\.'), '')) as author,
nullif(regexp_extract({_RAW}, '(?:^|[^\\p{{L}}\\p{{N}}_])((?:19|20)\\d{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), '') as year, nullif(rtrim(regexp_extract({_RAW}, 'https?://\\S+'), ').,;'), '') as url,
nullif(rtrim(regexp_extract({_RAW}, '10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), ').,;'), '') as doi, nullif(regexp_extract({_RAW}, '(?i)дата\\s+обращения:\\s*(\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}})', 1), '') as access_date,
nullif(regexp_extract({_RAW}, '—\\s*([А-ЯЁ][а-яё]+(?:[ -][А-ЯЁ][а-яё]+)?)\\s*:', 1), '') as place,
case when regexp_matches({_RAW}, '^[А-ЯЁа-яё]') then 'ru' when regexp_matches({_RAW}, '^[A-Za-z]') then 'en' end as language from bib where entry_fields['raw'] is not null""",
    "bib_classify": f"""{_CURRENT}, r as (select doc_id, entry_id, {_RAW} as raw, ' ' || {_RAW} || ' ' as pad from bib)
select doc_id, entry_id, case when regexp_matches(raw, '(?i)https?://') then 'web' when regexp_matches(pad, '{_N}ГОСТ{_N}') then 'standard'
when regexp_matches(pad, '(?i){_N}(дис\\.|диссертация{_N}|автореф\\.)') then 'thesis' when regexp_matches(pad, '(?i){_N}(конференция{_N}|материалы{_N}|сб\\.\\s*ст\\.)') then 'conference'
when regexp_matches(pad, '(?i){_N}(закон{_N}|федер\\.\\s*закон{_N}|постановление{_N})') then 'law' when regexp_matches(raw, '(^|\\s)//\\s|журн\\.|№') or regexp_matches(pad, '{_N}(Журнал{_N}|No\\.)') then 'article' else 'book' end as kind from r""",
    "fix_spacing": f"{_CURRENT} select doc_id, block_id, case when cat = 'body' and abs(line_spacing - 1.5) > 0.01 then 1.5 else line_spacing end as line_spacing, case when cat = 'body' and alignment <> 'justify' then 'justify' else alignment end as alignment from par",
    "scan_lines": "select doc_id, line_no - 1 as line_no, length(line) as chars from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents)) where line <> ''",
    "violation_diff": f"""{_V}, now as (select distinct doc_id, check_code, severity, location, detail from v),
later as (select doc_id, check_code, severity, location, detail from now where check_code <> 'T.03'
union select doc_id, 'T.03', 'error', 'paragraph[' || block_id || ']', cast(line_spacing as varchar) from par where cat = 'body' and abs(line_spacing - 1.15) > 0.01)
select change, doc_id, check_code, location, print, severity from (
select 'fixed' as change, doc_id, check_code, location, lower(detail) as print, severity from now n where not exists (select 1 from later t where (t.doc_id, t.check_code, t.location, t.detail) = (n.doc_id, n.check_code, n.location, n.detail))
union all select 'introduced', doc_id, check_code, location, lower(detail), severity from later t where not exists (select 1 from now n where (t.doc_id, t.check_code, t.location, t.detail) = (n.doc_id, n.check_code, n.location, n.detail)))""",
    "window_counts": f"""select start, profile_id, count(*) as submissions, cast(sum(error_count) as bigint) as errors from (select time_bucket(interval 7 days, created_at, timestamp '1970-01-01') as start, profile_id, error_count from {_SUB} where created_at is not null) group by all""",
    "stream_check": f"{_V} select check_code, count(*) as violations from v where check_code in ('T.03', 'T.05', 'T.08') group by check_code",
    "autofill_sources": f"""{_CURRENT}, m as (select doc_id, block_ord, unnest(regexp_extract_all(text, 'СТО\\s+\\d+(?:\\.\\d+)*\\s*[-–—]\\s*\\d{{4}}')) as s, 0 as law, generate_subscripts(regexp_extract_all(text, 'СТО\\s+\\d+(?:\\.\\d+)*\\s*[-–—]\\s*\\d{{4}}'), 1) as pos from par
union all select doc_id, block_ord, unnest(regexp_extract_all(text, '(?i)(?:№\\s*)?(\\d{{1,4}})\\s*[-–—]\\s*ФЗ', 1)) || '-ФЗ', 1, generate_subscripts(regexp_extract_all(text, '(?i)(?:№\\s*)?(\\d{{1,4}})\\s*[-–—]\\s*ФЗ', 1), 1) from par),
t as (select doc_id, regexp_replace(regexp_replace(s, '\\s*[-–—]\\s*', '-', 'g'), '\\s+', ' ', 'g') as source, min((block_ord, pos)) as place from m group by all),
raws as (select doc_id, regexp_replace(regexp_replace({_RAW}, '\\s*[-–—]\\s*', '-', 'g'), '\\s+', ' ', 'g') as raw from bib),
have as (select doc_id, unnest(regexp_extract_all(raw, 'СТО\\s+\\d+(?:\\.\\d+)*\\s*[-–—]\\s*\\d{{4}}')) as source from raws union select doc_id, unnest(regexp_extract_all(raw, '(?i)(?:№\\s*)?(\\d{{1,4}})\\s*[-–—]\\s*ФЗ', 1)) || '-ФЗ' from raws),
new as (select * from t where not exists (select 1 from have h where h.doc_id = t.doc_id and h.source = t.source)), l as (select doc_id, max(ordinal) as m from bib group by doc_id)
select new.doc_id, source, cast(coalesce(l.m, 0) + row_number() over (partition by new.doc_id order by place, source) as int) as ordinal from new left join l using (doc_id)""",
}

_SEVERITIES = "select doc_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos, count(*) as total from v group by doc_id"
_ROLLUP = "select doc_id, category, count(*) as violations, grouping(doc_id) * 2 + grouping(category) as level from (select doc_id, split_part(check_code, '.', 1) as category from v) c group by rollup (doc_id, category)"
_TOP = "select check_code, count(*) as violations from v group by check_code order by violations desc, check_code limit 5"
SQL |= {f"{name}_all": f"with v as ({RULE_SQL['rule_union']}) {tail}" for name, tail in (("severity_pivot", _SEVERITIES), ("category_rollup", _ROLLUP), ("top_codes", _TOP))}


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _export_sql(bold: str, italic: str, both: str, formula: str, html: bool, tail: str) -> str:
    """The elements of each document in order, as (doc_id, sec_ord, o, id, x), and what is made of them.

    The tables hold no lists and no cells, so these are not restated.
    """
    safe = _esc if html else (lambda x: x)
    put = lambda form, x: " || ".join(("'" + part + "'") for part in form.split("%s")).replace(" || ", f" || {x} || ", 1)
    t = safe("coalesce(text, '')")
    cited = safe("'[' || coalesce(source_id, '') || case when coalesce(pages, '') <> '' then ', с. ' || pages else '' end || ']'")
    referred = safe("coalesce(prefix, '') || '[→' || coalesce(target_id, '') || ']'")
    other = f"case when kind = 'formula' then {put(formula, t)} when kind = 'citation' then {cited} when kind = 'xref' then {referred}"
    styled = f"{other} when {t} = '' then '' when bold and italic then {put(both, t)} when bold then {put(bold, t)} when italic then {put(italic, t)} else {t} end"
    plain = f"{other} else {t} end"
    shown = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')) <> ''"
    latex = safe("coalesce(latex, '')")
    if html:
        block = f"""case block_type when 'paragraph' then case when {shown.format('s')} then '<p>' || s || '</p>' end when 'table' then '<table>' || case when s <> '' then '<caption>' || s || '</caption>' else '' end || '</table>'
when 'figure' then '<figure>' || case when s <> '' then '<figcaption>' || s || '</figcaption>' else '' end || '</figure>' when 'formula' then '<div class="formula">$$ ' || {latex} || ' $$</div>' when 'toc' then '<nav class="toc">' || s || '</nav>' else case when {shown.format('s')} then '<div>' || s || '</div>' end end"""
        head = f"'<h' || least(lvl, 6) || '>' || {_esc('txt')} || '</h' || least(lvl, 6) || '>'"
        entry, before, after = f"'<li>' || {_esc('src')} || '</li>'", "'<ol class=\"bibliography\">' || chr(10) || ", " || chr(10) || '</ol>'"
    else:
        block = f"case block_type when 'figure' then '![' || p || ']()' when 'formula' then '$$' || {latex} || '$$' when 'table' then case when p <> '' then '**' || p || '**' else '' end else s end"
        head, entry, before, after = "repeat('#', least(lvl, 6)) || ' ' || txt", "nth || '. ' || src", "", ""
    return f"""{_CURRENT}, r as (select distinct doc_id, block_id, run_id, run_ord, kind, text, bold, italic, target_id, prefix, source_id, pages from runs where block_id is not null),
line as (select doc_id, block_id, string_agg({styled}, '' order by run_ord nulls first, run_id) as s, string_agg({plain}, '' order by run_ord nulls first, run_id) as p from r group by all),
b as (select bt.doc_id, container_id, block_ord, block_id, block_type, latex, coalesce(s, '') as s, coalesce(p, '') as p from bt left join line using (doc_id, block_id)),
src as (select doc_id, ordinal, entry_id, coalesce(case when {shown.format("coalesce(entry_fields['raw'], '')")} then entry_fields['raw'] end, array_to_string(map_values(map_from_entries(list_filter(map_entries(entry_fields), lambda e: e.key <> 'raw'))), '. '), '') as src from bib),
num as (select *, row_number() over (partition by doc_id order by ordinal, entry_id, src) as nth from src),
lst as (select doc_id, {before}string_agg({entry}, chr(10) order by nth){after} as x from num group by doc_id),
place as (select doc_id, min(sec_ord) as sec_ord from sec where lower(trim(regexp_replace(txt, '[\\s\\p{{Z}}]+', ' ', 'g'))) in ('список использованных источников', 'список литературы', 'библиографический список', 'список источников') group by doc_id),
e as (select doc_id, sec_ord, -1 as o, sec_id as id, {head} as x from sec
 union all select b.doc_id, coalesce(sec.sec_ord, 0), block_ord, block_id, {block} from b left join sec on sec.doc_id = b.doc_id and sec.sec_id = b.container_id
 union all select lst.doc_id, coalesce(place.sec_ord, 2147483647), 2147483647, '', x from lst left join place using (doc_id)),
y as (select * from e where x is not null) {tail}"""


SQL["export_html"] = _export_sql("<strong>%s</strong>", "<em>%s</em>", "<strong><em>%s</em></strong>", "\\(%s\\)", True, "select doc_id, string_agg(x, chr(10) order by sec_ord, o, id, x) as html from y group by doc_id")
SQL["export_markdown"] = _export_sql(
    "**%s**", "*%s*", "***%s***", "$%s$", False,
    ", z as (select *, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) as part from y) select doc_id, cast(row_number() over (partition by doc_id order by sec_ord, o, id, x, part) as int) as line_no, line from z",
)

# Fixers restated. A number joins its unit, and initials the name, by a blank that does not break.
_KIND = "case when lower(coalesce(style_name, '')) like 'caption%' or lower(coalesce(style_name, '')) like 'название%' then 'caption' when lower(style_name) = 'footnote text' then 'footnote' when lower(style_name) in ('header', 'footer') then 'header_footer' when lower(coalesce(style_name, '')) like 'heading%' or lower(style_name) in ('title', 'subtitle') then 'heading' else 'body' end"
_PAR_RUNS = f"""{_CURRENT}, r as (select distinct doc_id, block_id, run_id, run_ord, kind, text, font, size_pt from runs where block_id is not null),
pr as (select r.*, {_KIND} as fcat from r join par using (doc_id, block_id))"""
_UNITS = "|".join(re.escape(u) for u in RULE_VALUES.TEXT_UNITS)
_SI = "|".join(re.escape(u) for u in sorted(RULE_VALUES.SI_UNITS, key=len, reverse=True))
_STRUCTURAL = ", ".join(f"'{x}'" for x in RULE_VALUES.STRUCTURAL)
_BARE = "regexp_replace({0}, '(?i)^(?:(?:глава|раздел|часть)\\s+)?\\d+(?:\\.\\d+)*\\.?\\s+', '')"
SQL |= {
    "fix_fonts": f"""{_PAR_RUNS} select doc_id, block_id, run_ord, case when kind = 'text' and trim(text) <> '' and fcat <> 'header_footer' and font <> 'Times New Roman' then 'Times New Roman' else font end as font,
case when kind = 'text' and trim(text) <> '' and abs(size_pt - case fcat when 'body' then 14 when 'caption' then 12 when 'footnote' then 10 end) > 0.1 then case fcat when 'body' then 14 when 'caption' then 12 when 'footnote' then 10 end else size_pt end as size_pt from pr""",
    "fix_spaces": f"""{_PAR_RUNS}, a as (select * replace (case when fcat <> 'header_footer' then regexp_replace(text, '  +', ' ', 'g') else text end as text) from pr where kind = 'text'),
b as (select *, row_number() over (partition by doc_id, block_id, coalesce(text, '') <> '' order by run_ord desc nulls last, run_id desc) as back, count(*) filter (coalesce(text, '') <> '') over (partition by doc_id, block_id) as shown from a),
c as (select * replace (case when back = 1 and coalesce(text, '') <> '' and fcat <> 'header_footer' then regexp_replace(text, '[\\s\\p{{Z}}]+$', '') else text end as text) from b),
t as (select *, count(*) filter (coalesce(text, '') <> '') over w as visible_, sum(length(text) - length(replace(text, '"', ''))) over w as marks from c window w as (partition by doc_id, block_id)),
q as (select * replace (case when visible_ = 1 and marks % 2 = 0 then regexp_replace(text, '"([^"]*)"', '«\\1»', 'g') else text end as text) from t),
h as (select * replace (case when visible_ = 1 then replace(text, ' - ', ' — ') else text end as text) from q)
select doc_id, block_id, run_ord, regexp_replace(text, '([А-ЯЁ]\\.) ([А-ЯЁ]\\.) ([А-ЯЁ][а-яё]+)', '\\1' || chr(160) || '\\2' || chr(160) || '\\3', 'g') as text from h""",
    "fix_units": f"""{_PAR_RUNS}, a as (select *, regexp_replace(text, '(\\d+(?:[.,]\\d+)?) ({_UNITS})([^\\p{{L}}\\p{{N}}_]|$)', '\\1' || chr(160) || '\\2\\3', 'g') as x from pr where kind = 'text'),
b as (select *, regexp_replace(x, '(\\d+) ({_SI})([\\s.,;:!?)\\]/\\-]|$)', '\\1' || chr(160) || '\\2\\3', 'g') as y from a)
select doc_id, block_id, run_ord, regexp_replace(y, '(\\d+)[.,]({_SI})([\\s.,;:!?)\\]/\\-]|$)', '\\1' || chr(160) || '\\2\\3', 'g') as text from b""",
    "fix_numbering": f"""{_CURRENT}, a as (select *, regexp_replace(txt, '^(\\d+(?:\\.\\d+)*)\\.(\\s)', '\\1\\2') as t1 from sec),
b as (select *, {_BARE.format('t1')} as bare from a), c as (select *, regexp_replace(lower(trim(regexp_replace(bare, '[\\s\\p{{Z}}]+', ' ', 'g'))), '\\.+$', '') as n from b),
d as (select *, n in ({_STRUCTURAL}) or starts_with(n, 'приложение') as st from c), k as (select *, row_number() over (partition by doc_id, parent_id, st order by sec_ord, sec_id) as rank from d),
u as (select doc_id, sec_id, unnest(p) as up, generate_subscripts(p, 1) as i from (select doc_id, sec_id, case when len(coalesce(sec_path, [])) > 0 then sec_path else [sec_id] end as p from d)),
m as (select u.doc_id, u.sec_id, string_agg(cast(k.rank as varchar), '.' order by u.i) as num, bool_or(case when u.up <> u.sec_id then k.st else false end) as inside from u join k on k.doc_id = u.doc_id and k.sec_id = u.up group by all),
o as (select d.*, case when m.num is null or m.inside or trim(bare) = '' or len(coalesce(heading, [])) = 0 then t1 when st then bare else num || ' ' || bare end as t2 from d left join m using (doc_id, sec_id))
select doc_id, sec_id, regexp_replace(t2, '(\\.\\.\\.|\\.|…)([\\s\\p{{Z}}]*)$', '\\2') as heading from o""",
    "import_markdown": """with l as (select doc_id, line, i, case when trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g')) = '' then 'blank' when regexp_matches(line, '^#{1,6}\\s') then 'heading' when regexp_matches(line, '^\\s*[-*+]\\s') then 'bullet' when regexp_matches(line, '^\\s*\\d{1,3}[.)]\\s') then 'number'
when regexp_matches(line, '^\\s*\\|.*\\|\\s*$') then 'table' when regexp_matches(line, '^\\s*\\$\\$') then 'formula' when regexp_matches(line, '^\\s*!\\[[^\\]]*\\]\\([^)]*\\)') then 'image' else 'text' end as kind
from (select doc_id, unnest(s) as line, generate_subscripts(s, 1) as i from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))),
g as (select *, case when kind = lag(kind) over (partition by doc_id order by i) then 0 else 1 end as new from l)
select doc_id, case kind when 'bullet' then 'list' when 'number' then 'list' when 'image' then 'figure' when 'text' then 'paragraph' else kind end as block_type, cast(sum(new) as bigint) as blocks from g where kind not in ('heading', 'blank') group by 1, 2""",
}
SQL |= {
    "violations_by_section": f"""{_V}, p as (select v.doc_id, coalesce(sec_path[1], sec_id) as top from v left join sec on sec.doc_id = v.doc_id and sec.sec_id = v.sec),
o as (select doc_id, sec_id as top, row_number() over (partition by doc_id order by sec_ord, sec_id) - 1 as top_no from sec where lvl = 1)
select p.doc_id, p.top as sec_id, cast(o.top_no as int) as top_no, count(*) as violations from p left join o on o.doc_id = p.doc_id and o.top = p.top group by all""",
    "report_markdown": f"""{_V}, r as (select doc_id, split_part(check_code, '.', 1) as c, 1 as part, check_code, location, detail, '| ' || check_code || ' | ' || severity || ' | ' || replace(location, '|', chr(92) || '|') || ' | ' || replace(coalesce(detail, ''), '|', chr(92) || '|') || ' |' as line from v),
g as (select distinct doc_id, c from r), e as (select * from r union all select doc_id, c, 0, null, null, null, '### ' || c || chr(10) || chr(10) || '| code | severity | location | detail |' || chr(10) || '| --- | --- | --- | --- |' from g
union all select doc_id, c, 2, null, null, null, '' from g union all select distinct doc_id, '', 0, null, null, null, '## ' || doc_id || chr(10) from g),
x as (select *, unnest(string_split(line, chr(10))) as text, generate_subscripts(string_split(line, chr(10)), 1) as k from e)
select doc_id, cast(row_number() over (partition by doc_id order by c, part, check_code nulls first, location nulls first, detail nulls first, k) as int) as line_no, text as line from x""",
}
