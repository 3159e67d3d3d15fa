"""Queries on record integrity and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.nested import read_tables, tagged_rows, write_tables
from folioscope.operators.orphans import Reference, orphan_cascade, orphan_report, records, references
from folioscope.session import fresh_path, once, table

RUN_REFS = [Reference("run", "source_id", "entry"), Reference("run", "target_id", "element")]
ALL_REFS = [
    *RUN_REFS,
    Reference("run", "block_id", "element"),
    Reference("element", "container_id", "element"),
    Reference("element", "parent_id", "element"),
]


def _targets(spark: SparkSession, d: str) -> list[DataFrame]:
    """Bibliography entries, and the blocks and sections of a document, which share one space of keys."""
    blocks = table(spark, d, "blocks").select("doc_id", F.col("block_id").alias("k"), "loaded_at", "is_deleted")
    sections = table(spark, d, "sections").select("doc_id", F.col("sec_id").alias("k"), "loaded_at", "is_deleted")
    return [
        records(table(spark, d, "bibliography"), "entry", "doc_id", "entry_id", "loaded_at", "is_deleted"),
        records(blocks.unionByName(sections), "element", "doc_id", "k", "loaded_at", "is_deleted"),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of runs: the direct layer of the cascade."""
    edges = [references(table(spark, d, "runs"), "doc_id", "run_id", "loaded_at", RUN_REFS)]
    found = orphan_cascade(edges, _targets(spark, d), RUN_REFS).where("level = 0")
    return found.select(
        F.col("key").alias("run_id"), F.col("field").alias("ref_field"), F.date_format("first_loaded", "yyyy-MM").alias("period"), "status"
    )


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of runs, blocks and sections, counted per field and month."""
    runs, blocks, sections = (table(spark, d, t) for t in ("runs", "blocks", "sections"))
    edges = [
        references(runs, "doc_id", "run_id", "loaded_at", ALL_REFS[:3]).withColumn("key", F.col("key").cast("string")),
        references(blocks, "doc_id", "block_id", "loaded_at", ALL_REFS[3:4]),
        references(sections, "doc_id", "sec_id", "loaded_at", ALL_REFS[4:]),
    ]
    return orphan_report(orphan_cascade(edges, _targets(spark, d), ALL_REFS))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return tagged_rows(table(spark, d, "builder_states"), "state_id", "payload", "saved_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per section, block and run nested in the saved states."""
    return _states(spark, d).select("state_id", "node_path", "parent_path", F.col("tag").alias("node_kind"))


def flat_states(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The flat tables of the saved states, by tag; the records are visited once for all queries over them."""
    rows = _states(spark, d)

    def write() -> str:
        write_tables(rows, path := fresh_path(spark, "tagged"))
        return path

    path = once(spark, "p5-tables", [f"{d}/builder_states.parquet"], write)
    return read_tables(spark, path, rows.schema, "state_id")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of runs, with their columns."""
    return flat_states(spark, d)["run"]


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of blocks, with their columns."""
    return flat_states(spark, d)["block"]


def p5_sections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of sections, with their columns."""
    return flat_states(spark, d)["section"]


QUERIES = {f.__name__: f for f in (p4_found, p4_cascade, p5_found, p5_runs, p5_blocks, p5_sections)}

_P4 = """
with r as (select run_id, doc_id, min(loaded_at) as first_loaded, any_value(source_id) as source_id, any_value(target_id) as target_id
           from runs group by run_id, doc_id),
e as (select run_id, doc_id, first_loaded, 'source_id' as ref_field, 'entry' as space, trim(source_id) as ref from r where trim(source_id) <> ''
      union all
      select run_id, doc_id, first_loaded, 'target_id', 'element', trim(target_id) from r where trim(target_id) <> ''),
n as (select 'entry' as space, doc_id, entry_id as ref, min(loaded_at) as target_loaded, arg_max(is_deleted, loaded_at) as gone from bibliography group by doc_id, entry_id
      union all
      select 'element', doc_id, block_id, min(loaded_at), arg_max(is_deleted, loaded_at) from blocks group by doc_id, block_id
      union all
      select 'element', doc_id, sec_id, min(loaded_at), arg_max(is_deleted, loaded_at) from sections group by doc_id, sec_id)
select * from (
  select e.run_id, e.ref_field, strftime(e.first_loaded, '%Y-%m') as period,
         case when n.ref is null then 'missing' when n.gone then 'deleted' when n.target_loaded > e.first_loaded then 'late' end as status
  from e left join n on n.space = e.space and n.doc_id = e.doc_id and n.ref = e.ref) where status is not null
"""

_P4_CASCADE = """
with recursive loads as (
  select 'run' as space, doc_id as scope, cast(run_id as varchar) as key, 'source_id' as field, 'entry' as target, trim(any_value(source_id)) as ref, min(loaded_at) as t from runs group by run_id, doc_id
  union all select 'run', doc_id, cast(run_id as varchar), 'target_id', 'element', trim(any_value(target_id)), min(loaded_at) from runs group by run_id, doc_id
  union all select 'run', doc_id, cast(run_id as varchar), 'block_id', 'element', trim(any_value(block_id)), min(loaded_at) from runs group by run_id, doc_id
  union all select 'element', doc_id, block_id, 'container_id', 'element', trim(arg_min(container_id, loaded_at)), min(loaded_at) from blocks group by block_id, doc_id
  union all select 'element', doc_id, sec_id, 'parent_id', 'element', trim(arg_min(parent_id, loaded_at)), min(loaded_at) from sections group by sec_id, doc_id),
edge as (select * from loads where ref <> ''),
el as (select doc_id, block_id as ref, loaded_at, is_deleted from blocks union all select doc_id, sec_id, loaded_at, is_deleted from sections),
node as (select 'entry' as target, doc_id as scope, entry_id as ref, min(loaded_at) as nt, arg_max(is_deleted, loaded_at) as gone from bibliography group by doc_id, entry_id
  union all select 'element', doc_id, ref, min(loaded_at), arg_max(is_deleted, loaded_at) from el group by doc_id, ref),
direct as (select * from (select e.*, case when n.ref is null then 'missing' when n.gone then 'deleted' when n.nt > e.t then 'late' end as status
  from edge e left join node n on n.target = e.target and n.scope = e.scope and n.ref = e.ref) where status is not null),
reach as (select distinct space, scope, key, 0 as level from direct
  union select e.space, e.scope, e.key, r.level + 1 from edge e join reach r on e.target = r.space and e.scope = r.scope and e.ref = r.key where r.level < 60),
lowest as (select space, scope, key, min(level) as level from reach group by all),
inherited as (select e.*, 'inherited' as status, mine.level from edge e join lowest mine on mine.space = e.space and mine.scope = e.scope and mine.key = e.key
  join lowest up on up.space = e.target and up.scope = e.scope and up.key = e.ref where mine.level > 0 and up.level = mine.level - 1)
select space, field as ref_field, strftime(t, '%Y-%m') as period, status, level, count(*) as orphans
from (select space, field, t, status, 0 as level from direct union all select space, field, t, status, level from inherited) group by all
"""

_P5 = """
with recursive one as (select state_id, arg_max(payload, (saved_at, payload)) as p from builder_states where payload is not null group by state_id),
w as (
  select state_id, 'state' as role, '' as path, '' as parent, '' as kind, try_cast(p as json) as v from one
  union all
  select n.state_id, n.role, n.path, n.parent, n.kind, n.v from (
    select w.state_id, w.role, w.path, w.parent, w.kind, try_cast((w.v ->> '$') as json) as v from w where json_type(w.v) = 'VARCHAR' and w.role <> 'node'
    union all
    select w.state_id, 'list', w.path, '', c.kind, json_extract(w.v, '$.' || c.field)
    from w join (values ('state', '', 'section', 'sections'), ('node', 'section', 'section', 'subsections'), ('node', 'section', 'block', 'blocks'), ('node', 'block', 'run', 'runs')) c(role, of, kind, field)
      on c.role = w.role and c.of = w.kind where json_type(w.v) = 'OBJECT'
    union all
    select state_id, 'node', case when path = '' then '' else path || '/' end || left(kind, 1) || (i - 1), path, kind, x from (
      select state_id, path, kind, unnest(a) as x, generate_subscripts(a, 1) as i from (
        select w.state_id, w.path, w.kind, case when json_type(w.v) = 'OBJECT' then [w.v] else json_extract(w.v, '$[*]') end as a
        from w where w.role = 'list' and json_type(w.v) in ('OBJECT', 'ARRAY'))) where json_type(x) = 'OBJECT'
  ) n)
select state_id, path as node_path, parent as parent_path, kind as node_kind from w where role = 'node'
"""

SQL = {"p4_found": _P4, "p4_cascade": _P4_CASCADE, "p5_found": _P5}
