"""References to records that do not exist.

References are edges from a referring record to a key in a space of target records. :func:`orphan_cascade` finds
the edges whose target is missing, deleted or loaded afterwards, and then follows the foreign-key graph: records
that refer to orphaned records are orphaned indirectly, level by level, until no new ones appear.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialize

# The blanks that may stand around a stored reference.
BLANKS = " \t\n\r\u000b\u000c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u200b"


@dataclass(frozen=True)
class Reference:
    """The column *field* of the records of *space* names keys of the space *target*, within one scope."""

    space: str
    field: str
    target: str


def bare(c: Column | str) -> Column:
    """A reference without blanks around it; null when nothing is left."""
    return F.nullif(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)), F.lit(""))


def records(df: DataFrame, space: str, scope: str, key: str, loaded: str, deleted: str | None) -> DataFrame:
    """Target records as (space, scope, key, first_loaded, deleted), one row per key.

    Rows delivered again count as one record: it exists from its earliest *loaded*, and is deleted if its latest
    row is (a live row wins a tie; null reads as not deleted). Keys that are null or blank name nothing.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    return (
        df.select(F.col(scope).alias("scope"), F.col(key).cast("string").alias("key"), F.col(loaded).alias("at"), (~gone).alias("live"))
        .where(bare("key").isNotNull() & F.col("scope").isNotNull())
        .groupBy("scope", "key")
        .agg(F.min("at").alias("first_loaded"), F.max(F.struct("at", "live")).alias("last"))
        .select(F.lit(space).alias("space"), "scope", "key", "first_loaded", (~F.col("last.live")).alias("deleted"))
    )


def references(df: DataFrame, scope: str, key: str, loaded: str, refs: list[Reference]) -> DataFrame:
    """Edges (space, scope, key, field, target, ref, first_loaded) of the records in *df*, which all share a space.

    A record delivered more than once counts once, with its earliest delivery; blank references are no edges.
    """
    fields = [r.field for r in refs]
    one = df.groupBy(F.col(key).alias("key"), F.col(scope).alias("scope")).agg(
        F.min(F.struct(F.col(loaded).alias("at"), *[F.col(f).cast("string").alias(f) for f in fields])).alias("r")
    )
    edge = F.array(
        *[
            F.struct(F.lit(r.field).alias("field"), F.lit(r.target).alias("target"), bare(F.col("r")[r.field]).alias("ref"))
            for r in refs
        ]
    )
    return (
        one.select(F.lit(refs[0].space).alias("space"), "scope", "key", F.col("r.at").alias("first_loaded"), F.inline(edge))
        .where("ref is not null")
        .select("space", "scope", "key", "field", "target", "ref", "first_loaded")
    )


def judged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """*edges* with a status: `missing`, else `deleted`, else `late` (target first loaded after the referring record), else null."""
    n = nodes.select(
        F.col("space").alias("target"), "scope", F.col("key").alias("ref"), F.col("first_loaded").alias("target_loaded"), "deleted"
    )
    status = (
        F.when(F.col("deleted").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("target_loaded") > F.col("first_loaded"), "late")
    )
    return edges.join(n, ["target", "scope", "ref"], "left").select(*edges.columns, status.alias("status"))


def orphan_cascade(edges: list[DataFrame], nodes: list[DataFrame], refs: list[Reference], levels: int | None = None) -> DataFrame:
    """All orphan references: *edges* columns plus status and level (0 direct, n inherited over n steps).

    *edges* come from :func:`references`, *nodes* from :func:`records`. Each round semi-joins the remaining edges
    with the records orphaned in the round before; a record is reported at the first level that reaches it, once
    per referring field. The rounds end when none is new; cycles end by themselves. Where more than *levels* are needed,
    if given, an error is raised.

    The rounds go over the edges between spaces that are referred to; records nothing refers to can pass nothing on,
    so theirs are joined once, when all others are known. Without such a space there is no second round. What a round
    finds is written to the shared folder, which keeps the plans short and survives lost executors.
    """
    judged = judged_edges(reduce(DataFrame.unionByName, edges), reduce(DataFrame.unionByName, nodes))
    below = [r.target for r in refs]
    if not any(r.space in below for r in refs):
        return judged.where("status is not null").withColumn("level", F.lit(0))
    columns = [c for c in judged.columns if c != "status"]
    judged = materialize(judged.withColumn("key", F.col("key").cast("string")), "edges")
    passes = F.col("space").isin(*below)
    record = ["space", "scope", "key"]
    direct = judged.where("status is not null").withColumn("level", F.lit(0))
    inner, leaves = (judged.where("status is null").where(x).select(*columns) for x in (passes, ~passes))
    layers = [direct]
    frontier = materialize(direct.where(passes).select(*record).distinct(), "orphans-0")
    reached = [frontier.withColumn("level", F.lit(0))]
    known = frontier
    for level in count(1):
        parents = frontier.select(F.col("space").alias("target"), "scope", F.col("key").alias("ref"))
        layer = inner.join(parents, ["target", "scope", "ref"], "left_semi").join(known, record, "left_anti")
        layer = materialize(layer.select(*columns, F.lit("inherited").alias("status"), F.lit(level).alias("level")), f"orphans-{level}")
        if layer.isEmpty():
            break
        if levels is not None and level > levels:
            raise ValueError(f"orphans are inherited over more than {levels} levels")
        layers.append(layer)
        frontier = layer.select(*record).distinct()
        known = known.unionByName(frontier)
        reached.append(frontier.withColumn("level", F.lit(level)))
    parents = reduce(DataFrame.unionByName, reached).select(F.col("space").alias("target"), "scope", F.col("key").alias("ref"), (F.col("level") + 1).alias("level"))
    late = leaves.join(parents, ["target", "scope", "ref"]).join(direct.select(*record).distinct(), record, "left_anti")
    late = late.withColumn("first", F.min("level").over(Window.partitionBy(*record))).where("level = first")
    late = late.select(*columns, F.lit("inherited").alias("status"), "level")
    if levels is not None and len(reached) > levels and not late.where(F.col("level") > levels).isEmpty():
        raise ValueError(f"orphans are inherited over more than {levels} levels")
    return reduce(DataFrame.unionByName, [*layers, late])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(space, field, period, status, level, orphans): counts per referring field and month of first loading."""
    return (
        orphans.groupBy("space", F.col("field").alias("ref_field"), F.date_format("first_loaded", "yyyy-MM").alias("period"), "status", "level")
        .agg(F.count("*").alias("orphans"))
    )
