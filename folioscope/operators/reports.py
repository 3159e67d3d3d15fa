"""Statistics, reports, comparisons and history over documents, violations and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import blank, collapse, words
from folioscope.session import exists, materialize
from folioscope.sources.corpus import Corpus

SEVERITIES = ["error", "warning", "info"]


def _count(kind: str) -> Column:
    return F.coalesce(F.count_if(F.col("block_type") == kind), F.lit(0))


def _has(kind: str) -> Column:
    return F.exists("runs", lambda r: r["kind"] == kind)


def _block_counters() -> list[Column]:
    par = F.col("block_type") == "paragraph"
    some = par & ~blank("text")
    return [
        _count("paragraph").alias("paragraphs"),
        F.count_if(some).alias("nonempty_paragraphs"),
        *[_count(k).alias(f"{k}s") for k in ("figure", "table", "formula", "list")],
        F.sum(F.when(F.col("block_type") == "list", F.coalesce(F.size("items"), F.lit(0))).otherwise(0)).alias("list_items"),
        F.sum(F.when(par, words("text")).otherwise(0)).alias("words"),
        F.sum(F.when(some, F.length("text")).otherwise(0)).alias("chars"),
        *[F.count_if(par & F.coalesce(_has(k), F.lit(False))).alias(f"paragraphs_with_{n}") for k, n in (("formula", "formula"), ("xref", "xref"), ("citation", "citation"))],
    ]


_COUNTERS = [
    "paragraphs", "nonempty_paragraphs", "figures", "tables", "formulas", "lists", "list_items", "words", "chars",
    "paragraphs_with_formula", "paragraphs_with_xref", "paragraphs_with_citation",
]


def document_stats(c: Corpus) -> DataFrame:
    """Counters of every document: words and characters of paragraphs, blocks by kind, sections by level, entries, pages.

    Words are counted between white space; characters only in paragraphs that show something. Documents without
    content have zeros.
    """
    b = c.relation("blocks").groupBy("doc_id").agg(*_block_counters())
    s = c.relation("heads").groupBy("doc_id").agg(F.count("*").alias("sections"), *[F.count_if(F.col("level") == k).alias(f"sections_{k}") for k in (1, 2, 3)])
    e = c.relation("entries").groupBy("doc_id").agg(F.count("*").alias("entries"))
    g = c.pages.groupBy("doc_id").agg(F.count("*").alias("page_sections"))
    out = c.docs.select("doc_id").join(b, "doc_id", "left").join(s, "doc_id", "left").join(e, "doc_id", "left").join(g, "doc_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in out.columns if n != "doc_id"})
    mean = F.coalesce(F.round(F.try_divide("words", "nonempty_paragraphs"), 1), F.lit(0.0))
    return out.withColumn("words_per_paragraph", mean)


def section_stats(c: Corpus) -> DataFrame:
    """The block counters per top-level section, also of those that hold nothing; blocks outside sections come under a null section."""
    heads = c.relation("heads")
    h = heads.select("doc_id", F.col("sec_id").alias("container_id"), F.coalesce(F.try_element_at("path", F.lit(1)), "sec_id").alias("top"))
    b = c.relation("blocks").join(h, ["doc_id", "container_id"], "left").groupBy("doc_id", "top").agg(*_block_counters())
    tops = heads.where("level = 1").select("doc_id", F.col("sec_id").alias("top"))
    named = heads.select("doc_id", F.col("sec_id").alias("top"), F.col("text").alias("heading"), "sec_ord")
    out = b.join(tops, ["doc_id", "top"], "full_outer").join(named, ["doc_id", "top"], "left")
    return out.select("doc_id", F.col("top").alias("sec_id"), "heading", "sec_ord", *[F.coalesce(x, F.lit(0)).alias(x) for x in _COUNTERS])


def entry_types(c: Corpus) -> DataFrame:
    return c.relation("entries").groupBy("doc_id", "entry_type").agg(F.count("*").alias("entries"))


def severity_pivot(v: DataFrame, by: str = "doc_id") -> DataFrame:
    """Violations per severity, one row per document."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    return v.groupBy(by).agg(*counts, F.count("*").alias("total"))


def category(code: str = "check_code") -> Column:
    return F.split_part(code, F.lit("."), F.lit(1))


def category_rollup(v: DataFrame) -> DataFrame:
    """Totals, totals per document, and per document and category."""
    return v.withColumn("category", category()).rollup("doc_id", "category").agg(F.count("*").alias("violations"), F.grouping_id().alias("level"))


def top_codes(v: DataFrame, k: int = 5) -> DataFrame:
    """The *k* commonest codes; equal ones by code."""
    return v.groupBy("check_code").agg(F.count("*").alias("violations")).orderBy(F.desc("violations"), "check_code").limit(k)


def placed(v: DataFrame, c: Corpus) -> DataFrame:
    """*v* with top, the top-level section each violation lies in, and top_no, its number in the document from 0; null where none is told.

    The place is read from the location: a section by its id, a block by the section that holds it.
    """
    kind, key = (F.regexp_extract("location", r"^([^\[]*)\[(.*)\]$", k) for k in (1, 2))
    heads = c.relation("heads")
    top = F.coalesce(F.try_element_at("path", F.lit(1)), "sec_id")
    secs = heads.select("doc_id", F.col("sec_id").alias("sec"), top.alias("top"))
    order = heads.where("level = 1").select("doc_id", F.col("sec_id").alias("top"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_ord", "sec_id")) - 1).alias("top_no"))
    blocks = c.relation("blocks").select("doc_id", F.col("block_id").alias("key"), F.col("container_id").alias("holds"))
    out = v.withColumns({"kind": kind, "key": key}).join(blocks, ["doc_id", "key"], "left").withColumn("sec", F.when(F.col("kind") == "section", F.col("key")).when(F.col("kind") != "bibliography", F.col("holds")))
    return out.join(secs, ["doc_id", "sec"], "left").join(order, ["doc_id", "top"], "left").select(*v.columns, "top", "top_no")


def markdown_report(v: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the violations of each document as Markdown, a table per category; documents without have no lines."""
    safe = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))
    rows = v.select("doc_id", category().alias("c"), F.lit(1).alias("part"), "check_code", "location", "detail", F.concat(F.lit("| "), F.array_join(F.array("check_code", "severity", safe(F.col("location")), safe(F.col("detail"))), " | "), F.lit(" |")).alias("line"))
    head = F.concat(F.lit("### "), F.col("c"), F.lit("\n\n| code | severity | location | detail |\n| --- | --- | --- | --- |"))
    groups = rows.select("doc_id", "c").distinct()
    none = F.lit(None).cast("string")
    heads = groups.select("doc_id", "c", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(2).alias("part"), F.lit("").alias("line")))).alias("x")).select("doc_id", "c", "x.part", none.alias("check_code"), none.alias("location"), none.alias("detail"), "x.line")
    titles = groups.select("doc_id").distinct().select("doc_id", F.lit("").alias("c"), F.lit(0).alias("part"), none.alias("check_code"), none.alias("location"), none.alias("detail"), F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n")).alias("line"))
    every = rows.unionByName(heads).unionByName(titles).select("*", F.posexplode(F.split("line", "\n", -1)).alias("k", "text"))
    w = Window.partitionBy("doc_id").orderBy("c", "part", "check_code", "location", "detail", "k")
    return every.select("doc_id", F.row_number().over(w).alias("line_no"), F.col("text").alias("line"))


def filtered(v: DataFrame, severities: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Violations of the given severities and categories; an empty choice means all."""
    if severities:
        v = v.where(F.col("severity").isin(*severities))
    return v.where(category().isin(*categories)) if categories else v


def violation_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What was fixed (only in *a*) and introduced (only in *b*), by document, code, location and normalized detail.

    One aggregation of both sides; a violation found several times on a side counts once.
    """
    key = ["doc_id", "check_code", "location", "print"]
    both = a.withColumn("in_b", F.lit(False)).unionByName(b.withColumn("in_b", F.lit(True)))
    per = both.withColumn("print", F.coalesce(collapse("detail"), F.lit(""))).groupBy(*key).agg(
        F.max("severity").alias("severity"), F.bool_or("in_b").alias("b"), F.bool_and("in_b").alias("only_b")
    )
    return per.where("only_b or not b").select(*key, "severity", F.when(F.col("only_b"), "introduced").otherwise("fixed").alias("change"))


def full_diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows added, removed or changed between two tables with the same key, with the names of the changed columns."""
    x = a.select(*key, F.struct(*values).alias("x"))
    y = b.select(*key, F.struct(*values).alias("y"))
    j = x.join(y, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"x.{v}").eqNullSafe(F.col(f"y.{v}")), v) for v in values]))
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return j.select(*key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("columns")).where("status is not null")


def inherited(profiles: DataFrame, key: str, parent: str, columns: list[str]) -> DataFrame:
    """Values with what a row leaves open taken from the row it extends, over the whole chain.

    Each round joins every row with the one it points to and then points twice as far, until nothing points on or,
    in a circle, as many steps were taken as there are rows. Every round is written once. Chains end at a row without parent or whose parent is absent; a circle gives what it holds.
    """
    out = profiles.select(key, F.col(parent).alias("up"), *columns)
    for _ in range(profiles.count().bit_length()):
        p = out.select(F.col(key).alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"p_{c}") for c in columns])
        out = out.join(p, "up", "left").select(key, F.col("next").alias("up"), *[F.coalesce(c, f"p_{c}").alias(c) for c in columns])
        out = materialize(out, "inherited")
        if out.where("up is not null").isEmpty():
            break
    return out.select(key, *columns)


def recent(submissions: DataFrame, k: int = 20, filename: str | None = None) -> DataFrame:
    """The *k* latest submissions, newest first, optionally of one file."""
    s = submissions.where(F.col("filename") == filename) if filename else submissions
    return s.distinct().orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(k)


def retained(states: DataFrame, keep: int = 30, by: str = "doc_id", at: str = "saved_at", key: str = "state_id") -> DataFrame:
    """The newest *keep* versions of each document."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(at), F.desc(key))
    return states.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")


def changed_versions(states: DataFrame, by: str = "doc_id", at: str = "saved_at", key: str = "state_id", payload: str = "payload") -> DataFrame:
    """Versions whose content differs from the version before, by hash."""
    w = Window.partitionBy(by).orderBy(at, key)
    h = F.sha2(F.coalesce(payload, F.lit("")), 256)
    return states.withColumn("hash", h).withColumn("before", F.lag("hash").over(w)).where(~F.col("hash").eqNullSafe(F.col("before"))).drop("before")


def record(submissions: DataFrame, violations: DataFrame, path: str) -> None:
    """Record submissions and their violations (both with a submission_id) in the history below *path*.

    Rows are kept by month (null for none); a month that gets rows is read, joined with them and replaced, so recording
    the same submissions again changes nothing. A submission recorded again replaces its former self.
    """
    new = submissions.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    found = violations.join(new.select("submission_id", "month").distinct(), "submission_id")
    for name, rows, part in (("submissions", new, "month"), ("violations", found, "month")):
        _replace(rows, f"{path}/{name}", part, "submission_id")


def _replace(rows: DataFrame, path: str, part: str, key: str) -> None:
    """Rewrite the partitions of *path* that *rows* fall into: what was there under other keys, and *rows*."""
    spark = rows.sparkSession
    rows = materialize(rows, "recorded")
    if exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path)
        touched = rows.select(F.col(part).alias("p")).distinct()
        kept = old.join(F.broadcast(touched), F.col(part).eqNullSafe(F.col("p")), "left_semi").join(rows.select(key).distinct(), key, "left_anti")  # months
        rows = materialize(kept.unionByName(rows), "recorded")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def get_submission(spark: SparkSession, path: str, submission_id: object) -> tuple[DataFrame, DataFrame]:
    """The submission of that id and its violations, from the history below *path*."""
    own = F.col("submission_id") == F.lit(submission_id)
    return tuple(spark.read.parquet(f"{path}/{name}").where(own) for name in ("submissions", "violations"))


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """*rows* without those whose key is among *gone*: a delete, and its cascade when applied to child rows."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def replace_counts(df: DataFrame, text: str, find: str) -> Column:
    """Occurrences of a literal that a replacement would change."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("int") if find else F.lit(0)
