"""Queries of this subpackage, by name, over the Parquet tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.abuse import CATEGORIES, Model, abuse_scores, fit_on_labels
from folioscope.llm.leaks import leaking_documents
from folioscope.llm.mixing import mixture, share_report, shares_of, sized_documents
from folioscope.llm.percentiles import combine, percentiles, summarize
from folioscope.llm.same_look import consistent_text, look_alike_pairs
from folioscope.llm.sentences import paragraph_sentences
from folioscope.session import once, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every paragraph block of runs."""
    return paragraph_sentences(table(spark, d, "runs"))


PERCENTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
COUNTS = ["error_count", "warning_count"]


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the counts per profile."""
    whole = summarize(table(spark, d, "submissions"), ["profile_id"], COUNTS, key="id", error=0)
    out = percentiles(whole, ["profile_id"], PERCENTILES)
    return out.select("profile_id", "metric", "q", F.col("percentile").cast("double").alias("percentile"), "n")


def p2_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the counts per day of receipt and profile, within half a percent, to be combined at will."""
    day = F.date_format("received_at", "yyyy-MM-dd")
    return summarize(table(spark, d, "submissions"), ["profile_id"], COUNTS, key="id", part=day)


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from the daily summaries combined: the bucket bounds hold the true value."""
    return percentiles(combine([p2_summaries(spark, d)], ["profile_id"]), ["profile_id"], PERCENTILES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of text runs of one document that look the same though their characters differ."""
    return look_alike_pairs(table(spark, d, "runs").where("kind = 'text'"), "doc_id", "run_id", "text")


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Each text run in its consistent form, with its length before and after."""
    runs = table(spark, d, "runs").where("kind = 'text'").select("run_id", "doc_id", "text").distinct()
    out = consistent_text(runs, "text")
    return out.select("run_id", "doc_id", "form", F.length("text").alias("chars_before"), F.length("form").alias("chars_after"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds a leak of an evaluation item, and the item."""
    return leaking_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents that hold them."""
    found = p6_found(spark, d)
    items = table(spark, d, "eval_items").select("item_id", "task", "lang").distinct()
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(counts, "item_id").select("item_id", "task", "lang", "documents")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    sizes = sized_documents(table(spark, d, "documents"))
    shares = shares_of(sizes, table(spark, d, "mix_targets"))
    return mixture(sizes, shares), shares


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a listed source with its tokens and how often it comes in the mixture."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return share_report(*_mixed(spark, d))


def _model(spark: SparkSession, d: str) -> Model:
    """The model fitted to the labels, once for all queries over the same tables."""
    inputs = [f"{d}/{name}.parquet" for name in ("documents", "doc_labels")]
    return once(spark, "p8-model", inputs, lambda: fit_on_labels(table(spark, d, "documents"), table(spark, d, "doc_labels")))


def _scores(spark: SparkSession, d: str, keep: list[str] | None = None) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"), _model(spark, d), keep=keep)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document and category of content that it holds."""
    flags = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_flag").alias("flag")) for c in CATEGORIES])
    return _scores(spark, d).select("doc_id", F.inline(flags)).where("flag").select("doc_id", "category")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document and category."""
    return _scores(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and rates of each category per source; sources spelled otherwise count as one, null as (none)."""
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("(none)"))
    by = _scores(spark, d, ["source"]).groupBy(source.alias("source_name"))
    rates = [F.avg(F.col(f"{c}_flag").cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    return by.agg(F.count("*").alias("documents"), *rates)


def p8_model(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each category, and precision and recall on the judged documents held out when it was fitted."""
    m = _model(spark, d)
    rows = [(c, *(float(x[k]) for x in (m.threshold, m.precision, m.recall))) for k, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "category string, threshold double, held_out_precision double, held_out_recall double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p2_percentiles, p2_summaries, p2_combined, p3_found, p3_consistent, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_scores, p8_rates, p8_model)
}

_LONG = """
with s as (select distinct id, profile_id, received_at, error_count, warning_count from submissions),
l as (select profile_id, strftime(received_at, '%Y-%m-%d') as part, 'error_count' as metric, error_count as v from s where error_count is not null
      union all select profile_id, strftime(received_at, '%Y-%m-%d'), 'warning_count', warning_count from s where warning_count is not null)"""
_QS = "(values (0.01), (0.1), (0.25), (0.5), (0.75), (0.9), (0.99)) q(q)"
_COUNTS = f"""{_LONG},
r as (select profile_id, metric, v, row_number() over (partition by profile_id, metric order by v) as k,
             count(*) over (partition by profile_id, metric) as n from l)
select r.profile_id, r.metric, cast(q.q as double) as q, cast(r.v as double) as percentile, r.n
from r join {_QS}
on r.k = greatest(1, cast(ceil(round(q.q * r.n, 6)) as bigint))
"""
# the buckets restated: values up to 1e-9 are 0, the others go by the logarithm of their size in steps of half a percent
_BUCKETS = f"""{_LONG}, b as (select part, profile_id, metric, cast(v as double) as v,
 case when abs(v) <= 1e-9 then 0.0 else sign(v) * greatest(ceil(ln(abs(cast(v as double)) / 1e-9) / ln(1.005)), 1) end as bucket from l)"""
_COMBINED = f"""{_BUCKETS},
c as (select profile_id, metric, bucket, count(*) as m, min(v) as low, max(v) as high from b group by all),
r as (select *, sum(m) over (partition by profile_id, metric order by bucket) as upto, sum(m) over (partition by profile_id, metric) as n from c)
select profile_id, metric, cast(q.q as double) as q, low + (high - low) / 2 as percentile, low, high, cast(n as bigint) as n from r join {_QS}
on greatest(1, cast(ceil(round(q.q * n, 6)) as bigint)) between upto - m + 1 and upto
"""

SQL: dict[str, str] = {
    "p2_percentiles": _COUNTS,
    "p2_summaries": f"{_BUCKETS} select part, profile_id, metric, cast(bucket as double) as bucket, count(*) as n, min(v) as low, max(v) as high from b group by all",
    "p2_combined": _COMBINED,
}
