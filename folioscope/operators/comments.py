"""Reviewer comments on submissions: kept as rows, added and resolved in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import blank, strip

# Who can comment.
ROLES = ["student", "supervisor", "anonymous"]
SCHEMA = "comment_id string, submission_id long, author string, role string, body string, created_at timestamp, resolved boolean"


def checked(new: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments that can be kept, and the others with the reason: `body` blank, `role` unknown, `submission` absent.

    Bodies lose the blanks around them, a missing role is anonymous, a missing author empty. The id is a hash of what is
    said, by whom, where and when, so a comment delivered twice is one.
    """
    role = F.coalesce("role", F.lit("anonymous"))
    known = submissions.select("submission_id", F.lit(True).alias("known")).distinct()
    reason = F.when(blank("body"), "body").when(~role.isin(*ROLES), "role").when(F.col("known").isNull(), "submission")
    some = new.join(known, "submission_id", "left").select("submission_id", F.coalesce("author", F.lit("")).alias("author"), role.alias("role"), strip("body").alias("body"), "created_at", reason.alias("reason"))
    key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in ("submission_id", "author", "role", "body", "created_at")]), 256)
    good = some.where("reason is null").select(key.alias("comment_id"), "submission_id", "author", "role", "body", "created_at", F.lit(False).alias("resolved"))
    return good.dropDuplicates(["comment_id"]), some.where("reason is not null")


def added(comments: DataFrame, new: DataFrame) -> DataFrame:
    """*comments* with the *new* ones that are not among them yet."""
    return comments.unionByName(new.join(comments.select("comment_id"), "comment_id", "left_anti").select(*comments.columns))


def resolved(comments: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    """*comments* with those whose comment_id is among *ids* marked as resolved, or open again."""
    hit = ids.select("comment_id", F.lit(True).alias("hit")).distinct()
    return comments.join(hit, "comment_id", "left").withColumn("resolved", F.when(F.col("hit"), F.lit(value)).otherwise(F.col("resolved"))).select(*comments.columns)


def listed(comments: DataFrame, submission_id: int, include_resolved: bool = True) -> DataFrame:
    """The comments on one submission in the order they were made."""
    own = comments.where(F.col("submission_id") == submission_id)
    return (own if include_resolved else own.where("not resolved")).orderBy("created_at", "comment_id")


def open_counts(comments: DataFrame) -> DataFrame:
    """(submission_id, comments, unresolved, last): counts per submission and the latest comment."""
    return comments.groupBy("submission_id").agg(F.count("*").alias("comments"), F.count_if(~F.col("resolved")).alias("unresolved"), F.max("created_at").alias("last"))


def latest(comments: DataFrame) -> DataFrame:
    """The last comment on each submission."""
    w = Window.partitionBy("submission_id").orderBy(F.desc_nulls_last("created_at"), F.desc("comment_id"))
    return comments.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
