"""Row-local rules over a stream of blocks, and windowed counts with late rows; an extension to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.engine import RULES, Profile, _scan
from folioscope.sources.corpus import with_text


def check_stream(blocks: DataFrame, codes: list[str], profile: Profile | None = None) -> DataFrame:
    """Violations of row-local block rules, block by block, without state; *blocks* may be a stream."""
    rules = [RULES[c] for c in codes if c in RULES and RULES[c].local and RULES[c].relation == "blocks"]
    return _scan(with_text(blocks), rules, profile or Profile())


def submissions_per_window(stream: DataFrame, window: str = "7 days", late: str = "30 days") -> DataFrame:
    """Submissions and errors per window of creation and profile; redelivered rows count once, rows later than *late* do not."""
    timed = stream.withWatermark("created_at", late)
    once = timed.dropDuplicatesWithinWatermark(["id"]) if stream.isStreaming else timed.dropDuplicates(["id"])
    return once.groupBy(F.window("created_at", window), "profile_id").agg(F.count("*").alias("submissions"), F.sum("error_count").alias("errors"))


def to_history(violations: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Append a stream of violations to the history; each micro-batch writes its own folder, so a repeated one replaces itself."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return violations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
