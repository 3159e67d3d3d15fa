"""Percentiles of very large numeric columns, per group, from summaries that can be combined.

A summary counts the values of a column by group and bucket. Buckets of equal relative width bound the error; with
width 0 every value is its own bucket and the percentiles are exact. Summaries of files, days or partitions combine
by adding counts. Percentiles come from a distributed multi-select over the buckets: every partition proposes the
median of its own candidates, their weighted median becomes the pivot, candidates are counted below, at and above
it, the ranges ruled out are discarded, and so on for all groups and ranks at once until each is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import materialize

#: Smallest magnitude told from zero when values are bucketed.
TINY = 1e-9


def bucket(value: Column, error: float) -> Column:
    """Number of the bucket of a double; within a bucket values differ by at most the relative *error*.

    Not-a-number has no place in an order and no bucket.
    """
    v = F.when(F.isnan(value), None).otherwise(value)
    width = math.log1p(error)
    n = F.ceil(F.log(F.abs(v) / F.lit(TINY)) / F.lit(width))
    return F.when(F.abs(v) <= TINY, F.lit(0.0)).otherwise(F.signum(v) * F.greatest(n, F.lit(1)).cast("double"))


def exact_type(kinds: list[T.DataType]) -> str:
    """The type that holds values of all these types without loss where there is one: bigint, decimal, else double."""
    whole = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
    names = [k.simpleString() for k in kinds]
    if all(n in whole for n in names):
        return "bigint"
    if all(n in whole or isinstance(k, T.DecimalType) for n, k in zip(names, kinds)):
        scale = max(k.scale for k in kinds if isinstance(k, T.DecimalType))
        digits = max(k.precision - k.scale if isinstance(k, T.DecimalType) else whole[n] for n, k in zip(names, kinds))
        if digits + scale <= 38:
            return f"decimal({digits + scale},{scale})"
        raise ValueError("these columns need more than 38 digits together; summarize them apart")
    return "double"


def summarize(df: DataFrame, groups: list[str], columns: list[str], key: str | None = None, part: Column | None = None, error: float = 0.005) -> DataFrame:
    """(part, groups..., metric, bucket, n, low, high): counts of values by group and bucket.

    *columns* are the numeric columns, each a metric of its own; null and not-a-number are not counted, a null group
    is a group. Rows with the same *key* delivered twice count once. *part* names a slice, such as the day.
    Infinite values keep buckets at the ends. With *error* 0 values keep the type :func:`exact_type` gives: whole
    numbers and decimals of any size stay what they are; a call that mixes them with floating columns makes all
    double. Values are pre-aggregated before the shuffle.
    """
    part = F.lit("all") if part is None else part.cast("string")
    kind = exact_type([df.schema[c].dataType for c in columns]) if error <= 0 else "double"
    some = df.select(*([key] if key else []), *groups, part.alias("part"), *[F.col(c).cast(kind).alias(c) for c in columns])
    if key:
        some = some.distinct()
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])
    long = some.select("part", *groups, F.inline(cells))
    v = F.col("value")
    if error > 0:
        place = bucket(v, error)
    elif kind == "double":
        place = F.when(F.isnan(v), None).otherwise(v + F.lit(0.0))  # -0.0 and 0.0 are one value
    else:
        place = v
    return (
        long.withColumn("bucket", place)
        .where("bucket is not null")
        .groupBy("part", *groups, "metric", "bucket")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )


def combine(summaries: list[DataFrame], groups: list[str]) -> DataFrame:
    """One summary from several made with the same error: counts add up, the parts are forgotten."""
    every = reduce(DataFrame.unionByName, [s.select(*groups, "metric", "bucket", "n", "low", "high") for s in summaries])
    return every.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _within(v: str, s: str) -> Column:
    """The candidate *v* lies between the bounds of the rank *s*."""
    return (F.col(f"{s}.above").isNull() | (F.col(f"{v}.bucket") > F.col(f"{s}.above"))) & (F.col(f"{s}.below").isNull() | (F.col(f"{v}.bucket") < F.col(f"{s}.below")))


def percentiles(summary: DataFrame, groups: list[str], at: list[float], rounds: int = 400, local: int = 1000) -> DataFrame:
    """(groups..., metric, q, percentile, low, high, n): per group and metric the percentile at each q.

    The percentile at q is the value of rank ceil(q n), at least the first: with exact summaries the value itself, in
    its own type, else the middle of its bucket, whose ends *low* and *high* bound the true value; the rank is always
    exact. Groups without values have no rows.

    The work goes on in rounds until all ranks are found. A round passes once over the candidates left: it counts them
    below, at and above the pivots, and each task proposes the medians of what it holds on both sides, so that the next
    pivot is known whichever side the rank lies on. Proposals are merged in a tree: no array holds more than one per
    task of a 256th of the tasks, or 256. Once half of the written candidates are ruled out for all ranks, those left
    are written anew and the others read no more. A rank with at most *local* candidates left is found by sorting those
    in one task. States and candidates are written to the shared folder.
    """
    keys = [*groups, "metric"]
    ids = [*keys, "q"]
    kind = summary.schema["bucket"].dataType
    values = materialize(summary.select(*keys, "bucket", "n", "low", "high"), "buckets")
    grid = F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q")
    rank = F.greatest(F.ceil(F.round(F.col("q") * F.col("total"), 6)), F.lit(1)).cast("long")
    no = F.lit(None).cast(kind)
    total = values.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("live"))
    state = total.select(*keys, "total", "live", grid).select(
        *ids, "total", "live", rank.alias("rank"), no.alias("above"), no.alias("below"), no.alias("pivot"), no.alias("found")
    )
    state = materialize(state, "ranks-0")
    survivors, written = values, None
    for n in range(1, rounds + 1):
        open_ = state.where(F.col("found").isNull() & (F.col("live") > local))
        left = open_.agg(F.count("*").alias("ranks"), F.sum("live").alias("rows")).first()
        if not left["ranks"]:
            break
        if written is None:
            written = left["rows"]
        if left["rows"] * 2 < written:
            unfinished = state.where("found is null")
            inside = survivors.alias("v").join(unfinished.alias("s"), _same("v", "s", keys) & _within("v", "s"), "left_semi")
            survivors, written = materialize(inside.select(*keys, "bucket", "n"), f"left-{n}"), left["rows"]
        state = materialize(_round(survivors, state, open_, keys, ids, kind), f"ranks-{n}")
    else:
        raise RuntimeError(f"ranks not found in {rounds} rounds")
    done = _finished(survivors, state, keys, ids)
    v, s = values.alias("v"), done.alias("s")
    out = s.join(v, _same("s", "v", keys) & (F.col("v.bucket") == F.col("s.found")))
    mid = (F.col("v.low") + (F.col("v.high") - F.col("v.low")) / 2) if isinstance(kind, T.DoubleType) else F.col("v.low")
    return out.select(
        *[F.col(f"s.{k}").alias(k) for k in ids],
        F.when(F.col("v.low") == F.col("v.high"), F.col("v.low")).otherwise(mid).alias("percentile"),
        F.col("v.low").alias("low"),
        F.col("v.high").alias("high"),
        F.col("s.total").alias("n"),
    )


def _finished(survivors: DataFrame, state: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """(ids..., total, found): ranks with few candidates left are found by running counts over these."""
    v, s = survivors.alias("v"), state.where("found is null").alias("s")
    few = v.join(s, _same("v", "s", keys) & _within("v", "s")).select(*[F.col(f"s.{k}").alias(k) for k in ids], "s.total", "s.rank", "v.bucket", "v.n")
    w = Window.partitionBy(*ids).orderBy("bucket")
    hit = few.withColumn("run", F.sum("n").over(w)).where("run >= rank and run - n < rank")
    return state.where("found is not null").select(*ids, "total", "found").unionByName(hit.select(*ids, "total", F.col("bucket").alias("found")))


def _weighted_median(rows: Column, weight: Column) -> Column:
    """The value of the sorted (value, w) structs *rows* at which their running weight reaches half of *weight*."""
    none = F.array_max(rows)["value"]  # of the right type; replaced below
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(False).alias("hit"), none.alias("at"))
    return F.aggregate(
        F.array_sort(rows),
        start,
        lambda a, x: F.struct(
            (a["sum"] + x["w"]).alias("sum"),
            (a["hit"] | ((a["sum"] + x["w"]) * 2 >= weight)).alias("hit"),
            F.when(~a["hit"] & ((a["sum"] + x["w"]) * 2 >= weight), x["value"]).otherwise(a["at"]).alias("at"),
        ),
    )["at"]


def _round(survivors: DataFrame, state: DataFrame, open_: DataFrame, keys: list[str], ids: list[str], kind: T.DataType) -> DataFrame:
    """The state after one pass: counts three ways around the pivots, narrower ranges, the pivots of the next round.

    Without a pivot, in the first round, everything counts as above.
    """
    v, s = survivors.alias("v"), open_.alias("s")
    side = F.when(F.col("v.bucket") < F.col("s.pivot"), -1).when(F.col("v.bucket") == F.col("s.pivot"), 0).otherwise(1)
    live = v.join(s, _same("v", "s", keys) & _within("v", "s")).select(*[F.col(f"s.{k}").alias(k) for k in ids], F.col("v.bucket").alias("bucket"), F.col("v.n").alias("n"), side.alias("side"))
    schema = T.StructType(
        [
            *live.schema.fields[: len(ids)],
            *[T.StructField(c, T.LongType()) for c in ("less", "equal", "rows_low", "rows_high", "w_low", "w_high")],
            T.StructField("low", kind),
            T.StructField("high", kind),
            T.StructField("task", T.LongType()),
        ]
    )
    told = live.mapInPandas(_three_ways(ids), schema)
    sums = [F.sum(c).alias(c) for c in ("less", "equal", "rows_low", "rows_high")]

    def sides(value: str) -> list[Column]:
        return [F.collect_list(F.when(F.col(f"w_{x}") > 0, F.struct(F.col(x).alias("value"), F.col(f"w_{x}").alias("w")))).alias(f"{value}_{x}") for x in ("low", "high")]

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        out = df.groupBy(*by).agg(*sums, *[F.sum(f"w_{x}").alias(f"w_{x}") for x in ("low", "high")], *sides("p"))
        return out.select(*by, "less", "equal", "rows_low", "rows_high", "w_low", "w_high", *[_weighted_median(F.col(f"p_{x}"), F.col(f"w_{x}")).alias(x) for x in ("low", "high")])

    # a tree of two levels keeps the arrays short however many tasks there are
    told = merged(merged(told.withColumn("branch", F.pmod(F.xxhash64("task"), F.lit(256))).drop("task"), [*ids, "branch"]).drop("branch"), ids)
    a, c = state.alias("a"), told.alias("c")
    known = F.col("c.less").isNotNull()
    down = known & (F.col("a.rank") <= F.col("c.less"))
    hit = known & ~down & (F.col("a.rank") <= F.col("c.less") + F.col("c.equal"))
    up = known & ~down & ~hit
    return a.join(c, _same("a", "c", ids), "left").select(
        *[F.col(f"a.{k}").alias(k) for k in ids],
        F.col("a.total").alias("total"),
        F.when(down, F.col("c.rows_low")).when(up, F.col("c.rows_high")).when(hit, F.lit(0)).otherwise(F.col("a.live")).alias("live"),
        F.when(up, F.col("a.rank") - F.col("c.less") - F.col("c.equal")).otherwise(F.col("a.rank")).alias("rank"),
        F.when(up, F.coalesce("a.pivot", "a.above")).otherwise(F.col("a.above")).alias("above"),
        F.when(down, F.col("a.pivot")).otherwise(F.col("a.below")).alias("below"),
        F.when(down, F.col("c.low")).when(up, F.col("c.high")).otherwise(F.col("a.pivot")).alias("pivot"),
        F.when(hit, F.col("a.pivot")).otherwise(F.col("a.found")).alias("found"),
    )


def _three_ways(ids: list[str]):  # noqa: ANN202
    """Per batch and rank: weights below and at the pivot, and on both sides the rows, their weight and median."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for b in batches:  # a batch is a proposer of its own: the weights make up for its size
            if not len(b):
                continue
            b = b.sort_values("bucket", kind="stable", ignore_index=True)
            of = b.groupby(ids, dropna=False, sort=False).ngroup().to_numpy()
            size = int(of.max()) + 1
            out = b[ids].iloc[np.sort(np.unique(of, return_index=True)[1])].reset_index(drop=True)  # ranks by their first row
            n, side, value = b["n"].to_numpy(np.int64), b["side"].to_numpy(), b["bucket"].to_numpy()
            out["less"], out["equal"] = (_sums(of[side == k], n[side == k], size) for k in (-1, 0))
            for name, k in (("low", -1), ("high", 1)):
                at = np.flatnonzero(side == k)
                at = at[np.argsort(of[at], kind="stable")]  # by rank, and by value within
                g, w = of[at], n[at]
                whole = _sums(g, w, size)
                run = np.cumsum(w) - (np.cumsum(whole) - whole)[g]
                half = np.flatnonzero(run * 2 >= whole[g])
                first = half[np.append(True, g[half][1:] != g[half][:-1])] if len(half) else half
                median = np.full(size, None, object)
                median[g[first]] = value[at[first]].tolist() if value.dtype != object else value[at[first]]
                out[f"rows_{name}"], out[f"w_{name}"], out[name] = np.bincount(g, minlength=size), whole, median
            out["task"] = task
            yield out[[*ids, "less", "equal", "rows_low", "rows_high", "w_low", "w_high", "low", "high", "task"]]

    return work


def _sums(group: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, group, n)
    return out
