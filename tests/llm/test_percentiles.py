import math
import random

import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.percentiles import combine, percentiles, summarize  # noqa: E402

QS = [0.0, 0.1, 0.5, 0.99, 1.0]
SCHEMA = "id long, g string, a double, b int, day string, n int, bucket string"


def data():
    rng = random.Random(6)
    rows = [(k, rng.choice(["x", "y", None]), rng.choice([rng.gauss(0, 100), -0.0, 0.0, 5.0, float(rng.randrange(9))]), rng.choice([None, 1, 2, 10**6]), str(k % 3), k, "q") for k in range(400)]
    rows += rows[:20] + [(1000, "z", None, None, "0", 0, ""), (1001, "w", float("nan"), 7, "0", 0, ""), (1002, "w", float("inf"), 7, "0", 0, "")]
    return rows


def want(rows):
    out = {}
    for g in {r[1] for r in rows}:
        for m, k in (("a", 2), ("b", 3)):
            v = sorted(float(x) for x in {r[0]: r[k] for r in rows if r[1] == g}.values() if x is not None and not math.isnan(x))
            for q in QS:
                if v:
                    out[(g, m, q)] = v[max(1, math.ceil(round(q * len(v), 6))) - 1]
    return out


def test_exact_equals_sorting(spark):
    rows = data()
    s = summarize(spark.createDataFrame(rows, SCHEMA), ["g"], ["a", "b"], key="id", error=0)
    got = {(r["g"], r["metric"], r["q"]): r["percentile"] for r in percentiles(s, ["g"], QS).collect()}
    assert got == want(rows)


def test_rounds_discard_until_each_rank_is_found(spark):
    rows = data()
    s = summarize(spark.createDataFrame(rows, SCHEMA), ["g"], ["a", "b"], key="id", error=0)
    for local in (0, 5):
        got = {(r["g"], r["metric"], r["q"]): r["percentile"] for r in percentiles(s, ["g"], QS, local=local).collect()}
        assert got == want(rows)


def test_whole_numbers_and_decimals_stay_exact(spark):
    big = 2**53
    df = spark.createDataFrame([(k, "x", big + k) for k in range(1, 8)], "id long, g string, v long")
    s = summarize(df, ["g"], ["v"], error=0)
    for local in (0, 100):
        assert {r["q"]: r["percentile"] for r in percentiles(s, ["g"], [0.0, 0.5, 1.0], local=local).collect()} == {0.0: big + 1, 0.5: big + 4, 1.0: big + 7}
    d = df.selectExpr("g", "cast(v as decimal(20,0)) + cast(0.01 as decimal(4,2)) as v")
    got = [str(r["percentile"]) for r in percentiles(summarize(d, ["g"], ["v"], error=0), ["g"], [0.5], local=0).collect()]
    assert got == [f"{big + 4}.01"]


def test_parts_combine_within_the_error(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [summarize(df.where(f"day = '{k}'"), ["g"], ["a", "b"], key="id", error=0.01) for k in range(3)]
    for r in percentiles(combine(parts, ["g"]), ["g"], QS).collect():
        true = want(rows)[(r["g"], r["metric"], r["q"])]
        assert r["low"] <= true <= r["high"]
        assert math.isinf(true) or abs(r["percentile"] - true) <= 0.01 * abs(true) + 1e-9


def test_empty(spark):
    s = summarize(spark.createDataFrame([], SCHEMA), ["g"], ["a"], key="id")
    assert percentiles(s, ["g"], QS).count() == 0
