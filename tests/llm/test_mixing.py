import os
import random

import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.mixing import VOCABULARY, mixture, pivot, plan_shares, round_copies, share_report, shares_of, sized_documents, token_counts  # noqa: E402

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_plan_caps_and_redistributes():
    s = {x.source: x for x in plan_shares([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 9), ("none", 0.5, 3)], {"a": 100, "b": 10, "c": 1000}, 400)}
    assert s["b"].copies == 2 and s["none"].copies == 0
    assert s["a"].copies == 1 and s["c"].copies * 1000 == pytest.approx(400 - 100 - 20)
    assert plan_shares([], {}) == []
    assert plan_shares([("a", None, None)], {"a": 5})[0].copies == 0


def test_pivot_keeps_weighted_sum():
    rng = random.Random(1)
    rows = [(k, rng.randrange(1, 50), rng.random()) for k in range(300)]
    out = list(pivot(iter(rows), "s"))
    assert sorted(k for k, _, _ in out) == list(range(300))
    assert sum(w * p for _, w, p in out) == pytest.approx(sum(w * p for _, w, p in rows))
    assert all(p in (0.0, 1.0) for _, _, p in out[:-1])


def test_round_copies_sums_and_repeats(spark):
    rng = random.Random(2)
    rows = [(k, "hot" if k % 3 else "cold", rng.randrange(0, 90), 2.37 if k % 3 else 0.4, "x") for k in range(900)]
    rows += [(1000, None, 5, 3.5, "x"), (1001, "null", 5, None, "x"), (1002, "cold", None, 0.5, "x")]
    df = spark.createDataFrame(rows, "id long, g string, w long, copies double, settled string").repartition(6)
    out = round_copies(df, "id", "g", "w", "copies", fan=4).collect()
    assert sorted(r["id"] for r in out) == sorted(r[0] for r in rows)
    for g, c in (("hot", 2.37), ("cold", 0.4)):
        mine = [r for r in out if r["g"] == g and r["w"] is not None]
        assert abs(sum(r["w"] * r["copies"] for r in mine) - c * sum(r["w"] for r in mine)) <= 90
        assert {r["copies"] for r in mine} <= {int(c), int(c) + 1}
    assert {r["copies"] for r in out if r["id"] in (1000, 1001)} == {0}


def test_more_groups_than_the_fan_of_the_tree(spark):
    rows = [(k, f"g{k % 10}", 7 + k % 5, 0.43) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, w long, copies double").repartition(12)
    for fan in (2, 4, 4096):
        out = round_copies(df, "id", "g", "w", "copies", fan=fan).collect()
        assert sorted(r["id"] for r in out) == list(range(400)) and {r["copies"] for r in out} == {0, 1}
        for g in {r["g"] for r in out}:
            mine = [r for r in out if r["g"] == g]
            assert abs(sum(r["w"] * (r["copies"] - 0.43) for r in mine)) <= 11
    assert round_copies(df.where("false"), "id", "g", "w", "copies").count() == 0


@needs_vocabulary
def test_tokens_and_mixture(spark):
    docs = [(k, f"word {k} " * (k % 7), [" Lab-A", "lab-a", "b", None][k % 4], "e") for k in range(200)] + [(999, None, "b", "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    sizes = sized_documents(df)
    assert {r["doc_id"]: r["tokens"] for r in sizes.collect()}[999] == 0
    targets = spark.createDataFrame([("lab-a", 0.6, 1), ("B ", 0.6, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    shares = shares_of(sizes, targets)
    mixed = mixture(sizes, shares)
    rep = {r["source"]: r for r in share_report(mixed, shares).collect()}
    assert rep["gone"]["tokens_mixed"] == 0 and rep["b"]["most_copies"] <= 4 and rep["lab-a"]["most_copies"] <= 1
    assert sum(r["actual_share"] for r in rep.values()) == pytest.approx(1)
    assert mixed.where("source is null").count() == 0
    assert mixture(sizes.limit(0), shares_of(sizes.limit(0), targets)).count() == 0
    assert token_counts(df, "text").where("doc_id = 1").first()["tokens"] > 0
