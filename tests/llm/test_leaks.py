import random

import numpy as np
import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm.leaks import LeakRule, leaking_documents, longest_common  # noqa: E402


def brute(docs, items, rule):
    import re

    def words(t):
        return re.findall(r"\w+", (t or "").lower())

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v:
                continue
            runs = {tuple(v[k : k + rule.run]) for k in range(len(v) - rule.run + 1)}
            wide = max(len(v), int(rule.stretch * len(v)))
            need = int(np.ceil(rule.share * len(v) - 1e-9))
            if any(tuple(w[k : k + rule.run]) in runs for k in range(len(w) - rule.run + 1)) or any(lcs(v, w[k : k + wide]) >= need for k in range(len(w))):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([20, 30])))) for k in range(25)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 2:
            x = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 5)):
                x[rng.randrange(len(x))] = "zz"
            x = x[: rng.choice([11, 12, 18, len(x)])]
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = x
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, "")]
    rule = LeakRule()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([*items, items[0], (77, None), (78, "")], "item_id long, text string")
    want = brute(docs, items, rule)
    assert {tuple(r) for r in leaking_documents(d, i).collect()} == want and len(want) > 10
    assert {tuple(r) for r in leaking_documents(d, i, block_items=7).collect()} == want
    assert {tuple(r) for r in leaking_documents(d, i, block_items=3, blocks_at_once=2).collect()} == want


def test_looks_and_line_layout_make_no_difference(spark):
    item = "Пусть ещё один лаборант завода снимает ровно десять отсчётов пока рычаг остывает около окна"
    seen = item.upper().replace("Е", "E").replace("ЛАБОРАНТ", "ЛАБО-\nРАНТ").replace("Ё", "Е").replace(" ", ",\n", 3)
    d = spark.createDataFrame([(1, "до " + seen + " после"), (2, "ничего")], "doc_id long, text string")
    i = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in leaking_documents(d, i).collect()] == [(1, 5)]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaking_documents(d, i).count() == 0


def test_longest_common():
    assert longest_common([1, 2, 3, 4], [9, 2, 1, 3, 4]) == 3
    assert longest_common([1, 1, 2], [1, 2, 1]) == 2
