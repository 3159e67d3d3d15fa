import json

from pyspark.sql import functions as F

from folioscope.operators import states as S
from folioscope.operators.nested import flat_tables, tagged_rows

STATE = "state_id long, doc_id long, saved_at int, payload string, extra string"


def par(text=None, *runs, **kw):
    out = {"kind": "paragraph"} | kw
    return out | ({"text": text} if text is not None else {}) | ({"runs": [{"kind": "text", "text": r} for r in runs]} if runs else {})


def flat(spark, *states):
    rows = [(k, 1, k, None if s is None else json.dumps(s, ensure_ascii=False), "x") for k, s in enumerate(states, 1)]
    df = spark.createDataFrame(rows + rows[:1], STATE)
    return flat_tables(tagged_rows(df, "state_id", "payload", "saved_at"), "state_id")


def sec(heading, *blocks, subs=(), **kw):
    return {"heading": heading, "blocks": list(blocks), "subsections": list(subs)} | kw


A = {"sections": [
    sec("введение и цель", par("Раз два"), par(None, "три ", "четыре"), par("  "), {"kind": "list", "items": ["Цель", "x"]}),
    sec("Глава 1", subs=[sec("под", {"kind": "table", "caption": "Таблица 1 — Таблица 1.2. Имя", "headers": ["a", "", "b", " "], "rows": [["цель", None]]})]),
    sec("Список литературы", is_bibliography=True, references=["Цель работы", "б"]), sec("пусто", par()), sec("2.1 обзор", references=["цель"]),
]}


def test_progress_and_readiness(spark):
    f = flat(spark, A, None, {"sections": []}, {"sections": [{}]})
    got = {r["state_id"]: r.asDict() for r in S.progress(f).collect()}
    assert got[1] == {"state_id": 1, "sections": 5, "filled_sections": 3, "paragraphs": 4, "nonempty_paragraphs": 2, "tables": 1, "figures": 0, "formulas": 0, "list_items": 2, "words": 4, "sources": 2}
    assert set(got) == {1, 4} and got[4]["sections"] == 1 and got[4]["filled_sections"] == 0
    ready = {r["state_id"]: [r[x] for x in S.READY] for r in S.readiness(f).collect()}
    assert ready == {1: [False, False, False, True, False, True, False], 4: [False] * 7}


def test_search_and_replacements(spark):
    f = flat(spark, A)
    assert {r["node_path"] for r in S.search(f, "ЦЕЛЬ").collect()} == {"s0", "s1", "s2"} and S.search(f, "").count() == 5
    assert [tuple(r) for r in S.replacements(f, "Цель").collect()] == [(1, 2)] and S.replacements(f, "").count() == 0 and S.replacements(f, "нет").count() == 0
    df = spark.createDataFrame([("a.b.a", None)], "s string, n string")
    assert tuple(df.select(S.replaced(F.col("s"), "a", "x"), S.replaced(F.col("n"), "a", "x"), S.replaced(F.col("s"), "", "x")).first()) == ("x.b.x", None, "a.b.a")


def test_rewrites(spark):
    f = flat(spark, A)
    assert {(r["node_path"], r["new_heading"]) for r in S.retitled(f).collect()} == {("s0", "Введение И Цель"), ("s1/s0", "Под"), ("s2", "Список Литературы"), ("s3", "Пусто"), ("s4", "2.1 Обзор")}
    assert [(r["kind"], r["caption"]) for r in S.bare_captions(f).collect()] == [("table", "Имя")]
    assert {r["node_path"] for r in S.empty_paragraphs(f).collect()} == {"s0/b2", "s3/b0"}
    df = spark.createDataFrame([(["", "A", "", " ", "B"],), (["A", "B"],), ([],), (None,), (["", ""],)], "h array<string>")
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.select(S.header_merges(F.col("h"))).collect()] == [[(1, 3)], [], [], None, []]


def test_what_references_can_name(spark):
    state = {"sections": [
        sec("A", {"kind": "formula", "latex": "x" * 31}, {"kind": "formula", "latex": "y", "numbered": False}, subs=[sec("B", {"kind": "figure"}, {"kind": "table", "caption": "T"})]),
        sec("C", {"kind": "figure", "caption": "F"}, {"kind": "formula"}), sec("S", {"kind": "table"}, is_bibliography=True, references=["a", " ", "b" * 61]), sec("S2", is_bibliography=True, references=["z"]),
    ]}
    f = flat(spark, state, {"sections": []})
    got = {r["target_id"]: (r["node_path"], r["label"]) for r in S.reference_targets(f).collect()}
    assert got == {"formula-1": ("s0/b0", "Формула 1: " + "x" * 30 + "…"), "fig-1": ("s0/s0/b0", "Рисунок 1: (без подписи)"), "tbl-1": ("s0/s0/b1", "Таблица 1: T"), "fig-2": ("s1/b0", "Рисунок 2: F"), "formula-2": ("s1/b1", "Формула 2: (пусто)")}
    assert {(r["source_id"], r["label"]) for r in S.citation_options(f).collect()} == {("bib-1", "[1] a"), ("bib-3", "[3] " + "b" * 57 + "…")}


def test_versions(spark):
    b = {"sections": [sec("введение и цель", par("Раз два")), A["sections"][1], sec("Новое"), sec("", par("a")), sec("", par("b"))]}
    c = json.loads(json.dumps(b))
    c["sections"][1]["subsections"].append({"heading": "z"})
    c["sections"][3]["blocks"][0]["text"] = "c"
    f = flat(spark, A, b, c, c)
    order = spark.createDataFrame([(k, 1, k) for k in range(1, 5)], "state_id long, doc_id long, saved_at int")
    got = {(r["state_id"], r["heading"], r["change"]) for r in S.versions_diff(f, order).collect()}
    assert got == {(2, "введение и цель", "modified"), (2, "Список литературы", "removed"), (2, "пусто", "removed"), (2, "2.1 обзор", "removed"), (2, "Новое", "added"), (2, "#3", "added"), (2, "#4", "added"), (3, "Глава 1", "modified"), (3, "#3", "modified")}


def test_empty_tables(spark):
    f = flat_tables(tagged_rows(spark.createDataFrame([], STATE), "state_id", "payload", "saved_at"), "state_id")
    for df in (S.progress(f), S.readiness(f), S.search(f, "a"), S.replacements(f, "a"), S.retitled(f), S.bare_captions(f), S.empty_paragraphs(f)):
        assert df.count() == 0
