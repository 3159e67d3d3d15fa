import pandas as pd
import pytest

from folioscope.operators import rules
from folioscope.operators.engine import RULES, Profile, register, rule_per_document, rule_sql, runnable, validate
from folioscope.operators.rules import longest_common, longest_increasing
from folioscope.sources.corpus import RUN, SCHEMAS, make

NAMES = [p.split(":")[0] for p in RUN[7:-1].split(",")]


def run(text=None, kind="text", **kw):
    base = dict.fromkeys(NAMES) | {"run_ord": 0, "kind": kind, "text": text} | kw
    return tuple(base[n] for n in NAMES)


def rows(name, *dicts):
    cols = [c.strip().split(" ")[0] for c in split(SCHEMAS[name])]
    return [tuple(d.get(c) for c in cols) for d in dicts]


def split(schema):
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch in "<(" and 1 or 0
        depth -= ch in ">)" and 1 or 0
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def corpus(spark, docs=(1,), **frames):
    d = {"docs": rows("docs", *[{"doc_id": k} for k in docs])} | {n: rows(n, *v) for n, v in frames.items()}
    return make(spark, **{n: spark.createDataFrame(v, SCHEMAS[n]) for n, v in d.items()})


def par(n, *texts, doc=1, **kw):
    return {"doc_id": doc, "block_id": f"p-{n}", "block_ord": n, "block_type": "paragraph", "container_id": "s1", "runs": [t if isinstance(t, tuple) else run(t) for t in texts]} | kw


def obj(kind, n, text, **kw):
    return {"doc_id": 1, "block_id": f"{kind}-{n}", "block_ord": n, "block_type": kind, "container_id": "s1", "runs": [run(text)] if text is not None else []} | kw


def sec(n, text, level=1, doc=1, parent=None, **kw):
    return {"doc_id": doc, "sec_id": f"s{n}", "sec_ord": n, "level": level, "parent_id": parent, "path": ([parent] if parent else []) + [f"s{n}"], "heading": [run(text)]} | kw


def found(c, code, **params):
    v = validate(c, Profile(params={code: params}), codes=[code], suppress=False).collect()
    return sorted((r["location"], r["detail"]) for r in v)


def test_registry():
    assert len(RULES) >= 120 and set(rules.EMPTY_CODES) <= set(RULES)
    with pytest.raises(ValueError):
        register(RULES["T.01"])
    assert "R.15" not in runnable(Profile(disabled=rules.OFF))


def test_every_rule_on_an_empty_corpus(spark):
    c = corpus(spark, docs=())
    out = validate(c)
    assert out.columns == ["doc_id", "check_code", "severity", "location", "detail"]
    for family in ("A", "C", "K", "S"):
        assert validate(c, codes=[k for k in RULES if k[0] == family and len(k) == 4], suppress=False).count() == 0


def test_pages(spark):
    page = {"doc_id": 1, "ps_ord": 1, "ps_id": "main", "ps_type": "main", "paper": "A4", "orientation": "portrait", "margins_mm": {"top": 25.0, "left": 30.2, "right": 15.0}, "visible": True, "format": "roman", "start_mode": "start_at", "start_value": 5, "footer": (None, None, "{page}"), "title_block": True}
    title = page | {"ps_ord": 0, "ps_id": "t", "ps_type": "title"}
    last = page | {"ps_ord": 2, "ps_id": "a", "ps_type": "appendix", "orientation": "landscape", "start_mode": "restart", "link_to_previous": True, "title_block": None, "visible": None, "header": ("Приложение А", None, None)}
    c = corpus(spark, pages=[page, title, last])
    assert found(c, "F.01") == [(f"page_section[{x}]", "top") for x in ("a", "main", "t")]
    assert found(c, "F.02", paper="A3")[0][1] == "A4" and found(c, "F.03") == []
    assert [x[0] for x in found(c, "F.04")] == ["page_section[main]", "page_section[t]"] and found(c, "F.04", position="nowhere") == []
    assert found(c, "F.06") == [("page_section[main]", "5"), ("page_section[t]", "5")] and len(found(c, "F.07")) == 3
    assert [x[0] for x in found(c, "F.08")] == ["page_section[a]"] and [x[0] for x in found(c, "K.02")] == ["page_section[t]"]
    assert found(c, "K.03") == [("page_section[main]", "5")] and [x[0] for x in found(c, "K.04")] == ["page_section[a]"]
    assert found(c, "K.04", allow_restart_in_appendix=True) == [] and [x[0] for x in found(c, "K.06")] == ["page_section[a]"]
    assert found(c, "K.05") == [] and len(found(c, "F.05")) == 2
    assert found(c, "K.01") == [("page_sections", "absent frontmatter"), ("page_sections", "absent frontmatter")]


def test_text_rules(spark):
    c = corpus(
        spark,
        docs=(1,),
        blocks=[
            par(1, run("Текст", font="Arial", size_pt=14.05), line_spacing=1.0, alignment="left"),
            par(2, run("Текст  два", font=None, size_pt=12.0), line_spacing=None),
            par(3, 'он сказал "да" '),
            par(4, '5" экран - 10 кг и А. Б. Иванов'),
            par(5, run("Таблица", size_pt=12.0), style_name="Caption", line_spacing=1.0),
            par(6, run("x", size_pt=9.0, font="Arial"), style_name="Header", space_before_pt=9.0),
            par(7, "y", space_before_pt=3.0, space_after_pt=0.4),
        ],
    )
    assert found(c, "T.01") == [("paragraph[p-1]", "Arial")] and found(c, "T.02") == [("paragraph[p-2]", "12.0")]
    assert found(c, "T.03") == [("paragraph[p-1]", "1.0")] and found(c, "T.05") == [("paragraph[p-1]", "left")]
    assert [x[0] for x in found(c, "T.08")] == ["paragraph[p-2]"] and [x[0] for x in found(c, "T.09")] == ["paragraph[p-3]"]
    assert found(c, "T.10") == [("paragraph[p-3]", "2"), ("paragraph[p-4]", "1")] and len(found(c, "T.10", allow_inch_marker=True)) == 1
    assert len(found(c, "T.11")) == 1 and found(c, "T.12") == [("paragraph[p-4]", "1")] and found(c, "T.13") == [("paragraph[p-4]", "1")]
    assert found(c, "T.14") == [("paragraph[p-7]", "before")]


def test_empty_islands(spark):
    c = corpus(spark, blocks=[par(1, ""), obj("table", 2, None), par(3), par(4, "text"), par(5, " "), par(6, "x")])
    assert found(c, "T.07") == [("paragraph[p-1]", "2")] and found(c, "T.07", max_consecutive_empty=2) == []


def test_structure(spark):
    c = corpus(
        spark,
        docs=(1, 2),
        secs=[sec(1, "Введение"), sec(2, "Реферат"), sec(3, "Особое"), sec(4, "ЗАКЛЮЧЕНИЕ"), sec(5, "Глава 1"), sec(6, "под", 2, parent="s4")],
        blocks=[par(1, "Актуальность и цель", container_id="s1"), par(2, "задачи", container_id="s1", page_break_before=False), par(3, "итог", container_id="s6"), par(4, "z", container_id="s5", page_break_before=False)],
    )
    assert sorted(r["detail"] for r in validate(c, codes=["S.01"]).where("doc_id = 1").collect()) == ["Список использованных источников"]
    assert validate(c, codes=["S.01"]).where("doc_id = 2").count() == 3
    assert found(c, "S.03") == [("section[s3]", "Особое")] and [x[1] for x in found(c, "S.04")] == ["объект", "предмет"]
    assert found(c, "S.05") == [("section[s4]", "1")] and found(c, "S.06") == [("section[s5]", "Глава 1")]
    assert [x[0] for x in found(c, "S.07")] == ["section[s3]"] and found(c, "S.02") == [("section[s2]", "Реферат")]
    assert found(c, "H.05") == [] and ("section[s3]", "nothing") in found(c, "H.06")


def test_subsequences():
    assert longest_increasing([1, 0, 2]) == {0, 2} and longest_increasing([3, 1, 2, 0]) == {1, 2}
    assert longest_increasing([]) == set() and longest_common(["a", "b", "c"], ["a", "c", "b"]) == [0, 1]


def test_headings(spark):
    c = corpus(spark, secs=[sec(1, "1 А"), sec(2, "3 Б"), sec(3, "4 В."), sec(4, "1.1. Г", 3)])
    assert found(c, "H.04") == [("section[s2]", "2,3")] and found(c, "H.05") == [("section[s4]", "1,3")]
    assert found(c, "H.03") == [("section[s4]", "1.1")] and [x[0] for x in found(c, "H.08")] == ["section[s3]"]
    assert ("section[s1]", "font") in found(corpus(spark, secs=[sec(1, "x", heading=[run("X", font="Arial")])]), "H.01")
    mixed = corpus(spark, secs=[sec(1, "1 А"), sec(2, "Б"), sec(3, "Введение")])
    assert found(mixed, "H.04") == [("section[s2]", "mixed")]


def test_numbered_objects(spark):
    c = corpus(
        spark,
        blocks=[par(0, "см. рис. 4 и рисунке 9, формула (2), (7)"), *[obj("figure", k, f"Рисунок {n} — имя") for k, n in enumerate((1, 2, 2, 4), 1)],
                obj("figure", 9, "Рис 5: x", dpi=96, alignment="left"), obj("figure", 10, None), par(11, "рисунок 1"),
                {"doc_id": 1, "block_id": "f-1", "block_ord": 12, "block_type": "formula", "latex": "x", "number": "(2)", "runs": []},
                par(13, "a"), par(14, "b"), par(15, "c"), par(16, "где x")],
    )
    assert found(c, "I.05") == [("figure[figure-3]", "duplicate of figure-2"), ("figure[figure-4]", "3,4")]
    assert found(c, "I.06") == [("figure[figure-2]", "2"), ("figure[figure-3]", "2"), ("figure[figure-9]", "5")]
    assert found(c, "I.07") == [("figure[figure-1]", "1")] and [x[0] for x in found(c, "I.01")] == ["figure[figure-10]"]
    assert [x[0] for x in found(c, "I.03")] == ["figure[figure-9]"] and found(c, "I.08") == [("figure[figure-9]", "96")]
    assert found(c, "C.01") == [("paragraph[p-0]", "9")] and found(c, "C.03") == [("paragraph[p-0]", "7")]
    assert found(c, "M.02") == [("formula[f-1]", "(2)")] and found(c, "M.03") == [("formula[f-1]", "1,2")]


def test_tables_and_lists(spark):
    cell = lambda t, s=None: (t, s)
    t = obj("table", 1, "Таблица 1 - имя", headers=[[cell("a"), cell("")]], rows=[[cell("x", 12.05), cell("y")]])
    lists = [obj("list", k, None, ordered=True, items=[f"{m} a;", "b"]) for k, m in ((2, "1)"), (3, "1)"), (4, "1."))]
    c = corpus(spark, blocks=[t, obj("table", 9, "Таблица 2 — b", rows=[[cell(" ")]]), *lists, obj("list", 5, None, ordered=False, items=["* a", "b"])])
    assert found(c, "B.06") == [("table[table-1]", "12.05")] and found(c, "B.07") == [("table[table-1]", "0,1"), ("table[table-9]", "0,0")]
    assert found(c, "B.10") == [("table[table-9]", "")] and found(c, "B.12") == [("table[table-1]", "-")] and found(c, "B.03") == []
    assert found(c, "L.02") == [("list[list-4]", "dot")] and found(c, "L.01") == [("list[list-5]", "*")] and len(found(c, "L.04")) == 3


def test_bibliography(spark):
    e = lambda n, t="book", **f: {"doc_id": 1, "ordinal": n, "entry_id": f"ref-{n}", "entry_type": t, "fields": f}
    c = corpus(
        spark,
        entries=[e(1, raw="Яковлев А. Б. Книга. — М. : Наука, 2020.", author="Яковлев", year="2020"), e(2, "web", raw="Абв текст без всего", author="Абв", year="2010", url="https//x.ru"), e(3, raw="коротко", author="Явь", year="x", doi="11/2")],
        blocks=[par(1, "по [1, 3-5] и [5-3]", run(None, "citation", source_id=" ref-2 "), run(None, "xref", target_id="  "), run(None, "xref", target_id="p-9")), par(2, "(Иванов, 2020) и [Петров 2019]")],
    )
    assert found(c, "C.04") == [("paragraph[p-1]", "4"), ("paragraph[p-1]", "5"), ("paragraph[p-1]", "5")]
    assert found(c, "C.06") == [("paragraph[p-1]", "xref "), ("paragraph[p-1]", "xref p-9")]
    assert found(c, "R.01") == [("paragraph[p-2]", "(Иванов, 2020)"), ("paragraph[p-2]", "[Петров 2019]")]
    assert found(c, "R.02") == [("bibliography[ref-2]", "ref-1")] and found(c, "R.05") == [("bibliography[ref-3]", "3")]
    assert ("bibliography[ref-1]", "place") in found(c, "R.03") and found(c, "R.10") == []
    assert found(c, "R.04") == [("bibliography[ref-2]", "final_dot"), ("bibliography[ref-2]", "separator"), ("bibliography[ref-2]", "web_url"), ("bibliography[ref-2]", "year"), ("bibliography[ref-3]", "length")]
    assert found(c, "R.08") == [("bibliography[ref-2]", "")] and found(c, "R.09") == [("bibliography[ref-1]", "2020")]
    assert found(c, "R.11") == [("bibliography", "3")] and found(c, "R.12") == [("bibliography", "min")]
    assert found(c, "R.14") == [("bibliography[ref-2]", "url: no colon"), ("bibliography[ref-3]", "doi: prefix")]
    assert found(c, "R.15") == []


def test_citations_of_sources(spark):
    e = lambda n, **f: {"doc_id": 1, "ordinal": n, "entry_id": f"r{n}", "entry_type": "book", "fields": f}
    entries = [e(1, author="Б"), e(2), e(3, author="А"), e(4, author="В"), e(5, author="Г")]
    c = corpus(spark, entries=entries, blocks=[par(1, "[1, с. 15] и [2: 7], [ 4 - 6 ], [7-9]"), par(2, "см. [1-20005], [0], [99999999999999999999]", style_name="Caption")])
    assert found(c, "R.05") == [("bibliography[r3]", "3"), ("bibliography[r5]", "5")]
    assert found(c, "R.02") == []  # the second entry has no author, so its neighbours are not compared
    assert found(c, "R.02", order="by_mention") == []
    numbers = [int(x[1]) for x in found(c, "C.04") if x[0] == "paragraph[p-2]"]
    assert sorted(numbers)[:-1] == [0, *range(6, 20006)] and max(numbers) > 10**9
    assert found(c, "C.04")[:3] == [("paragraph[p-1]", str(k)) for k in (7, 8, 9)]
    early = corpus(spark, entries=entries[:2], blocks=[par(1, "[2] и [1]")])
    assert found(early, "R.02", order="by_mention") == [("bibliography[r2]", "r1")]


def test_bullets(spark):
    c = corpus(spark, blocks=[obj("list", k, None, ordered=False, items=[f"{m} a"]) for k, m in enumerate("•→·*●x")])
    assert found(c, "L.01") == [("list[list-1]", "→"), ("list[list-2]", "·"), ("list[list-3]", "*")]


def test_abbreviations_and_appendices(spark):
    c = corpus(spark, blocks=[par(1, "АБВ (расшифровка) и потом АБВ, ГОСТ"), par(2, "XYZ тут, Полное имя (КЛМ)"), par(3, "см. приложение В и приложении Я, К.Л.М. и КЛМ")], secs=[sec(1, "Приложение А"), sec(2, "Приложение В"), sec(3, "Приложение z")])
    assert found(c, "A.01") == [("paragraph[p-2]", "XYZ")] and found(c, "A.03") == [("document", "КЛМ")] and found(c, "A.02", threshold=2) == [("document", "4")]
    assert found(c, "P.01") == [("section[s2]", "order В"), ("section[s3]", "latin z")] and found(c, "C.05") == [("paragraph[p-3]", "Я")]
    d = corpus(spark, blocks=[par(1, "АБВ (ГДЕ) и слово (ЖЗИ), ЙКЛ ( ), МНО (не закрыто, 5 (ПРС)")])
    assert found(d, "A.01") == [("paragraph[p-1]", x) for x in ("ЙКЛ", "ПРС")]
    assert [x[0] for x in found(c, "P.02")] == ["section[s1]", "section[s3]"] and [x[0] for x in found(c, "P.04")] == ["section[s3]"]


def test_style_units_volume(spark):
    c = corpus(spark, blocks=[par(1, "Я пишу, как бы, метод. Метод метод хорош"), par(2, "10 кг, 5.м, 1990 г. и 10 г. и 5 с. и 3 кВт"), par(3, "является и осуществляется"), obj("list", 4, None, items=["a b", "c"])])
    assert found(c, "X.02") == [("paragraph[p-1]", "Я")] and found(c, "X.03") == [("paragraph[p-1]", "как бы")] and found(c, "X.06") == [("paragraph[p-3]", "2")]
    assert found(c, "X.08") == [("paragraph[p-1]", "метод")] and found(c, "X.07", max_words=2)[0][0] == "paragraph[p-1]"
    assert found(c, "U.02") == [("paragraph[p-2]", "5.м")] and found(c, "U.03") == [("paragraph[p-2]", "10 г.")] and ("paragraph[p-2]", "3 кВт") in found(c, "U.01")
    assert found(c, "V.01") == [("document", "short")] and found(c, "V.04") == [("document", "figures"), ("document", "tables")]
    assert found(c, "X.05", terms={"Подход": ["метод", "нет"]}) == [("document", "Подход: метод")]


def test_parts_are_the_whole(spark, monkeypatch):
    from folioscope.operators import engine

    monkeypatch.setattr(engine, "RULES", {k: engine.RULES[k] for k in ("T.03", "T.05", "S.02", "R.11", "B.02")})
    c = corpus(spark, secs=[sec(1, "Введение", disabled_checks=["T.03"]), sec(2, "Реферат")], blocks=[par(1, "x", line_spacing=1.0, alignment="left")]).written()
    key = lambda df: sorted(map(tuple, df.collect()))
    parts = list(engine.validate_iter(c))
    assert sorted(x for codes, _ in parts for x in codes) == ["R.11", "S.02", "T.03", "T.05"]
    assert sorted(r for _, f in parts for r in map(tuple, f.collect())) == key(validate(c)) == key(engine.validate_in_parts(c, at_once=2)) == key(engine.validate_in_parts(c))
    assert {r["check_code"] for r in validate(c).collect()} == {"T.05", "S.02", "R.11"}


def test_suppression_severity_and_plugins(spark):
    c = corpus(spark, secs=[sec(1, "Введение", disabled_checks=["T.03"]), sec(2, "под", 2, parent="s1"), sec(10, "Другое", disabled_checks=["*"])],
               blocks=[par(1, "x", line_spacing=1.0, alignment="left", container_id="s2"), par(2, "x", line_spacing=1.0, container_id="s10"), par(3, "x", line_spacing=1.0, container_id="s3")])
    got = {(r["check_code"], r["location"], r["severity"]) for r in validate(c, Profile(severity={"T.05": "info"}), codes=["T.03", "T.05"]).collect()}
    assert got == {("T.03", "paragraph[p-3]", "error"), ("T.05", "paragraph[p-1]", "info")}
    rule_sql("Z.01", "blocks", "block_type = 'paragraph' and length(text) < 2", location="block_id")
    rule_per_document("Z.02", "blocks", lambda pdf, p: pd.DataFrame({"location": ["all"], "detail": [str(len(pdf))]}))
    try:
        assert len(found(c, "Z.01")) == 3 and found(c, "Z.02") == [("all", "3")]
    finally:
        RULES.pop("Z.01"), RULES.pop("Z.02")
