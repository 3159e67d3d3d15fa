from test_rules import corpus, obj, par, run, sec

from folioscope.operators.engine import Profile, validate
from folioscope.operators.fixers import FIXERS, fix


def texts(c, frame="blocks", col="runs", key="block_id"):
    return {r[key]: "".join(x["text"] or "" for x in r[col]).replace("\u00a0", " ") for r in getattr(c, frame).collect()}


def sample(spark):
    page = {"doc_id": 1, "ps_ord": 1, "ps_id": "m", "ps_type": "main", "paper": "A3", "orientation": "landscape", "margins_mm": {"top": 25.0, "left": 30.0}, "visible": True, "format": "roman", "start_mode": "restart", "start_value": None, "header": ("{page}", None, None), "footer": (None, None, None)}
    return corpus(
        spark,
        pages=[page, page | {"ps_ord": 2, "ps_id": "n", "link_to_previous": True}],
        secs=[sec(1, "Введение."), sec(2, "2 Обзор"), sec(3, "Часть", 2, parent="s2"), sec(4, "Итог…")],
        blocks=[par(1, run("Текст  два ", font="Arial", size_pt=10.0), line_spacing=1.0, first_line_indent_cm=0.0, alignment="left", space_before_pt=5.0), par(2, 'он сказал "да" - 10 кг и 5.м, А. Б. Иванов, 10 г. и 1990 г. и 3 м.'),
                par(3, ""), par(4, " "), obj("table", 5, None), par(6, ""), obj("list", 7, None, ordered=False, items=["a;", "b", "c!"])],
    )


def test_all_fixers_repair_and_repeat_to_nothing(spark):
    assert len(FIXERS) == 35
    c, log = fix(sample(spark))
    assert {r["fixer_code"] for r in log.collect()} >= {"F.01", "F.02", "F.03", "F.04", "F.05", "F.07", "F.08", "K.03", "K.04", "K.06", "H.04", "H.08", "T.01", "T.02", "T.03", "T.04", "T.05", "T.07", "T.08", "T.09", "T.10", "T.11", "T.12", "T.13", "T.14", "L.04", "U.02", "U.03"}
    t = texts(c)
    assert t["p-1"] == "Текст два" and t["p-2"] == "он сказал «да» — 10 кг и 5 м, А. Б. Иванов, 10 г и 1990 г. и 3 м"
    assert set(t) == {"p-1", "p-2", "p-3", "table-5", "p-6", "list-7"}
    assert [r["items"] for r in c.blocks.where("block_type = 'list'").collect()] == [["a;", "b;", "c."]]
    assert texts(c, "secs", "heading", "sec_id") == {"s1": "Введение", "s2": "1 Обзор", "s3": "1.1 Часть", "s4": "2 Итог"}
    again, log2 = fix(c, codes=["T.08", "T.10", "T.12", "U.03", "L.04", "H.04"])
    assert log2.count() == 0 and texts(again) == t
    assert validate(c, codes=["T.02", "T.03", "T.08", "T.10", "T.11", "U.02", "H.08"], suppress=False).count() == 0


def test_numbers_of_any_depth_and_below_structural_headings(spark):
    chain = [sec(k, f"H{k}", k, path=[f"s{j}" for j in range(1, k + 1)], parent=f"s{k - 1}" if k > 1 else None) for k in range(1, 8)]
    more = [sec(10, "3 Введение"), sec(11, "7 под", 2, parent="s10"), sec(12, "Вывод"), sec(13, "Заключение", 2, parent="s12"), sec(14, "b", 2, parent="s12"), sec(15, " ", 2, parent="s12")]
    c, log = fix(corpus(spark, secs=[*chain, *more]), codes=["H.04"])
    t = texts(c, "secs", "heading", "sec_id")
    assert [t[f"s{k}"] for k in range(1, 8)] == [".".join(["1"] * k) + f" H{k}" for k in range(1, 8)]
    assert (t["s10"], t["s11"], t["s12"], t["s13"], t["s14"], t["s15"]) == ("Введение", "7 под", "2 Вывод", "Заключение", "2.1 b", " ")
    assert {r["location"] for r in log.collect()} == {*[f"s{k}" for k in range(1, 8)], "s10", "s12", "s14"}


def test_full_stop_of_the_last_run_that_shows_text(spark):
    heads = [sec(1, "", heading=[run("Итог."), run("", "text")]), sec(2, "", heading=[run("Итог…"), run(None, "citation")]), sec(3, "", heading=[run("a."), run("b?")])]
    c, _ = fix(corpus(spark, secs=heads), codes=["H.08"])
    assert texts(c, "secs", "heading", "sec_id") == {"s1": "Итог", "s2": "Итог", "s3": "a.b?"}


def test_choice_of_fixers(spark):
    c = sample(spark)
    _, log = fix(c, Profile(disabled={"T.03"}), codes=["T.03", "none"])
    assert {r["fixer_code"] for r in log.collect()} == {"T.03"}
    _, log = fix(c, codes=[])
    assert log.count() == 0
