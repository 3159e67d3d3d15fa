"""The rule catalogue: layout, text, structure, numbering, references, style, units, volume.

A rule reads a relation of the corpus and yields findings. Values a file leaves open (null) are inherited and never
a violation. Parameters come from the profile; the defaults below are those of the base profile.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import LEFT, RIGHT, W, blank, collapse, count, find_all, rstrip, strip, words
from folioscope.operators.engine import EMPTY, Rule, local, located, many, one, register, whole
from folioscope.sources.corpus import Corpus, derived

# Fixed values of the base profile.
BODY_FONT, BODY_SIZE, CAPTION_SIZE, NOTE_SIZE = "Times New Roman", 14, 12, 10
MARGINS = {"top": 20.0, "right": 15.0, "bottom": 20.0, "left": 30.0}
FIGURE_FORMAT, TABLE_FORMAT = "Рисунок {num} — {title}", "Таблица {num} — {title}"
REQUIRED_HEADINGS = ["Введение", "Заключение", "Список использованных источников"]
HEADING_ALIASES = {"Список использованных источников": ["Список литературы"]}
EXPECTED_ORDER = ["Реферат", "Содержание", "Перечень сокращений", "Введение", "Заключение", "Список использованных источников", "Приложение"]
INTRO_ELEMENTS = ["актуальность", "цель", "задач", "объект", "предмет"]
TECHNICAL = ["содержание", "перечень сокращений", "реферат"]
STRUCTURAL = [
    "реферат", "содержание", "определения", "термины и определения", "обозначения и сокращения",
    "перечень сокращений и обозначений", "перечень сокращений", "нормативные ссылки", "введение", "заключение",
    "список использованных источников", "список литературы", "список источников", "литература",
]
ALWAYS_ALLOWED = [
    "титульный лист", "реферат", "содержание", "нормативные ссылки", "термины и определения", "определения",
    "обозначения и сокращения", "перечень сокращений и обозначений", "перечень сокращений",
]
FRONT = [
    "реферат", "содержание", "перечень сокращений", "перечень сокращений и обозначений", "обозначения и сокращения",
    "нормативные ссылки", "термины и определения", "определения",
]
TEMPLATE = ["title", "frontmatter", "frontmatter", "main", "appendix"]
APPENDIX_LETTERS = "АБВГДЕЖИКЛМНПРСТУФХЦШЩЭЮЯ"
FORBIDDEN_LETTERS = list("ЁЗЙОЧЬЪЫ")
TEXT_UNITS = ["г", "кг", "мг", "т", "м", "см", "мм", "км", "л", "мл", "ч", "мин", "с", "°C", "%", "шт", "руб", "год", "лет"]
SI_UNITS = [
    "мм", "см", "дм", "м", "км", "нм", "мкм", "mm", "cm", "m", "km", "мкг", "мг", "г", "кг", "т", "g", "kg", "t",
    "мс", "мкс", "нс", "с", "мин", "ч", "сут", "ms", "s", "min", "h", "м²", "м³", "см²", "см³", "л", "мл", "В", "мВ",
    "кВ", "А", "мА", "Ом", "Ω", "Вт", "кВт", "МВт", "V", "mV", "kV", "A", "mA", "W", "kW", "MW", "°C", "°F", "K",
    "°К", "Па", "кПа", "МПа", "ГПа", "бар", "атм", "Pa", "kPa", "MPa", "bar", "atm", "Гц", "кГц", "МГц", "ГГц", "Hz",
    "kHz", "MHz", "GHz", "бит", "Б", "кБ", "МБ", "ГБ", "ТБ", "bit", "B", "KB", "MB", "GB", "TB", "%", "‰", "ppm", "°",
    "рад", "град",
]
KNOWN_ABBREVIATIONS = ["ГОСТ", "ВКР", "НИР", "ЕСКД", "FAQ", "URL", "DOI", "PDF", "XML"]
FIRST_PERSON = [
    "я", "меня", "мне", "мной", "мною", "мой", "моего", "моему", "моим", "моё", "моя", "моей", "моих", "моими",
]
COLLOQUIAL = ["короче", "ну в общем", "то есть так сказать", "как бы", "типа того"]
BUREAUCRATIC = [
    "является", "являются", "осуществляется", "осуществляются", "производится", "производятся",
    r"представляет\s+собой", r"представляют\s+собой", r"в\s+качестве", "осуществить",
]
STOP_WORDS = [
    "быть", "была", "было", "были", "будет", "будут", "этот", "эта", "это", "эти", "того", "тому", "тем", "тех",
    "который", "которая", "которое", "которые", "которого", "также", "более", "менее", "может", "могут", "могла",
    "после", "перед", "между", "через", "около", "если", "когда", "пока", "затем", "потом", "однако", "поэтому",
    "поскольку", "часть", "часто",
]
SUSPICIOUS = ["wikipedia.org", "ru.wikipedia.org", "studopedia.ru", "studwood.net", "studfile.net"]
BULLETS = ["•", "-", "–", "—", "*", "·", "◦", "○", "▪", "■", "►", "→"]
ALLOWED_BULLETS = ["•", "-", "–"]
REQUIRED_FIELDS = {"book": ["author", "year", "place"], "article": ["author", "year"], "web": ["url", "access_date"], "standard": ["year"]}
WEB_MARKERS = ["URL:", "(дата обращения:"]
YEAR = rf"{LEFT}(?:19|20)\d{{2}}{RIGHT}"
#: Codes that exist in the catalogue but find nothing: their position in a file is no part of the model, or their
#: content moved to another rule.
EMPTY_CODES = ["B.02", "B.04", "B.05", "H.07", "I.02", "I.10", "L.03", "M.05", "R.06", "R.07", "S.08", "V.03", "X.01", "X.04"]
#: Off unless a profile turns them on.
OFF = {"R.15", "X.06", "X.07", "X.08"}


def _none(p: dict) -> Column:
    return one(F.lit(False), "info", F.lit(""))


for _code in EMPTY_CODES:
    register(Rule(_code, "docs", local=_none))
EMPTY.update(EMPTY_CODES)


def _is(kind: str) -> Column:
    return F.col("block_type") == kind


def _par() -> Column:
    return located("paragraph", "block_id")


def _page() -> Column:
    return located("page_section", "ps_id")


def _style() -> Column:
    return F.lower(strip(F.coalesce("style_name", F.lit(""))))


def category() -> Column:
    """caption, footnote, header_footer, heading, placeholder or body, by the style and the text of a paragraph."""
    return F.col("category")


def _text_runs() -> Column:
    return F.filter("runs", lambda r: (r["kind"] == "text") & ~blank(r["text"]))


def _differs(col: str, expected: float, tolerance: float) -> Column:
    return F.abs(F.col(col) - F.lit(float(expected))) > tolerance


# --- F: pages ------------------------------------------------------------------------------------------------------


@local("F.01", "pages")
def _f01(p: dict) -> Column:
    want = p.get("margins_mm", MARGINS)
    wrong = [F.when(F.abs(F.col("margins_mm")[s] - F.lit(float(v))) > 0.5, s) for s, v in want.items()]
    return many(F.array_compact(F.array(*wrong)), "error", _page())


@local("F.02", "pages")
def _f02(p: dict) -> Column:
    return one(F.col("paper") != p.get("paper", "A4"), "error", _page(), F.col("paper"))


@local("F.03", "pages")
def _f03(p: dict) -> Column:
    return one((F.col("orientation") != p.get("orientation", "portrait")) & (F.col("ps_type") != "appendix"), "warning", _page(), F.col("orientation"))


def _slots() -> Column:
    return F.array(*[F.coalesce(F.col(side)[s], F.lit("")) for side in ("header", "footer") for s in ("left", "center", "right")])


@local("F.04", "pages")
def _f04(p: dict) -> Column:
    position = p.get("position", "bottom_center")
    m = re.fullmatch(r"(top|bottom)_(left|center|right)", str(position))
    if not m:
        return _none(p)
    here = F.coalesce(F.col({"top": "header", "bottom": "footer"}[m[1]])[m[2]], F.lit("")).contains("{page}")
    some = F.exists(_slots(), lambda s: s.contains("{page}"))
    return one(F.col("visible") & ~here, "error", _page(), F.when(some, F.lit("elsewhere")).otherwise(F.lit("absent")))


@local("F.05", "pages")
def _f05(p: dict) -> Column:
    return one(F.col("visible") & (F.col("format") != p.get("format", "arabic")), "error", _page(), F.col("format"))


@local("F.06", "pages")
def _f06(p: dict) -> Column:
    try:
        want = int(p.get("start_value", 3))
    except (TypeError, ValueError):
        return _none(p)
    return one(F.col("visible") & (F.col("start_mode") == "start_at") & (F.col("start_value") != want), "error", _page(), F.col("start_value"))


@local("F.07", "pages")
def _f07(p: dict) -> Column:
    if not p.get("enabled", True):
        return _none(p)
    gone = ~F.coalesce(F.col("border.enabled"), F.lit(False))
    wrong = F.concat_ws(
        ", ",
        F.when(F.col("border.style") != p.get("style", "single"), F.lit("style")),
        F.when(F.col("border.size").cast("int") != int(p.get("size", 4)), F.lit("size")),
    )
    return one(gone | (wrong != ""), F.when(gone, "error").otherwise("warning"), _page(), F.when(gone, F.lit("missing")).otherwise(wrong))


@local("F.08", "pages")
def _f08(p: dict) -> Column:
    return one(~F.coalesce("title_block", F.lit(False)), "error", _page()) if p.get("enabled", True) else _none(p)


# --- T: body text --------------------------------------------------------------------------------------------------


@local("T.01", "blocks")
def _t01(p: dict) -> Column:
    want = p.get("font", BODY_FONT)
    wrong = F.filter(_text_runs(), lambda r: r["font"] != want)
    return F.when(_is("paragraph") & (category() != "header_footer"), many(F.transform(wrong, lambda r: r["font"]), "error", _par())).otherwise(_none(p))


@local("T.02", "blocks")
def _t02(p: dict) -> Column:
    kind = category()
    want = F.when(kind == "body", float(p.get("body_size", BODY_SIZE))).when(kind == "caption", float(p.get("caption_size", CAPTION_SIZE))).when(kind == "footnote", float(p.get("footnote_size", NOTE_SIZE)))
    wrong = F.filter(_text_runs(), lambda r: F.abs(r["size_pt"] - want) > 0.1)
    return F.when(_is("paragraph"), many(F.transform(wrong, lambda r: r["size_pt"]), "error", _par())).otherwise(_none(p))


def _body(cond: Column, severity: str, detail: Column | str = "") -> Column:
    return one(_is("paragraph") & (category() == "body") & cond, severity, _par(), detail)


@local("T.03", "blocks")
def _t03(p: dict) -> Column:
    return _body(_differs("line_spacing", p.get("line_spacing", 1.5), 0.01), "error", F.col("line_spacing"))


@local("T.04", "blocks")
def _t04(p: dict) -> Column:
    return _body(_differs("first_line_indent_cm", p.get("first_line_indent_cm", 1.25), 0.05), "error", F.col("first_line_indent_cm"))


@local("T.05", "blocks")
def _t05(p: dict) -> Column:
    return _body(F.col("alignment") != p.get("alignment", "justify"), "error", F.col("alignment"))


@local("T.06", "docs")
def _t06(p: dict) -> Column:
    return one(F.col("auto_hyphenation") == F.lit(True), "error", F.lit("document"))


EXPLAINS = rf"(?iu)^\s*(?:где|здесь){RIGHT}"


@derived("lines")
def _lines(c: Corpus) -> DataFrame:
    """Blocks without their content, in order: whether one of the next three explains a formula, and islands of empty paragraphs.

    Islands lie within one container; blocks other than paragraphs do not break them. *island_n* is the size of the
    island, *island_k* the place in it.
    """
    par = _is("paragraph")
    tells = par & F.col("text").rlike(EXPLAINS)
    b = c.relation("blocks").select("doc_id", "block_id", "block_ord", "container_id", "block_type", "number", par.alias("par"), (par & blank("text")).alias("empty"), tells.cast("int").alias("tells"))
    order = ["block_ord", "block_id"]
    box = Window.partitionBy("doc_id", "container_id", "par").orderBy(*order)
    alike = Window.partitionBy("doc_id", "container_id", "par", "empty").orderBy(*order)
    one_ = Window.partitionBy("doc_id", "container_id", "par", "empty", "island")
    next_ = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(1, 3)
    b = b.withColumn("told", F.coalesce(F.max("tells").over(next_), F.lit(0))).withColumn("island", F.row_number().over(box) - F.row_number().over(alike))
    return b.withColumns({"island_n": F.count("*").over(one_), "island_k": F.row_number().over(one_.orderBy(*order))})


@local("T.07", "lines")
def _t07(p: dict) -> Column:
    """Islands of empty paragraphs within one container, told at their first."""
    return one(F.col("empty") & (F.col("island_k") == 1) & (F.col("island_n") > int(p.get("max_consecutive_empty", 1))), "warning", _par(), F.col("island_n"))


@local("T.08", "blocks")
def _t08(p: dict) -> Column:
    hit = F.exists("runs", lambda r: (r["kind"] == "text") & r["text"].rlike("  +"))
    return one(_is("paragraph") & (category() != "header_footer") & hit, "warning", _par())


@local("T.09", "blocks")
def _t09(p: dict) -> Column:
    last = F.try_element_at(F.filter("runs", lambda r: (r["kind"] == "text") & (r["text"] != "")), F.lit(-1))["text"]
    return one(_is("paragraph") & (category() != "header_footer") & last.rlike(r"(?U)\s$"), "info", _par())


@local("T.10", "blocks")
def _t10(p: dict) -> Column:
    n = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    if p.get("allow_inch_marker", False):
        n = n - count("text", r'\d"')
    return one(_is("paragraph") & (n > 0), "warning", _par(), n)


@local("T.11", "blocks")
def _t11(p: dict) -> Column:
    return one(_is("paragraph") & F.col("text").contains(" - "), "warning", _par())


def unit_pattern(units: list[str]) -> str:
    """Number, ordinary space, unit; units that are words end at a word border."""
    names = [re.escape(u) for u in units if u and u[0].isalnum()]
    signs = [re.escape(u) for u in units if u and not u[0].isalnum()]
    alt = "|".join([f"(?:{'|'.join(names)}){RIGHT}"] * bool(names) + [f"(?:{'|'.join(signs)})"] * bool(signs))
    return rf"(?<!\d)\d+(?:[.,]\d+)? (?:{alt})"


@local("T.12", "blocks")
def _t12(p: dict) -> Column:
    n = count("text", unit_pattern(p.get("units", TEXT_UNITS)))
    return one(_is("paragraph") & (n > 0), "info", _par(), n)


@local("T.13", "blocks")
def _t13(p: dict) -> Column:
    n = count("text", r"[А-ЯЁ]\. [А-ЯЁ]\. [А-ЯЁ][а-яё]+")
    return one(_is("paragraph") & (n > 0), "info", _par(), n)


@local("T.14", "blocks")
def _t14(p: dict) -> Column:
    s, t = _style(), float(p.get("tolerance_pt", 0.5))
    skip = F.lit(False)
    for x in ("heading", "caption", "list", "footer", "header", "title"):
        skip = skip | s.startswith(x)
    sides = F.array_compact(
        F.array(
            F.when(_differs("space_before_pt", p.get("expected_before_pt", 0), t), "before"),
            F.when(_differs("space_after_pt", p.get("expected_after_pt", 0), t), "after"),
        )
    )
    return F.when(_is("paragraph") & ~skip, many(sides, "warning", _par())).otherwise(_none(p))


# --- S: structure --------------------------------------------------------------------------------------------------


def _top(c: Corpus) -> DataFrame:
    return c.relation("heads").where("level = 1").withColumn("norm", collapse("text"))


def _sec(key: str = "sec_id") -> Column:
    return located("section", key)


def _names(headings: list[str]) -> list[tuple[str, str]]:
    return [(h, " ".join(n.lower().split())) for h in headings for n in (h, *HEADING_ALIASES.get(h, []))]


@derived("docs_x")
def _docs_x(c: Corpus) -> DataFrame:
    """Documents with what their headings, blocks and entries add up to."""
    norm = collapse("text")
    h = c.relation("heads").groupBy("doc_id").agg(F.collect_set(F.when(F.col("level") == 1, norm)).alias("norms"))
    b = c.relation("blocks").groupBy("doc_id").agg(F.sum(block_words()).alias("words"), F.count_if(_is("figure")).alias("figures"), F.count_if(_is("table")).alias("tables"))
    lang = entry_language()
    e = c.relation("entries").groupBy("doc_id").agg(
        F.count("*").alias("entries"), F.collect_list(_year()).alias("years"), F.avg(F.when(lang.isin("ru", "en"), (lang == "en").cast("double"))).alias("foreign")
    )
    out = c.docs.select("doc_id").join(h, "doc_id", "left").join(b, "doc_id", "left").join(e, "doc_id", "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("words", "figures", "tables", "entries")}
    return out.withColumns(zero | {"norms": F.coalesce("norms", F.array().cast("array<string>"))})


@local("S.01", "docs_x")
def _s01(p: dict) -> Column:
    want = p.get("required_headings", REQUIRED_HEADINGS)
    gone = [F.when(~F.arrays_overlap("norms", F.array(*[F.lit(n) for k, n in _names([h]) if k == h])), h) for h in want]
    return many(F.array_compact(F.array(*gone)) if gone else F.array().cast("array<string>"), "error", F.lit("document"))


def longest_increasing(seq: list[int]) -> set[int]:
    """Positions of the longest increasing subsequence; of several, the one whose end was reached first.

    Costs the length of *seq* times the number of different values in it.
    """
    best: list[int] = []
    prev: list[int | None] = []
    top: dict[int, int] = {}  # per value the first position where the longest subsequence that ends with it ends
    for i, x in enumerate(seq):
        k = max((j for v, j in top.items() if v < x), key=lambda j: (best[j], -j), default=None)
        best.append(1 + (best[k] if k is not None else 0))
        prev.append(k)
        if x not in top or best[i] > best[top[x]]:
            top[x] = i
    if not seq:
        return set()
    at: int | None = max(range(len(seq)), key=lambda j: (best[j], -j))
    out = set()
    while at is not None:
        out.add(at)
        at = prev[at]
    return out


@whole("S.02")
def _s02(c: Corpus, p: dict) -> DataFrame:
    order = [" ".join(h.lower().split()) for h in p.get("expected_order", EXPECTED_ORDER)]
    rank = {n: k for h, n in _names(p.get("expected_order", EXPECTED_ORDER)) for k in [order.index(" ".join(h.lower().split()))]}
    if not rank:
        return c.docs.where("false").select("doc_id", F.lit("error").alias("severity"), F.lit("").alias("location"), F.lit("").alias("detail"))
    named = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    heads = _top(c).where(F.col("norm").isin(*rank)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec_ord", "sec_id", "text", named[F.col("norm")].alias("k")))).alias("s"))
    kind = heads.schema["doc_id"].dataType.simpleString()

    def check(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for doc, s in zip(b["doc_id"], b["s"]):
                keep = longest_increasing([x["k"] for x in s])
                rows += [(doc, x["sec_id"], x["text"]) for k, x in enumerate(s) if k not in keep]
            yield pd.DataFrame(rows, columns=["doc_id", "sec", "detail"])

    found = heads.where(F.size("s") > 1).mapInPandas(check, f"doc_id {kind}, sec string, detail string")
    return found.select("doc_id", F.lit("error").alias("severity"), _sec("sec").alias("location"), "detail", "sec")


@local("S.03", "heads")
def _s03(p: dict) -> Column:
    expected = p.get("expected_headings", [*REQUIRED_HEADINGS, *EXPECTED_ORDER])
    allowed = sorted({n for _, n in _names(expected)} | set(ALWAYS_ALLOWED))
    n = collapse("text")
    free = n.isin(*allowed) | n.startswith("задание") | n.rlike(r"^глава\s+\S+") | n.startswith("приложение") | n.rlike(r"^\d+(\.\d+)*\.?\s+\S") | (n == "")
    return one((F.col("level") == 1) & ~free, "warning", _sec(), F.col("text"))


def _below(c: Corpus) -> DataFrame:
    """(doc_id, root, sec_id) of every section and all sections below it."""
    return c.relation("heads").select("doc_id", "sec_id", F.explode(F.array_union(F.coalesce("path", F.array().cast("array<string>")), F.array("sec_id"))).alias("root"))


def _subtree(c: Corpus, headings: list[str]) -> DataFrame:
    """(doc_id, root, sec_id) of the first level-1 section with one of the headings and all sections below it."""
    w = Window.partitionBy("doc_id").orderBy("sec_ord", "sec_id")
    root = _top(c).where(F.col("norm").isin(*headings)).withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id", F.col("sec_id").alias("root"))
    return root.join(_below(c), ["doc_id", "root"])


@whole("S.04")
def _s04(c: Corpus, p: dict) -> DataFrame:
    tree = _subtree(c, ["введение"])
    par = c.relation("blocks").where(_is("paragraph")).select("doc_id", F.col("container_id").alias("sec_id"), "text")
    sub = c.relation("heads").select("doc_id", "sec_id", "text")
    texts = tree.join(par.unionByName(sub), ["doc_id", "sec_id"]).where("true")
    need = [str(x) for x in p.get("required_elements", INTRO_ELEMENTS)]
    flags = texts.groupBy("doc_id", "root").agg(*[F.bool_or(F.lower("text").contains(x.lower())).alias(f"e{k}") for k, x in enumerate(need)])
    gone = F.array_compact(F.array(*[F.when(~F.coalesce(f"e{k}", F.lit(False)), x) for k, x in enumerate(need)]))
    return flags.select("doc_id", F.lit("warning").alias("severity"), _sec("root").alias("location"), F.explode(gone).alias("detail"), F.col("root").alias("sec"))


@derived("parts")
def _parts(c: Corpus) -> DataFrame:
    """Introduction and conclusion: the first level-1 section so headed, with words and paragraphs of its whole subtree."""
    w = Window.partitionBy("doc_id", "norm").orderBy("sec_ord", "sec_id")
    root = _top(c).where(F.col("norm").isin("введение", "заключение")).withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id", F.col("sec_id").alias("root"), "norm")
    per = c.relation("blocks").groupBy("doc_id", F.col("container_id").alias("sec_id")).agg(F.count_if(_is("paragraph") & ~blank("text")).alias("n"), F.sum(block_words()).alias("w"))
    tree = root.join(_below(c), ["doc_id", "root"]).join(per, ["doc_id", "sec_id"], "left")
    return tree.groupBy("doc_id", "root", "norm").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in (("n", "paragraphs"), ("w", "words"))]).withColumnRenamed("root", "sec")


@local("S.05", "parts")
def _s05(p: dict) -> Column:
    return one((F.col("norm") == "заключение") & (F.col("paragraphs") < int(p.get("min_paragraphs", 3))), "warning", _sec("sec"), F.col("paragraphs"))


@derived("heads_x")
def _heads_x(c: Corpus) -> DataFrame:
    """Headings with their place among those of their level, the level before, and what lies directly below them.

    *par* is the first paragraph, *empty* whether the first block is an empty paragraph, *shown* the number of blocks
    that show something, *subs* that of subsections; all null or 0 where there is none.
    """
    place = F.struct("block_ord", "block_id")
    bold = F.coalesce(F.exists("runs", lambda r: r["bold"] == F.lit(True)), F.lit(False))
    par = F.struct("page_break_before", "style_name", bold.alias("bold"), "text")
    kids = c.relation("blocks").groupBy("doc_id", F.col("container_id").alias("sec_id")).agg(
        F.min_by(par, F.when(_is("paragraph"), place)).alias("par"),
        F.count_if(_is("paragraph")).alias("pars"),
        F.min_by(_is("paragraph") & blank("text"), place).alias("empty"),
        F.count_if(_is("table") | _is("figure") | (_is("paragraph") & ~blank("text"))).alias("shown"),
    )
    heads = c.relation("heads")
    subs = heads.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("sec_id")).agg(F.count("*").alias("subs"))
    w = Window.partitionBy("doc_id").orderBy("sec_ord", "sec_id")
    v = Window.partitionBy("doc_id", "level").orderBy("sec_ord", "sec_id")
    h = heads.select("doc_id", "sec_id", "level", "text", F.lag("level").over(w).alias("before"), F.row_number().over(v).alias("nth"))
    out = h.join(kids, ["doc_id", "sec_id"], "left").join(subs, ["doc_id", "sec_id"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("pars", "shown", "subs")})


@local("S.06", "heads_x")
def _s06(p: dict) -> Column:
    own = (F.col("level") == int(p.get("required_for_level", 1))) & (F.col("nth") > 1)
    return one(own & (F.col("par.page_break_before") == F.lit(False)), "error", _sec(), F.col("text"))


@local("S.07", "heads_x")
def _s07(p: dict) -> Column:
    return one((F.col("level") == 1) & ~collapse("text").isin(*TECHNICAL) & (F.col("shown") == 0) & (F.col("subs") == 0), "warning", _sec(), F.col("text"))


# --- H: headings ---------------------------------------------------------------------------------------------------


def _heading_format(level: int, upper: bool):  # noqa: ANN202
    def rule(p: dict) -> Column:
        font, size, bold, color = p.get("font", BODY_FONT), float(p.get("size_pt", BODY_SIZE)), p.get("bold", True), p.get("color", "000000")
        t = strip("text")
        case = F.when(F.lit(p.get("upper", upper)) & (t != F.upper(t)), F.array(F.lit("case"))).otherwise(F.array().cast("array<string>"))
        runs = F.filter("heading", lambda r: (r["kind"] == "text") & ~blank(r["text"]))
        per = F.flatten(
            F.transform(
                runs,
                lambda r: F.array_compact(
                    F.array(
                        F.when(r["font"] != font, "font"),
                        F.when(F.abs(r["size_pt"] - size) > 0.1, "size"),
                        F.when((r["bold"] == F.lit(False)) & F.lit(bold), "bold"),
                        F.when(~F.coalesce(F.nullif(r["color_hex"], F.lit("auto")), F.lit("000000")).isin(color), "color"),
                    )
                ),
            )
        )
        return F.when((F.col("level") == level) & (t != ""), many(F.concat(case, per), "error", _sec())).otherwise(_none(p))

    return rule


local("H.01", "heads")(_heading_format(1, True))
local("H.02", "heads")(_heading_format(2, False))


@local("H.03", "heads")
def _h03(p: dict) -> Column:
    return one(F.col("text").rlike(r"^\d+(\.\d+)*\.\s"), "error", _sec(), F.regexp_extract("text", r"^(\d+(\.\d+)*)\.\s", 1))


@whole("H.04")
def _h04(c: Corpus, p: dict) -> DataFrame:
    n = F.regexp_replace(collapse("text"), r"\.+$", "")
    own = c.relation("heads").where("level = 1").where(~n.isin(*STRUCTURAL) & ~n.startswith("приложение"))
    num = F.nullif(F.regexp_extract(F.regexp_replace("text", r"(?U)^\s+", ""), r"^(\d+)(?:\.\d+)*\.?\s", 1), F.lit("")).try_cast("int")
    w = Window.partitionBy("doc_id").orderBy("sec_ord", "sec_id")
    own = own.withColumn("num", num).withColumn("k", F.row_number().over(w))
    place = F.struct("sec_ord", "sec_id")
    per = own.groupBy("doc_id").agg(
        F.count("num").alias("numbered"),
        F.count("*").alias("n"),
        F.min_by("sec_id", F.when(F.col("num").isNull(), place)).alias("plain"),
        F.min_by(F.struct("sec_id", "num", "k"), F.when(F.col("num") != F.col("k"), place)).alias("wrong"),
    )
    mixed = F.col("numbered") < F.col("n")
    hit = per.where("numbered > 0").where(mixed | F.col("wrong").isNotNull())
    sec = F.when(mixed, F.col("plain")).otherwise(F.col("wrong.sec_id"))
    detail = F.when(mixed, F.lit("mixed")).otherwise(F.concat_ws(",", F.col("wrong.k"), F.col("wrong.num")))
    return hit.select("doc_id", F.when(mixed, "warning").otherwise("error").alias("severity"), located("section", sec).alias("location"), detail.alias("detail"), sec.alias("sec"))


@local("H.05", "heads_x")
def _h05(p: dict) -> Column:
    return one(F.col("level") > F.col("before") + 1, "error", _sec(), F.concat_ws(",", "before", "level"))


@local("H.06", "heads_x")
def _h06(p: dict) -> Column:
    """Headings with nothing under them, or with an empty paragraph first."""
    nothing = F.col("empty").isNull() & (F.col("subs") == 0)
    return one(~blank("text") & (nothing | F.coalesce("empty", F.lit(False))), "warning", _sec(), F.when(nothing, "nothing").otherwise("empty"))


@local("H.08", "heads")
def _h08(p: dict) -> Column:
    return one(rstrip("text").rlike(r"(\.|…)$"), "warning", _sec(), F.col("text"))


# --- I, B, M: figures, tables, formulas ----------------------------------------------------------------------------

FIGURE_NUMBER, TABLE_NUMBER = r"^Рис(?:унок)?\.?\s+(\d+)", r"^Таблица\s+(\d+)"


def caption_pattern(fmt: str) -> str | None:
    """Pattern of a caption format: {num} a number (or letter and number), {title} any text, dashes interchangeable."""
    if "{num}" not in fmt or "{title}" not in fmt:
        return None
    out = []
    for part in re.split(r"(\{num\}|\{title\})", fmt):
        if part == "{num}":
            out.append(r"(?:[А-Я]\.)?\d+(?:\.\d+)*")
        elif part == "{title}":
            out.append(r"\S.*")
        else:
            out.append("".join("[—–-]" if ch in "—–-" else re.escape(ch) for ch in part))
    return "^" + "".join(out) + r"\s*$"


def _caption_rules(kind: str, block: str, missing: str, fmt_code: str, dash_code: str, fmt: str, prefix: str) -> None:
    def where() -> Column:
        return located(block, "block_id")

    @local(missing, "blocks")
    def _missing(p: dict) -> Column:
        return one(_is(block) & blank("text"), "error", where())

    @local(fmt_code, "blocks")
    def _format(p: dict) -> Column:
        pattern = caption_pattern(p.get("format", fmt)) or rf"^{prefix}\s+\d+(?:\.\d+)?\s+[—–-]\s+\S"
        good = strip("text").rlike(pattern)
        if p.get("allow_dot_after_number", False):
            good = good | strip("text").rlike(rf"^{prefix}\s+\d+(?:\.\d+)?\.\s+\S")
        return one(_is(block) & ~blank("text") & ~good, "error", where(), F.col("text"))

    @local(dash_code, "blocks")
    def _dash(p: dict) -> Column:
        m = re.search(r"\{num\}(.*?)\{title\}", p.get("format", fmt))
        want = next((ch for ch in (m[1] if m else "") if ch in "—–-"), None)
        if want is None:
            return _none(p)
        got = F.nullif(F.regexp_extract(strip("text"), rf"^{prefix}\s+\d+(?:\.\d+)?\s*([—–-])\s*\S", 1), F.lit(""))
        return one(_is(block) & (got != want), "info", where(), got)


_caption_rules("figure", "figure", "I.01", "I.03", "I.11", FIGURE_FORMAT, "Рис(?:унок)?")
_caption_rules("table", "table", "B.01", "B.03", "B.12", TABLE_FORMAT, "Таблица")


@local("I.04", "blocks")
def _i04(p: dict) -> Column:
    sizes = F.array_distinct(F.transform(_text_runs(), lambda r: r["size_pt"]))
    wrong = F.filter(sizes, lambda s: F.abs(s - float(p.get("caption_size_pt", CAPTION_SIZE))) > 0.1)
    return F.when(_is("figure"), many(wrong, "warning", located("figure", "block_id"))).otherwise(_none(p))


@derived("objects")
def _objects(c: Corpus) -> DataFrame:
    """Figures, tables and formulas that bear a number, in order within their kind.

    *nth* counts equal numbers, *first_id* is the first of them; *expected* is one more than the last new number (the first
    should be 1; a duplicate does not move the count, after a break it goes on from the number found).
    """
    caption = strip("text")
    num = F.when(_is("figure"), F.regexp_extract(caption, FIGURE_NUMBER, 1)).when(_is("table"), F.regexp_extract(caption, TABLE_NUMBER, 1)).otherwise(F.regexp_extract(F.coalesce("number", F.lit("")), r"(\d+)", 1))
    b = c.relation("blocks").where(F.col("block_type").isin("figure", "table", "formula"))
    b = b.select("doc_id", F.col("block_type").alias("kind"), "block_id", "block_ord", F.col("container_id").alias("sec"), F.nullif(num, F.lit("")).try_cast("int").alias("num")).where("num is not null")
    return number_breaks(b, ["doc_id", "kind"], ["block_ord", "block_id"], "num", "block_id")


def number_breaks(items: DataFrame, partition: list[str], order: list[str], num: str, key: str) -> DataFrame:
    """*items* with nth, first_id and expected, as explained at the relation objects."""
    w = Window.partitionBy(*partition, num).orderBy(*order)
    seen = items.withColumns({"nth": F.row_number().over(w), "first_id": F.first(key).over(w)})
    v = Window.partitionBy(*partition, F.col("nth") == 1).orderBy(*order)
    return seen.withColumn("expected", F.coalesce(F.lag(num).over(v), F.lit(0)) + 1)


def _continuity(kind: str):  # noqa: ANN202
    def rule(p: dict) -> Column:
        again = F.col("nth") > 1
        detail = F.when(again, F.concat_ws(" ", F.lit("duplicate of"), "first_id")).otherwise(F.concat_ws(",", "expected", "num"))
        return one((F.col("kind") == kind) & (again | (F.col("num") != F.col("expected"))), "error", located(kind, "block_id"), detail)

    return rule


# How running text refers to a numbered object; group 1 is the number or letter.
MENTIONS = {
    "figure": r"(?iu)рис(?:унок|унке|унков|унках|унка|унку|унком)?\.?\s+(\d+)",
    "table": r"(?iu)табл(?:ица|ице|ицу|иц|ицах|ицы)?\.?\s*(\d+)",
    "formula": rf"(?iu){LEFT}формул(?:а|е|у|ы|ой|ах|ам)?\s+\(?(\d+)\)?",
    "bare": r"(?<![A-Za-zА-Яа-яЁё])\((\d+)\)",
    "appendix": rf"(?iu)(?:приложени[еияй]|прил\.)\s+([А-Яа-яЁё]){RIGHT}",
    "citation": r"\[(\d+(?:\s*[-–]\s*\d+|\s*,\s*\d+)*)\]",
    "lead": r"\[\s*(\d+)\s*[,\-–\]:]",
}
CAPTION_START = r"(?iu)^\s*(?:Рисунок|Таблица)\s+\d+\s*[—–-]"


@derived("refs", shared=True)
def _refs(c: Corpus) -> DataFrame:
    """(doc_id, block_id, block_ord, sec, kind, pos, ref): every reference in running text, of all kinds in one scan.

    Captions refer to themselves and count for sources only. The kind `citation` holds all numbers of a bracket, `lead`
    the first number of a bracket that may say more behind it.
    """
    own = F.col("text").rlike(CAPTION_START) | (category() == "caption")

    def hits(kind: str, pattern: str) -> Column:
        texts = find_all("text", pattern, 1)
        if kind not in ("citation", "lead"):
            texts = F.when(own, F.array().cast("array<string>")).otherwise(texts)
        return F.transform(texts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), (F.upper(x) if kind == "appendix" else x).alias("ref")))

    found = [hits(kind, pattern) for kind, pattern in MENTIONS.items()]
    par = c.relation("blocks").where(_is("paragraph"))
    return par.select("doc_id", "block_id", "block_ord", F.col("container_id").alias("sec"), F.inline(F.concat(*found)))


def _named_refs(c: Corpus) -> DataFrame:
    """References to figures, tables, formulas and appendices with the kind and the key of their target."""
    r = c.relation("refs").where(F.col("kind").isin("figure", "table", "formula", "bare", "appendix"))
    key = F.when(F.col("kind") == "appendix", F.col("ref")).otherwise(F.col("ref").try_cast("int").cast("string"))
    return r.withColumns({"target": F.when(F.col("kind") == "bare", "formula").otherwise(F.col("kind")), "key": key})


def _targets(c: Corpus) -> DataFrame:
    """(doc_id, target, key, id, ord, sec, letter): what running text can refer to: numbered objects and lettered appendices."""
    o = c.relation("objects").select("doc_id", F.col("kind").alias("target"), F.col("num").cast("string").alias("key"), F.col("block_id").alias("id"), F.col("block_ord").alias("ord"), "sec", F.lit(None).cast("string").alias("letter"))
    a = appendices(c).where("letter is not null")
    return o.unionByName(a.select("doc_id", F.lit("appendix").alias("target"), F.upper("letter").alias("key"), F.col("sec_id").alias("id"), F.col("sec_ord").alias("ord"), F.col("sec_id").alias("sec"), "letter"))


@derived("targets_x")
def _targets_x(c: Corpus) -> DataFrame:
    """Targets with the place of their first mention in *said*, null if there is none."""
    first = _named_refs(c).groupBy("doc_id", "target", "key").agg(F.min("block_ord").alias("said"))
    return _targets(c).join(first, ["doc_id", "target", "key"], "left")


@derived("refs_x")
def _refs_x(c: Corpus) -> DataFrame:
    """References whose target does not exist. A bare number in brackets counts only where formulas are numbered."""
    have = _targets(c).select("doc_id", "target", "key").distinct()
    some = have.where("target = 'formula'").select("doc_id").distinct()
    left = _named_refs(c).join(have, ["doc_id", "target", "key"], "left_anti")
    return left.where("kind <> 'bare'").unionByName(left.where("kind = 'bare'").join(some, "doc_id", "left_semi").select(*left.columns))


def _object_rules(kind: str, continuity: str, referenced: str, precedes: str | None, severity: str) -> None:
    local(continuity, "objects")(_continuity(kind))

    @local(referenced, "targets_x")
    def _referenced(p: dict) -> Column:
        return one((F.col("target") == kind) & F.col("said").isNull(), severity, located(kind, "id"), F.col("key"))

    if precedes:

        @local(precedes, "targets_x")
        def _precedes(p: dict) -> Column:
            return one((F.col("target") == kind) & (F.col("said") > F.col("ord")), "warning", located(kind, "id"), F.col("key"))


_object_rules("figure", "I.05", "I.06", "I.07", "error")
_object_rules("table", "B.09", "B.08", "B.11", "error")
_object_rules("formula", "M.03", "M.04", None, "warning")


@local("I.08", "blocks")
def _i08(p: dict) -> Column:
    return one(_is("figure") & (F.col("dpi") < int(p.get("min_dpi", 150))), "warning", located("figure", "block_id"), F.col("dpi"))


@local("I.09", "blocks")
def _i09(p: dict) -> Column:
    return one(_is("figure") & (F.col("alignment") != p.get("alignment", "center")), "warning", located("figure", "block_id"), F.col("alignment"))


def _cells() -> Column:
    return F.flatten(F.concat(F.coalesce("headers", F.array().cast("array<array<struct<text:string,size_pt:double>>>")), F.coalesce("rows", F.array().cast("array<array<struct<text:string,size_pt:double>>>"))))


@local("B.06", "blocks")
def _b06(p: dict) -> Column:
    bad = F.try_element_at(F.filter(_cells(), lambda x: x["size_pt"] != float(p.get("cell_font_size_pt", 12))), F.lit(1))["size_pt"]
    return one(_is("table") & bad.isNotNull(), "warning", located("table", "block_id"), bad)


@local("B.07", "blocks")
def _b07(p: dict) -> Column:
    skip = 1 if p.get("allow_first_column_empty", False) else 0
    grid = F.concat(F.slice(F.coalesce("headers", F.array().cast("array<array<struct<text:string,size_pt:double>>>")), 1, 1), F.coalesce("rows", F.array().cast("array<array<struct<text:string,size_pt:double>>>")))
    flat = F.flatten(F.transform(grid, lambda r, i: F.transform(r, lambda x, j: F.when(blank(x["text"]) & (j >= skip), F.concat_ws(",", i, j)))))
    bad = F.try_element_at(F.array_compact(flat), F.lit(1))
    return one(_is("table") & bad.isNotNull(), "info", located("table", "block_id"), bad)


@local("B.10", "blocks")
def _b10(p: dict) -> Column:
    some = F.coalesce(F.exists(F.flatten("rows"), lambda x: ~blank(x["text"])), F.lit(False))
    return one(_is("table") & F.col("rows").isNotNull() & ~some, "warning", located("table", "block_id"))


@local("M.01", "blocks")
def _m01(p: dict) -> Column:
    return one(_is("formula") & ~blank("latex") & blank("number"), "error" if p.get("required", False) else "warning", located("formula", "block_id"))


@local("M.02", "lines")
def _m02(p: dict) -> Column:
    return one(_is("formula") & ~blank("number") & (F.col("told") == 0), "warning", located("formula", "block_id"), F.col("number"))


# --- L: lists ------------------------------------------------------------------------------------------------------


@local("L.01", "blocks")
def _l01(p: dict) -> Column:
    mark = F.substring(F.regexp_replace(F.try_element_at("items", F.lit(1)), r"(?U)^\s+", ""), 1, 1)
    return one(_is("list") & ~F.col("ordered") & mark.isin(*BULLETS) & ~mark.isin(*p.get("allowed_markers", ALLOWED_BULLETS)), "warning", located("list", "block_id"), mark)


def list_format(item: Column) -> Column:
    """paren, dot or bare, by how an item is numbered; null when it is not."""
    return F.when(item.rlike(r"^\s*\d+\s*\)"), "paren").when(item.rlike(r"^\s*\d+\s*\."), "dot").when(item.rlike(r"^\s*\d+\s+"), "bare")


@whole("L.02")
def _l02(c: Corpus, p: dict) -> DataFrame:
    """Ordered lists not of the commonest format of their document; of equally common ones the first seen wins."""
    lists = c.relation("blocks").where(_is("list") & F.col("ordered")).select("doc_id", "block_id", "block_ord", F.col("container_id").alias("sec"), list_format(F.try_element_at("items", F.lit(1))).alias("fmt")).where("fmt is not null")
    per = lists.groupBy("doc_id", "fmt").agg(F.count("*").alias("n"), F.min("block_ord").alias("first"))
    mode = per.groupBy("doc_id").agg(F.max_by("fmt", F.struct("n", -F.col("first"))).alias("mode"))
    return lists.join(mode, "doc_id").where("fmt <> mode").select("doc_id", F.lit("warning").alias("severity"), located("list", "block_id").alias("location"), F.col("fmt").alias("detail"), "sec")


def end_mark(item: Column) -> Column:
    last = F.right(rstrip(item), F.lit(1))
    return F.when(last.isin(".", ";", "?", "!"), last).otherwise(F.lit(" "))


@local("L.04", "blocks")
def _l04(p: dict) -> Column:
    marks = F.array_sort(F.array_distinct(F.transform("items", end_mark)))
    return one(_is("list") & (F.size("items") >= 2) & (F.size(marks) > 1), "info", located("list", "block_id"), F.array_join(marks, ","))


# --- R: bibliography -----------------------------------------------------------------------------------------------


def _entry() -> Column:
    return located("bibliography", "entry_id")


def _field(name: str) -> Column:
    return F.nullif(F.col("fields")[name], F.lit(""))


def _year() -> Column:
    return strip(_field("year")).try_cast("int")


@local("R.01", "blocks")
def _r01(p: dict) -> Column:
    found = F.concat(find_all("text", r"\([А-ЯЁ][а-яё]+,\s*\d{4}\)"), find_all("text", r"\[[А-ЯЁ][а-яё]+\s+\d{4}\]"))
    return F.when(_is("paragraph"), many(found, "error", _par())).otherwise(_none(p))


def citations(c: Corpus) -> DataFrame:
    """(doc_id, num, block_ord, run_ord, pos) of all citations that name a source by its number, in text and as inline elements.

    In text the first number of a bracket counts, whatever follows it: [3], [3, с. 15], [3-5], [3: 7].
    """
    b = c.relation("blocks").where(_is("paragraph"))
    runs = b.select("doc_id", "block_ord", F.inline(F.transform(F.filter("runs", lambda r: r["kind"] == "citation"), lambda r: F.struct(r["run_ord"].alias("run_ord"), strip(r["source_id"]).alias("entry_id")))))
    inline = runs.join(c.relation("entries").select("doc_id", "entry_id", F.col("ordinal").alias("num")), ["doc_id", "entry_id"])
    text = c.relation("refs").where("kind = 'lead'").select("doc_id", F.col("ref").try_cast("int").alias("num"), "block_ord", F.lit(0).alias("run_ord"), "pos").where("num is not null")
    return inline.select("doc_id", "num", "block_ord", "run_ord", F.lit(0).alias("pos")).unionByName(text)


@whole("R.02")
def _r02(c: Corpus, p: dict) -> DataFrame:
    """The first neighbouring pair of entries out of order, one per document; a pair with an unknown side is left out."""
    w = Window.partitionBy("doc_id").orderBy("ordinal", "entry_id")
    e = c.relation("entries")
    if p.get("order", "alphabetical") == "by_mention":
        first = citations(c).groupBy("doc_id", F.col("num").alias("ordinal")).agg(F.min(F.struct("block_ord", "run_ord", "pos")).alias("key"))
        e = e.join(first, ["doc_id", "ordinal"], "left")
    else:
        e = e.withColumn("key", F.lower(_field("author")))
    bad = e.select("doc_id", "ordinal", "entry_id", "key", F.lag("key").over(w).alias("before"), F.lag("entry_id").over(w).alias("before_id")).where("before > key")
    one_ = bad.groupBy("doc_id").agg(F.min_by(F.struct("entry_id", "before_id"), F.struct("ordinal", "entry_id")).alias("f"))
    return one_.select("doc_id", F.lit("warning").alias("severity"), located("bibliography", F.col("f.entry_id")).alias("location"), F.col("f.before_id").alias("detail"))


@local("R.03", "entries")
def _r03(p: dict) -> Column:
    need = p.get("required_by_type", REQUIRED_FIELDS)
    gone = [F.when((F.col("entry_type") == t) & _field(f).isNull(), f) for t, fs in need.items() for f in fs]
    return many(F.array_compact(F.array(*gone)) if gone else F.array().cast("array<string>"), "error", _entry())


@local("R.04", "entries")
def _r04(p: dict) -> Column:
    raw = F.coalesce(strip(F.col("fields")["raw"]), F.lit(""))
    has = lambda marks: F.greatest(*[raw.contains(m) for m in marks])
    aspects = F.array_compact(
        F.array(
            F.when(F.lit(p.get("require_year", True)) & ~raw.rlike(YEAR), "year"),
            F.when(F.lit(p.get("require_final_dot", True)) & ~raw.endswith("."), "final_dot"),
            F.when(F.lit(p.get("require_separator", True)) & ~has(["—", "–", "/", ":"]), "separator"),
            F.when(F.lit(p.get("require_url_marker_for_web", True)) & (F.col("entry_type") == "web") & ~has(WEB_MARKERS), "web_url"),
        )
    )
    return many(F.when(F.length(raw) < int(p.get("min_length", 15)), F.array(F.lit("length"))).otherwise(aspects), "error", _entry())


@whole("R.05")
def _r05(c: Corpus, p: dict) -> DataFrame:
    said = citations(c).select("doc_id", F.col("num").alias("ordinal"))
    return c.relation("entries").join(said, ["doc_id", "ordinal"], "left_anti").select("doc_id", F.lit("warning").alias("severity"), _entry().alias("location"), F.col("ordinal").alias("detail"))


@local("R.08", "entries")
def _r08(p: dict) -> Column:
    return one(((F.col("entry_type") == "web") | _field("url").isNotNull()) & _field("access_date").isNull(), "error", _entry())


@local("R.09", "entries")
def _r09(p: dict) -> Column:
    return one((strip(_field("year")).try_cast("int") >= int(p.get("modern_year", 2020))) & _field("doi").isNull() & _field("url").isNull(), "info", _entry(), _field("year"))


@local("R.10", "docs_x")
def _r10(p: dict) -> Column:
    fresh = F.size(F.filter("years", lambda y: y >= int(p.get("fresh_year_threshold", 2015))))
    share = F.try_divide(fresh, F.size("years"))
    return one(share < float(p.get("min_fresh_share", 0.5)), "warning", F.lit("bibliography"), F.round(share, 6))


@local("R.11", "docs_x")
def _r11(p: dict) -> Column:
    return one(F.col("entries") < int(p.get("min_sources", 20)), "warning", F.lit("bibliography"), F.col("entries"))


def entry_language() -> Column:
    """The language field of an entry, else by the script its description begins with."""
    raw = F.coalesce(strip(F.col("fields")["raw"]), F.lit(""))
    return F.coalesce(_field("language"), F.when(raw.rlike(r"^[А-ЯЁа-яё]"), "ru").when(raw.rlike(r"^[A-Za-z]"), "en"))


@local("R.12", "docs_x")
def _r12(p: dict) -> Column:
    low, high = float(p.get("min_foreign_share", 0.1)), float(p.get("max_foreign_share", 0.5))
    share = F.col("foreign")
    return one((share < low) | (share > high), "info", F.lit("bibliography"), F.when(share < low, "min").otherwise("max"))


@local("R.13", "entries")
def _r13(p: dict) -> Column:
    names = F.array(*[F.lit(str(d)) for d in p.get("suspicious_domains", SUSPICIOUS)])
    hit = F.try_element_at(F.filter(names, lambda d: F.lower(_field("url")).contains(F.lower(d))), F.lit(1))
    return one(hit.isNotNull(), "warning", _entry(), hit)


def diagnose_doi(v: Column) -> Column:
    """What is wrong with a DOI: blanks, a link around it, the prefix, the slash or the rest; null if nothing."""
    return (
        F.when(v.isNull() | (v == ""), None)
        .when(v != strip(v), "outer blanks")
        .when(v.rlike(r"[ \t]"), "inner blanks")
        .when(v.rlike(r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/10\.\d{4,9}/\S+$"), "link")
        .when(v.rlike(r"^10\.\d{4,9}/\S+$"), None)
        .when(~v.startswith("10."), "prefix")
        .when(~v.contains("/"), "slash")
        .otherwise("form")
    )


def diagnose_url(v: Column) -> Column:
    """What is wrong with a URL: blanks, slips in the scheme, the scheme or the rest; null if nothing."""
    return (
        F.when(v.isNull() | (v == ""), None)
        .when(v != strip(v), "outer blanks")
        .when(v.rlike(r"[ \t]"), "inner blanks")
        .when(v.rlike(r"(?i)^https?//"), "no colon")
        .when(v.rlike(r"(?i)^https?:/[^/]"), "one slash")
        .when(v.rlike(r"(?i)^https?;//"), "semicolon")
        .when(v.rlike(r"(?i)^htps://"), "htps")
        .when(v.rlike(r"(?i)^htp://"), "htp")
        .when(v.rlike(r"(?i)^https?://[^\s/$.?#].\S*$"), None)
        .when(~v.rlike(r"(?i)^https?://"), "scheme")
        .otherwise("form")
    )


@local("R.14", "entries")
def _r14(p: dict) -> Column:
    wrong = [F.when(x.isNotNull(), F.concat(F.lit(n), x)) for n, x in (("doi: ", diagnose_doi(_field("doi"))), ("url: ", diagnose_url(_field("url"))))]
    return many(F.array_compact(F.array(*wrong)), "warning", _entry())


@whole("R.15")
def _r15(c: Corpus, p: dict) -> DataFrame:
    """URLs that do not answer. *fetch* (url -> bool) is given by the caller; without it nothing is asked."""
    fetch, most = p.get("fetch"), int(p.get("max_urls", 50))
    url = _field("url")
    w = Window.partitionBy("doc_id").orderBy("ordinal", "entry_id")
    urls = c.relation("entries").where(diagnose_url(url).isNull() & url.isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("doc_id", "entry_id", url.alias("url"))
    if fetch is None:
        urls = urls.where("false")
        return urls.select("doc_id", F.lit("warning").alias("severity"), _entry().alias("location"), F.col("url").alias("detail"))

    def ask(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b[[not fetch(u) for u in b["url"]]]

    return urls.mapInPandas(ask, urls.schema).select("doc_id", F.lit("warning").alias("severity"), _entry().alias("location"), F.col("url").alias("detail"))


# --- C: cross-references -------------------------------------------------------------------------------------------


for _code, _kind in (("C.01", "figure"), ("C.02", "table"), ("C.03", "formula"), ("C.05", "appendix")):

    @local(_code, "refs_x")
    def _dangling(p: dict, kind: str = _kind) -> Column:
        return one(F.col("target") == kind, "error", _par(), F.col("ref") if kind == "appendix" else F.col("key"))


#: Numbers made in one step when a range of citations is spelled out.
_STEP = 10_000


@whole("C.04")
def _c04(c: Corpus, p: dict) -> DataFrame:
    """Every number cited in brackets beyond the entries; ranges stay pairs of ends and only what lies outside is spelled out.

    Both ends of a range that runs backwards count alone.
    """
    n = c.relation("entries").groupBy("doc_id").agg(F.count("*").alias("n"))
    token = F.explode(F.regexp_extract_all("ref", F.lit(r"(\d+(?:\s*[-–]\s*\d+)?)"), F.lit(1))).alias("token")
    t = c.relation("refs").where("kind = 'citation'").select("doc_id", "block_id", "sec", token).join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ends = F.transform(F.split("token", r"\s*[-–]\s*"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(2**62)))
    t = t.withColumn("ends", ends).withColumns({"a": F.col("ends")[0], "b": F.element_at("ends", -1)})
    span = lambda lo, hi: F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    outside = F.when(F.col("b") < F.col("a"), F.array(span(F.col("a"), F.col("a")), span(F.col("b"), F.col("b")))).otherwise(F.array(span(F.col("a"), F.col("b"))))
    parts = F.flatten(F.transform(outside, lambda s: F.array(span(s["lo"], F.least(s["hi"], F.lit(0))), span(F.greatest(s["lo"], F.col("n") + 1), s["hi"]))))
    t = t.select("doc_id", "block_id", "sec", F.inline(F.filter(parts, lambda s: s["lo"] <= s["hi"])))
    t = t.select("doc_id", "block_id", "sec", "hi", F.explode(F.sequence("lo", "hi", F.lit(_STEP).cast("bigint"))).alias("lo"))
    bad = t.select("doc_id", "block_id", "sec", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + _STEP - 1))).alias("num"))
    return bad.select("doc_id", F.lit("error").alias("severity"), _par().alias("location"), F.col("num").alias("detail"), "sec")


def appendices(c: Corpus) -> DataFrame:
    """Level-1 sections headed as an appendix, with the letter they bear (null without one)."""
    letter = F.nullif(F.regexp_extract("text", rf"^\s*Приложение\s+([A-Za-zА-ЯЁа-яё]){RIGHT}", 1), F.lit(""))
    return c.relation("heads").where("level = 1").where(F.col("text").rlike(rf"(?iu)^\s*Приложение{RIGHT}")).withColumn("letter", letter)


@whole("C.06")
def _c06(c: Corpus, p: dict) -> DataFrame:
    """Inline references with a blank target (error), or with a target that no block, section or entry bears."""
    b = c.relation("blocks")
    refs = b.select("doc_id", "block_id", F.col("container_id").alias("sec"), F.inline(F.transform(F.filter("runs", lambda r: r["kind"].isin("xref", "citation")), lambda r: F.struct(r["kind"].alias("kind"), F.coalesce(strip(F.when(r["kind"] == "xref", r["target_id"]).otherwise(r["source_id"])), F.lit("")).alias("key")))))
    keys = (
        b.select("doc_id", F.lit("xref").alias("kind"), F.col("block_id").alias("key"))
        .unionByName(c.relation("heads").select("doc_id", F.lit("xref").alias("kind"), F.col("sec_id").alias("key")))
        .unionByName(c.relation("entries").select("doc_id", F.lit("citation").alias("kind"), F.col("entry_id").alias("key")))
    )
    bad = refs.join(keys, ["doc_id", "kind", "key"], "left_anti")
    return bad.select("doc_id", F.when(F.col("key") == "", "error").otherwise("warning").alias("severity"), _par().alias("location"), F.concat_ws(" ", "kind", "key").alias("detail"), "sec")


# --- A: abbreviations ----------------------------------------------------------------------------------------------

ABBREVIATION = rf"{LEFT}([A-ZА-ЯЁ]{{2,10}}){RIGHT}"
#: What explains an abbreviation: brackets that show something right behind it, or a word and a bracket right before it.
BEHIND = rf"{ABBREVIATION}(?=([\s\p{{Z}}]*\([^)]*[^\s\p{{Z}})][^)]*\))?)"
BEFORE = r"[A-Za-zА-Яа-яЁё][\s\p{Z}]*\([\s\p{Z}]*$"


@derived("abbreviations", shared=True)
def abbreviations(c: Corpus) -> DataFrame:
    """(doc_id, block_ord, block_id, sec, pos, abbr, told): capital words of 2 to 10 letters, in order, and whether the text explains them there.

    The paragraph is cut at each of them, so what stands before one needs no positions.
    """
    par = c.relation("blocks").where(_is("paragraph") & F.col("text").rlike(ABBREVIATION))
    par = par.select(
        "doc_id", "block_ord", "block_id", F.col("container_id").alias("sec"),
        find_all("text", ABBREVIATION, 1).alias("a"), find_all("text", BEHIND, 2).alias("b"), F.split("text", ABBREVIATION, -1).alias("s"),
    )

    def item(x: Column, i: Column) -> Column:
        before = F.concat(F.when(i > 0, F.element_at("a", F.greatest(i, F.lit(1)))).otherwise(""), F.element_at("s", i + 1))
        return F.struct(i.alias("pos"), x.alias("abbr"), ((F.element_at("b", i + 1) != "") | before.rlike(BEFORE)).alias("told"))

    return par.select("doc_id", "block_ord", "block_id", "sec", F.inline(F.transform("a", item)))


@whole("A.01")
def _a01(c: Corpus, p: dict) -> DataFrame:
    known = [*KNOWN_ABBREVIATIONS, *p.get("known_abbreviations", [])]
    first = c.relation("abbreviations").where(~F.col("abbr").isin(*known)).groupBy("doc_id", "abbr").agg(F.min_by(F.struct("block_id", "sec", "told"), F.struct("block_ord", "block_id", "pos")).alias("f"))
    return first.where("not f.told").select("doc_id", F.lit("warning").alias("severity"), located("paragraph", F.col("f.block_id")).alias("location"), F.col("abbr").alias("detail"), F.col("f.sec").alias("sec"))


@whole("A.02")
def _a02(c: Corpus, p: dict) -> DataFrame:
    listed = c.relation("heads").where(collapse("text").rlike("список сокращений|перечень сокращений|обозначения и сокращения")).select("doc_id")
    n = c.relation("abbreviations").groupBy("doc_id").agg(F.count_distinct("abbr").alias("n")).where(F.col("n") > int(p.get("threshold", 5)))
    return n.join(listed, "doc_id", "left_anti").select("doc_id", F.lit("warning").alias("severity"), F.lit("document").alias("location"), F.col("n").alias("detail"))


@whole("A.03")
def _a03(c: Corpus, p: dict) -> DataFrame:
    par = c.relation("blocks").where(_is("paragraph"))
    form = par.select("doc_id", F.explode(find_all("text", rf"{LEFT}(?:[A-ZА-ЯЁ]{{2,10}}{RIGHT}|(?:[A-ZА-ЯЁ]\.\s?){{2,10}})")).alias("form")).withColumn("form", strip("form"))
    per = form.groupBy("doc_id", F.upper(F.regexp_replace("form", r"[.\s]", "")).alias("letters")).agg(F.count_distinct("form").alias("n"))
    return per.where("n > 1").select("doc_id", F.lit("info").alias("severity"), F.lit("document").alias("location"), F.col("letters").alias("detail"))


# --- P: appendices -------------------------------------------------------------------------------------------------


@whole("P.01")
def _p01(c: Corpus, p: dict) -> DataFrame:
    """Letters that may not mark an appendix, and the first that is out of sequence."""
    forbidden = p.get("forbidden_letters", FORBIDDEN_LETTERS)
    place = F.instr(F.lit(APPENDIX_LETTERS), F.col("letter"))
    problem = (
        F.when(F.col("letter").rlike("[A-Za-z]"), "latin")
        .when(F.col("letter") != F.upper("letter"), "lowercase")
        .when(F.col("letter").isin(*forbidden), "forbidden")
        .when(place == 0, "unknown")
    )
    rows = appendices(c).where("letter is not null").select("doc_id", "sec_id", "sec_ord", "letter", place.alias("place"), problem.alias("problem"))
    w = Window.partitionBy("doc_id").orderBy("sec_ord", "sec_id")
    good = rows.where("problem is null").withColumn("k", F.row_number().over(w)).where("k <> place")
    first = good.groupBy("doc_id").agg(F.min_by(F.struct("sec_id", "letter"), F.struct("sec_ord", "sec_id")).alias("f")).select("doc_id", F.col("f.sec_id").alias("sec_id"), F.col("f.letter").alias("letter"), F.lit("order").alias("problem"))
    both = rows.where("problem is not null").select("doc_id", "sec_id", "letter", "problem").unionByName(first)
    return both.select("doc_id", F.lit("error").alias("severity"), _sec().alias("location"), F.concat_ws(" ", "problem", "letter").alias("detail"), F.col("sec_id").alias("sec"))


@local("P.02", "targets_x")
def _p02(p: dict) -> Column:
    return one((F.col("target") == "appendix") & F.col("said").isNull(), "error", _sec("id"), F.col("letter"))


def _appendix() -> Column:
    return (F.col("level") == 1) & F.col("text").rlike(rf"(?iu)^\s*Приложение{RIGHT}")


@local("P.03", "heads_x")
def _p03(p: dict) -> Column:
    return one(_appendix() & (F.col("par.page_break_before") == F.lit(False)), "error", _sec(), F.col("text"))


@local("P.04", "heads")
def _p04(p: dict) -> Column:
    t = F.col("text")
    return one((F.col("level") == 1) & t.rlike(rf"(?iu)^\s*Приложение{RIGHT}") & ~strip(t).rlike(r"^Приложение\s+[А-Я](?:\s+\S.*|\.\s+\S.*|$)"), "warning", _sec(), t)


@local("P.05", "heads_x")
def _p05(p: dict) -> Column:
    plain = ~F.lower(F.coalesce(F.col("par.style_name"), F.lit(""))).startswith("heading") & ~F.col("par.bold")
    return one(_appendix() & (F.col("pars") > 0) & plain, "warning", _sec(), F.col("par.text"))


# --- K: page sections ----------------------------------------------------------------------------------------------


def longest_common(a: list[str], b: list[str]) -> list[int]:
    """Positions in *a* of a longest common subsequence with *b*."""
    n, m = len(a), len(b)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif size[i - 1][j] >= size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@whole("K.01")
def _k01(c: Corpus, p: dict) -> DataFrame:
    """Section types of the template that are absent, or present at another place (where two types or more are laid out)."""
    template = p.get("template", TEMPLATE)
    major = ["title", "frontmatter", "main", "appendix"]
    pages = c.pages.where(F.col("ps_type").isin(*major)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ps_ord", "ps_type"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["ps_type"]).alias("pages"))
    n = F.regexp_replace(collapse("text"), r"\.+$", "")
    kind = F.when(n == "титульный лист", "title").when(n.startswith("приложение"), "appendix").when(n.isin(*FRONT) | n.startswith("задание"), "frontmatter").when(n != "", "main")
    heads = c.relation("heads").where("level = 1").groupBy("doc_id").agg(F.collect_set(kind).alias("heads"))
    per = c.docs.select("doc_id").join(pages, "doc_id", "left").join(heads, "doc_id", "left")
    type_ = per.schema["doc_id"].dataType.simpleString()
    want = [t for t in template if t in major]

    def check(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for doc, pages_, heads_ in zip(b["doc_id"], b["pages"], b["heads"]):
                seq = list(pages_) if pages_ is not None else []
                have = set(seq) | set(heads_ if heads_ is not None else [])
                rows += [(doc, f"absent {t}") for t in want if t not in have]
                if len(set(seq)) >= 2:
                    fits = set(longest_common(want, seq))
                    rows += [(doc, f"order {t}") for k, t in enumerate(want) if k not in fits and t in seq]
            yield pd.DataFrame(rows, columns=["doc_id", "detail"])

    return per.mapInPandas(check, f"doc_id {type_}, detail string").select("doc_id", F.lit("error").alias("severity"), F.lit("page_sections").alias("location"), "detail")


@local("K.02", "pages")
def _k02(p: dict) -> Column:
    return one((F.col("ps_type") == "title") & F.col("visible"), "error", _page())


@derived("pages_x")
def _pages_x(c: Corpus) -> DataFrame:
    """Page sections with their place *k*, and *main_k*: 1 for the first main section, else the first that is no title."""
    w = Window.partitionBy("doc_id")
    rank = F.when(F.col("ps_type") == "main", 0).when(F.col("ps_type") != "title", 1).otherwise(2)
    return c.pages.withColumns({"k": F.row_number().over(w.orderBy("ps_ord", "ps_id")), "main_k": F.when(rank < 2, F.row_number().over(w.orderBy(rank, "ps_ord", "ps_id")))})


@local("K.03", "pages_x")
def _k03(p: dict) -> Column:
    mode = ~F.coalesce("start_mode", F.lit("")).eqNullSafe("start_at")
    wrong = ~F.col("start_value").eqNullSafe(int(p.get("expected_start_value", 3)))
    return one((F.col("main_k") == 1) & (mode | wrong), "error", _page(), F.when(mode, F.lit("mode")).otherwise(F.coalesce(F.col("start_value").cast("string"), F.lit("none"))))


@local("K.04", "pages_x")
def _k04(p: dict) -> Column:
    free = (F.col("ps_type") == "appendix") if p.get("allow_restart_in_appendix", False) else F.lit(False)
    return one((F.col("k") > 1) & (F.col("start_mode") == "restart") & ~free, "error", _page(), F.col("ps_type"))


@local("K.05", "pages")
def _k05(p: dict) -> Column:
    heads = F.array(*[F.coalesce(F.col("header")[s], F.lit("")) for s in ("left", "center", "right")])
    good = F.exists(heads, lambda s: F.lower(s).contains("приложение") | s.contains("{appendix_letter}"))
    return one((F.col("ps_type") == "appendix") & ~good, "warning", _page())


@local("K.06", "pages_x")
def _k06(p: dict) -> Column:
    return one((F.col("k") > 1) & F.col("link_to_previous") & ~F.col("ps_type").isin(*p.get("exclude_types", [""])), "warning", _page(), F.col("ps_type"))


# --- V: volume -----------------------------------------------------------------------------------------------------


def block_words() -> Column:
    """Words a block adds to the volume: paragraphs, list items and table captions."""
    return F.when(_is("list"), F.aggregate("items", F.lit(0), lambda a, x: a + words(x))).when(_is("paragraph") | _is("table"), words("text_x")).otherwise(0)


@local("V.01", "docs_x")
def _v01(p: dict) -> Column:
    pages = F.col("words") / float(p.get("words_per_page", 250))
    low, high = float(p.get("min_pages", 25)), float(p.get("max_pages", 50))
    return one((pages < low) | (pages > high), "warning", F.lit("document"), F.when(pages < low, "short").otherwise("long"))


@local("V.02", "parts")
def _v02(p: dict) -> Column:
    low = F.when(F.col("norm") == "введение", int(p.get("intro_min_words", 800))).otherwise(int(p.get("conclusion_min_words", 500)))
    high = F.when(F.col("norm") == "введение", int(p.get("intro_max_words", 1500))).otherwise(int(p.get("conclusion_max_words", 1200)))
    return one((F.col("words") < low) | (F.col("words") > high), "warning", _sec("sec"), F.col("words"))


@local("V.04", "docs_x")
def _v04(p: dict) -> Column:
    tens = F.greatest(F.col("words") / float(p.get("words_per_page", 250)) / 10, F.lit(1.0))
    few = F.array_compact(
        F.array(
            F.when(F.col("figures") < float(p.get("min_figures_per_10_pages", 1)) * tens, "figures"),
            F.when(F.col("tables") < float(p.get("min_tables_per_10_pages", 1)) * tens, "tables"),
        )
    )
    return many(few, "info", F.lit("document"))


# --- X: style, U: units --------------------------------------------------------------------------------------------


@local("X.02", "blocks")
def _x02(p: dict) -> Column:
    hit = F.nullif(F.regexp_extract("text_x", rf"(?iu){LEFT}({'|'.join(FIRST_PERSON)}){RIGHT}", 1), F.lit(""))
    return one(_is("paragraph") & hit.isNotNull(), "warning", _par(), hit)


@local("X.03", "blocks")
def _x03(p: dict) -> Column:
    found = [F.when(F.lower("text_x").contains(str(x).lower()), str(x)) for x in p.get("banned_phrases", COLLOQUIAL) if str(x).strip()]
    return F.when(_is("paragraph"), many(F.array_compact(F.array(*found)), "info", _par())).otherwise(_none(p)) if found else _none(p)


@whole("X.05")
def _x05(c: Corpus, p: dict) -> DataFrame:
    """Terms whose other names occur anywhere in a document; flags per paragraph, so no text is gathered."""
    terms = [(t, [a for a in al if a]) for t, al in (p.get("terms") or {}).items()]
    b = c.relation("blocks").where(_is("paragraph"))
    cols = {f"t{k}_{j}": F.bool_or(F.lower("text").contains(a.lower())) for k, (_, al) in enumerate(terms) for j, a in enumerate(al)}
    if not cols:
        return b.where("false").select("doc_id", F.lit("info").alias("severity"), F.lit("").alias("location"), F.lit("").alias("detail"))
    flags = b.groupBy("doc_id").agg(*[v.alias(n) for n, v in cols.items()])
    used = [F.array_join(F.array_compact(F.array(*[F.when(F.col(f"t{k}_{j}"), a) for j, a in enumerate(al)])), ", ") for k, (_, al) in enumerate(terms)]
    found = F.array_compact(F.array(*[F.when(u != "", F.concat(F.lit(f"{t}: "), u)) for (t, _), u in zip(terms, used)]))
    return flags.select("doc_id", F.lit("info").alias("severity"), F.lit("document").alias("location"), F.explode(found).alias("detail"))


@local("X.06", "blocks")
def _x06(p: dict) -> Column:
    patterns = [rf"(?iu){LEFT}{x}{RIGHT}" for x in BUREAUCRATIC] + [f"(?iu){x}" for x in p.get("custom_patterns", [])]
    n = sum((count("text", x) for x in patterns), F.lit(0))
    return one(_is("paragraph") & (n > int(p.get("max_per_paragraph", 1))), "info", _par(), n)


SENTENCE_END = r"(?<=[.!?])\s+(?=[А-ЯA-Z])"


@local("X.07", "blocks")
def _x07(p: dict) -> Column:
    long = F.filter(F.transform(F.split("text", SENTENCE_END, -1), words), lambda n: n > int(p.get("max_words", 35)))
    return F.when(_is("paragraph"), many(long, "info", _par())).otherwise(_none(p))


@local("X.08", "blocks")
def _x08(p: dict) -> Column:
    """Words of four letters or more that come again within a few such words; each once per paragraph."""
    s = _style()
    kept = F.filter(F.transform(find_all("text", "[А-Яа-яёЁA-Za-z]+"), F.lower), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    back = int(p.get("min_distance", 3)) - 1
    if back < 1:
        return _none(p)
    near = F.transform(kept, lambda w, i: F.when((i > 0) & F.array_contains(F.slice(kept, F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), w), w))
    return F.when(_is("paragraph") & ~s.startswith("heading") & ~s.startswith("caption"), many(F.array_distinct(F.array_compact(near)), "info", _par())).otherwise(_none(p))


_UNITS = "|".join(re.escape(u) for u in sorted(SI_UNITS, key=len, reverse=True))
_EDGE = r"(?=[\s.,;:!?)\]/\-]|$)"


@local("U.01", "blocks")
def _u01(p: dict) -> Column:
    return F.when(_is("paragraph"), many(find_all("text", rf"\d+ (?:{_UNITS}){_EDGE}"), "warning", _par())).otherwise(_none(p))


@local("U.02", "blocks")
def _u02(p: dict) -> Column:
    return F.when(_is("paragraph"), many(find_all("text", rf"\d+[.,](?:{_UNITS}){_EDGE}"), "error", _par())).otherwise(_none(p))


@local("U.03", "blocks")
def _u03(p: dict) -> Column:
    """A full stop behind a unit; г. after 1500 or more is a year, с. a page."""
    found = find_all("text", rf"\d+[\s\u00a0]?(?:{_UNITS})\.{_EDGE}")
    unit = lambda m: F.regexp_extract(m, r"^\d+[\s\u00a0]?(.*)\.$", 1)
    year = lambda m: (unit(m) == "г") & (F.regexp_extract(m, r"^(\d+)", 1).try_cast("bigint") >= 1500)
    return F.when(_is("paragraph"), many(F.filter(found, lambda m: (unit(m) != "с") & ~year(m)), "warning", _par())).otherwise(_none(p))
