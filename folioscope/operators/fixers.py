"""Rewrites that repair what rules find, with a log of what changed.

A fixer gives new values for columns of a frame of the corpus. The log is the difference between before and after,
taken in the same pass, so fixing twice logs nothing the second time. Fixers run in order; later ones see what earlier
ones wrote.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import RIGHT, blank, collapse, strip, text_of
from folioscope.operators import rules as R
from folioscope.operators.engine import Profile
from folioscope.session import materialize
from folioscope.sources.corpus import Corpus


@dataclass(frozen=True)
class Fixer:
    """*columns* gives new values for columns of *frame*, *gone* the rows that are dropped.

    *prepare* adds to the frame what the new values need beyond the row.
    """

    code: str
    frame: str
    columns: Callable[[dict], dict[str, Column]] | None = None
    gone: Callable[[dict], Column] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None


FIXERS: dict[str, Fixer] = {}
KEYS = {"docs": "doc_id", "pages": "ps_id", "secs": "sec_id", "blocks": "block_id"}


def _add(f: Fixer) -> None:
    if f.code in FIXERS:
        raise ValueError(f"{f.code} is registered already")
    FIXERS[f.code] = f


def columns(code: str, frame: str, prepare: Callable[[DataFrame], DataFrame] | None = None):  # noqa: ANN201
    return lambda fn: _add(Fixer(code, frame, columns=fn, prepare=prepare)) or fn


def gone(code: str, frame: str, prepare: Callable[[DataFrame], DataFrame] | None = None):  # noqa: ANN201
    return lambda fn: _add(Fixer(code, frame, gone=fn, prepare=prepare)) or fn


def registered_fixers() -> list[str]:
    """The codes that can be fixed, sorted."""
    return sorted(FIXERS)


def fix(c: Corpus, profile: Profile | None = None, codes: list[str] | None = None) -> tuple[Corpus, DataFrame]:
    """The repaired corpus and the log (doc_id, fixer_code, location).

    *codes* runs exactly those, even if the profile disables them; unknown codes are skipped. All fixers of a frame are
    one pass over it: each step adds the new values and a flag whether they differ, the frame is written once, and the
    log is read from the flags.
    """
    profile = profile or Profile()
    names = [x for x in (codes if codes is not None else sorted(FIXERS)) if x in FIXERS and (codes is not None or x not in profile.disabled)]
    by: dict[str, list[Fixer]] = {}
    for x in names:
        by.setdefault(FIXERS[x].frame, []).append(FIXERS[x])
    logs = []
    for frame, fixers in by.items():
        before = getattr(c, frame)
        df = before.withColumns({"__fixed": F.array().cast("array<string>"), "__gone": F.lit(False)})
        for f in fixers:
            df = _step(df, f, profile.of(f.code))
        after = materialize(df.select(*before.columns, "__fixed", "__gone"), f"fixed-{frame}")
        logs.append(after.select("doc_id", F.explode("__fixed").alias("fixer_code"), F.col(KEYS[frame]).cast("string").alias("location")))
        c = replace(c, **{frame: after.where("not __gone").select(*before.columns)}, made={})
    empty = c.docs.where("false").select("doc_id", F.lit("").alias("fixer_code"), F.lit("").alias("location"))
    return c, reduce(DataFrame.unionByName, logs, empty)


def _step(df: DataFrame, f: Fixer, p: dict) -> DataFrame:
    """*df* after one fixer, whose code joins __fixed where it changed something; rows already dropped stay as they are."""
    if f.prepare:
        df = f.prepare(df)
    if f.gone:
        drop = ~F.col("__gone") & F.coalesce(f.gone(p), F.lit(False))
        df = df.withColumn("__now", drop)
        return df.withColumns({"__fixed": F.when(F.col("__now"), F.array_append("__fixed", F.lit(f.code))).otherwise(F.col("__fixed")), "__gone": F.col("__gone") | F.col("__now")}).drop("__now")
    new = f.columns(p)
    kinds = {k: df.schema[k].dataType for k in new}
    df = df.withColumns({f"__new_{k}": v.cast(kinds[k]) for k, v in new.items()})

    def shape(k: str) -> Column:  # maps cannot be compared
        return F.to_json(k) if isinstance(kinds[k.removeprefix("__new_")], T.MapType) else F.col(k)

    moved = reduce(lambda a, b: a | b, [~shape(k).eqNullSafe(shape(f"__new_{k}")) for k in new])
    df = df.withColumn("__fixed", F.when(moved & ~F.col("__gone"), F.array_append("__fixed", F.lit(f.code))).otherwise(F.col("__fixed")))
    return df.withColumns({k: F.col(f"__new_{k}") for k in new}).drop(*[f"__new_{k}" for k in new])


def _set(code: str, frame: str, column: str, wrong: Callable[[dict], Column], value: Callable[[dict], object]) -> None:
    @columns(code, frame)
    def _f(p: dict) -> dict[str, Column]:
        return {column: F.when(wrong(p), F.lit(value(p))).otherwise(F.col(column))}


def _type(kind: str = "paragraph") -> Column:
    return F.col("block_type") == kind


def _runs_text() -> Column:
    return text_of("runs")


def _category() -> Column:
    s = R._style()  # noqa: SLF001
    t = strip(_runs_text())
    return (
        F.when(s.startswith("caption") | s.startswith("название"), "caption").when(s == "footnote text", "footnote").when(s.isin("header", "footer"), "header_footer")
        .when(s.startswith("heading") | s.isin("title", "subtitle"), "heading").when(t.startswith("[Рисунок:") | t.startswith("[Таблица:"), "placeholder").otherwise("body")
    )


# pages
@columns("F.01", "pages")
def _f01(p: dict) -> dict[str, Column]:
    want = p.get("margins_mm", R.MARGINS)
    goal = F.create_map(*[F.lit(x) for k, v in want.items() for x in (k, float(v))])
    return {"margins_mm": F.transform_values("margins_mm", lambda k, v: F.when(F.abs(v - F.try_element_at(goal, k)) > 0.5, F.try_element_at(goal, k)).otherwise(v))}


_set("F.02", "pages", "paper", lambda p: F.col("paper") != p.get("paper", "A4"), lambda p: p.get("paper", "A4"))
_set("F.03", "pages", "orientation", lambda p: (F.col("orientation") != p.get("orientation", "portrait")) & (F.col("ps_type") != "appendix"), lambda p: p.get("orientation", "portrait"))
_set("F.05", "pages", "format", lambda p: F.col("visible") & (F.col("format") != p.get("format", "arabic")), lambda p: p.get("format", "arabic"))
_set("F.06", "pages", "start_value", lambda p: F.col("visible") & (F.col("start_mode") == "start_at") & (F.col("start_value") != int(p.get("start_value", 3))), lambda p: int(p.get("start_value", 3)))
_set("F.08", "pages", "title_block", lambda p: ~F.coalesce("title_block", F.lit(False)), lambda p: True)
_set("K.02", "pages", "visible", lambda p: (F.col("ps_type") == "title") & F.col("visible"), lambda p: False)


@columns("F.04", "pages")
def _f04(p: dict) -> dict[str, Column]:
    m = re.fullmatch(r"(top|bottom)_(left|center|right)", str(p.get("position", "bottom_center")))
    if not m:
        return {"header": F.col("header"), "footer": F.col("footer")}
    side, slot = {"top": "header", "bottom": "footer"}[m[1]], m[2]
    out = {}
    for s in ("header", "footer"):
        cells = []
        for x in ("left", "center", "right"):
            old = F.col(s)[x]
            plain = F.nullif(F.replace(old, F.lit("{page}"), F.lit("")), F.lit(""))
            new = F.when(old.contains("{page}"), old).otherwise(F.concat(F.coalesce(old, F.lit("")), F.lit("{page}"))) if (s, x) == (side, slot) else F.when(old.contains("{page}"), plain).otherwise(old)
            cells.append(new.alias(x))
        fresh = F.struct(*cells)
        keep = F.col(s).isNull() if s != side else F.lit(False)
        out[s] = F.when(F.coalesce("visible", F.lit(False)) & ~keep, fresh).otherwise(F.col(s))
    return out


@columns("F.07", "pages")
def _f07(p: dict) -> dict[str, Column]:
    goal = F.struct(F.lit(True).alias("enabled"), F.lit(p.get("style", "single")).alias("style"), F.lit(float(p.get("size", 4))).alias("size"))
    good = F.coalesce(F.col("border.enabled") & (F.col("border.style") == p.get("style", "single")) & (F.col("border.size").cast("int") == int(p.get("size", 4))), F.lit(False))
    return {"border": F.when(good, F.col("border")).otherwise(goal)}


def _later() -> Column:
    return F.row_number().over(Window.partitionBy("doc_id").orderBy("ps_ord", "ps_id")) > 1


@columns("K.03", "pages")
def _k03(p: dict) -> dict[str, Column]:
    rank = F.when(F.col("ps_type") == "main", 0).when(F.col("ps_type") != "title", 1).otherwise(2)
    first = (F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "ps_ord", "ps_id")) == 1) & (rank < 2)
    return {"start_mode": F.when(first, F.lit("start_at")).otherwise(F.col("start_mode")), "start_value": F.when(first, F.lit(int(p.get("expected_start_value", 3)))).otherwise(F.col("start_value"))}


@columns("K.04", "pages")
def _k04(p: dict) -> dict[str, Column]:
    free = (F.col("ps_type") == "appendix") if p.get("allow_restart_in_appendix", False) else F.lit(False)
    return {"start_mode": F.when(_later() & (F.col("start_mode") == "restart") & ~free, F.lit("continue")).otherwise(F.col("start_mode"))}


@columns("K.06", "pages")
def _k06(p: dict) -> dict[str, Column]:
    bad = _later() & F.col("link_to_previous") & ~F.col("ps_type").isin(*p.get("exclude_types", [""]))
    return {"link_to_previous": F.when(bad, F.lit(False)).otherwise(F.col("link_to_previous"))}


# headings
def _heading(level: int):  # noqa: ANN202
    def f(p: dict) -> dict[str, Column]:
        size = float(p.get("size_pt", R.BODY_SIZE))

        def run(r: Column) -> Column:
            out = r.withField("font", F.when(r["font"].isNotNull(), F.lit(p.get("font", R.BODY_FONT))))
            out = out.withField("size_pt", F.when(F.abs(r["size_pt"] - size) > 0.1, size).otherwise(r["size_pt"]))
            out = out.withField("bold", F.when(r["bold"] == F.lit(False), F.lit(True)).otherwise(r["bold"])) if p.get("bold", True) else out
            return out.withField("color_hex", F.when(r["color_hex"].isin("auto", p.get("color", "000000")), r["color_hex"]))

        fixed = F.transform("heading", lambda r: F.when((r["kind"] == "text") & ~blank(r["text"]), run(r)).otherwise(r))
        return {"heading": F.when(F.col("level") == level, fixed).otherwise(F.col("heading"))}

    return f


columns("H.01", "secs")(_heading(1))
columns("H.02", "secs")(_heading(2))


def _edit_run(frame_col: str, index: Column, edit: Callable[[Column], Column]) -> Column:
    return F.transform(frame_col, lambda r, i: F.when(i == index, r.withField("text", edit(r["text"]))).otherwise(r))


@columns("H.03", "secs")
def _h03(p: dict) -> dict[str, Column]:
    return {"heading": _edit_run("heading", F.lit(0), lambda t: F.regexp_replace(t, r"^(\d+(?:\.\d+)*)\.(\s)", "$1$2"))}


@columns("H.08", "secs")
def _h08(p: dict) -> dict[str, Column]:
    last = F.array_max(F.transform("heading", lambda r, i: F.when((r["kind"] == "text") & (F.coalesce(r["text"], F.lit("")) != ""), i)))
    return {"heading": _edit_run("heading", last, lambda t: F.regexp_replace(t, r"(?U)(\.\.\.|\.|…)(\s*)$", "$2"))}


def _plain() -> Column:
    return F.array_join(F.transform(F.filter("heading", lambda r: r["kind"] == "text"), lambda r: F.coalesce(r["text"], F.lit(""))), "")


def _bare() -> Column:
    return F.regexp_replace(_plain(), r"(?iu)^(?:(?:глава|раздел|часть)\s+)?\d+(?:\.\d+)*\.?\s+", "")


def _structural() -> Column:
    n = F.regexp_replace(collapse(_bare()), r"\.+$", "")
    return n.isin(*R.STRUCTURAL) | n.startswith("приложение")


def _numbered(df: DataFrame) -> DataFrame:
    """*df* with __number: 1, 1.1, 1.1.1 ... by the places among the numbered siblings, at any depth; null below structural sections.

    The places of a section and its ancestors are joined by the path, so no level needs a pass of its own.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_id", "__s").orderBy("sec_ord", "sec_id"))
    own = df.where("not __gone").select("doc_id", "sec_id", "parent_id", "sec_ord", "path", _structural().alias("__s")).withColumn("place", place)
    path = F.when(F.size(F.coalesce("path", F.array())) > 0, F.col("path")).otherwise(F.array("sec_id"))
    up = own.select("doc_id", "sec_id", F.posexplode(path).alias("at", "up"))
    ranks = own.select("doc_id", F.col("sec_id").alias("up"), "place", "__s")
    per = up.join(ranks, ["doc_id", "up"]).groupBy("doc_id", "sec_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "place"))).alias("r"), F.max(F.when(F.col("up") != F.col("sec_id"), F.col("__s"))).alias("inside")
    )
    number = F.array_join(F.transform("r", lambda x: x["place"].cast("string")), ".")
    per = per.select("doc_id", "sec_id", F.when(~F.coalesce("inside", F.lit(False)), number).alias("__number"))
    return df.drop("__number").join(per, ["doc_id", "sec_id"], "left")


@columns("H.04", "secs", prepare=_numbered)
def _h04(p: dict) -> dict[str, Column]:
    """Number headings 1, 1.1, 1.1.1 in order; structural ones lose their number, and what is below them stays as it is."""
    plain, bare = _plain(), _bare()
    text = F.when(_structural(), bare).otherwise(F.concat("__number", F.lit(" "), bare))
    one = F.transform(F.slice("heading", 1, 1), lambda r: r.withField("text", text))
    return {"heading": F.when(F.col("__number").isNotNull() & (F.trim(bare) != "") & (text != plain), one).otherwise(F.col("heading"))}


# paragraphs
def _text_runs(edit: Callable[[Column], Column], only: Column | None = None) -> dict[str, Column]:
    ok = _type() if only is None else _type() & only
    fixed = F.transform("runs", lambda r: F.when(r["kind"] == "text", r.withField("text", edit(r["text"]))).otherwise(r))
    return {"runs": F.when(ok, fixed).otherwise(F.col("runs"))}


def _visible() -> Column:
    return F.filter("runs", lambda r: (r["kind"] == "text") & (F.coalesce(r["text"], F.lit("")) != ""))


@columns("T.01", "blocks")
def _t01(p: dict) -> dict[str, Column]:
    font = p.get("font", R.BODY_FONT)
    fixed = F.transform("runs", lambda r: F.when((r["kind"] == "text") & ~blank(r["text"]) & (r["font"] != font), r.withField("font", F.lit(font))).otherwise(r))
    return {"runs": F.when(_type() & (_category() != "header_footer"), fixed).otherwise(F.col("runs"))}


@columns("T.02", "blocks")
def _t02(p: dict) -> dict[str, Column]:
    k = _category()
    want = F.when(k == "body", float(p.get("body_size", R.BODY_SIZE))).when(k == "caption", float(p.get("caption_size", R.CAPTION_SIZE))).when(k == "footnote", float(p.get("footnote_size", R.NOTE_SIZE)))
    fixed = F.transform("runs", lambda r: F.when((r["kind"] == "text") & ~blank(r["text"]) & (F.abs(r["size_pt"] - want) > 0.1), r.withField("size_pt", want)).otherwise(r))
    return {"runs": F.when(_type(), fixed).otherwise(F.col("runs"))}


def _body() -> Column:
    return _type() & (_category() == "body")


_set("T.03", "blocks", "line_spacing", lambda p: _body() & (F.abs(F.col("line_spacing") - 1.5) > 0.01), lambda p: 1.5)
_set("T.04", "blocks", "first_line_indent_cm", lambda p: _body() & (F.abs(F.col("first_line_indent_cm") - 1.25) > 0.05), lambda p: 1.25)
_set("T.05", "blocks", "alignment", lambda p: _body() & (F.col("alignment") != "justify"), lambda p: "justify")
_set("T.06", "docs", "auto_hyphenation", lambda p: F.col("auto_hyphenation"), lambda p: False)


def _islands(df: DataFrame) -> DataFrame:
    """*df* with __k: the place of an empty paragraph in its run; any other block in the container ends a run of them."""
    w = Window.partitionBy("doc_id", "container_id").orderBy("block_ord", "block_id")
    d = df.withColumn("__e", _type() & blank(_runs_text())).withColumn("__g", F.sum(F.when(F.col("__e"), 0).otherwise(1)).over(w))
    v = Window.partitionBy("doc_id", "container_id", "__g", "__e").orderBy("block_ord", "block_id")
    return d.withColumn("__k", F.when(F.col("__e"), F.row_number().over(v))).drop("__e", "__g")


@gone("T.07", "blocks", prepare=_islands)
def _t07(p: dict) -> Column:
    """Surplus empty paragraphs."""
    return F.col("__k") > int(p.get("max_consecutive_empty", 1))


@columns("T.08", "blocks")
def _t08(p: dict) -> dict[str, Column]:
    return _text_runs(lambda t: F.regexp_replace(t, "  +", " "), _category() != "header_footer")


@columns("T.09", "blocks")
def _t09(p: dict) -> dict[str, Column]:
    last = F.array_max(F.transform("runs", lambda r, i: F.when((r["kind"] == "text") & (F.coalesce(r["text"], F.lit("")) != ""), i)))
    fixed = F.transform("runs", lambda r, i: F.when(i == last, r.withField("text", F.regexp_replace(r["text"], r"(?U)\s+$", ""))).otherwise(r))
    return {"runs": F.when(_type() & (_category() != "header_footer"), fixed).otherwise(F.col("runs"))}


@columns("T.10", "blocks")
def _t10(p: dict) -> dict[str, Column]:
    t = _runs_text()
    quotes = F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
    return _text_runs(lambda x: F.regexp_replace(x, '"([^"]*)"', "«$1»"), (F.size(_visible()) == 1) & (quotes % 2 == 0))


@columns("T.11", "blocks")
def _t11(p: dict) -> dict[str, Column]:
    return _text_runs(lambda x: F.replace(x, F.lit(" - "), F.lit(" — ")), F.size(_visible()) == 1)


NBSP = "\u00a0"


@columns("T.12", "blocks")
def _t12(p: dict) -> dict[str, Column]:
    units = "|".join(re.escape(u) for u in R.TEXT_UNITS)
    return _text_runs(lambda x: F.regexp_replace(x, rf"(?<!\d)(\d+(?:[.,]\d+)?) ({units}){RIGHT}", f"$1{NBSP}$2"))


@columns("T.13", "blocks")
def _t13(p: dict) -> dict[str, Column]:
    return _text_runs(lambda x: F.regexp_replace(x, r"([А-ЯЁ]\.) ([А-ЯЁ]\.) ([А-ЯЁ][а-яё]+)", f"$1{NBSP}$2{NBSP}$3"))


@columns("T.14", "blocks")
def _t14(p: dict) -> dict[str, Column]:
    s, t = R._style(), float(p.get("tolerance_pt", 0.5))  # noqa: SLF001
    skip = reduce(lambda a, b: a | b, [s.startswith(x) for x in ("heading", "caption", "list", "footer", "header", "title")])
    out = {}
    for side in ("before", "after"):
        c, want = f"space_{side}_pt", float(p.get(f"expected_{side}_pt", 0))
        out[c] = F.when(_type() & ~skip & (F.abs(F.col(c) - want) > t), F.lit(want)).otherwise(F.col(c))
    return out


@columns("L.04", "blocks")
def _l04(p: dict) -> dict[str, Column]:
    bare = lambda x: F.regexp_replace(x, r"(?U)[\s.;,:!?]+$", "")
    fixed = F.transform("items", lambda x, i: F.concat(bare(x), F.when(i == F.size("items") - 1, ".").otherwise(";")))
    mixed = F.size(F.array_distinct(F.transform("items", R.end_mark))) > 1
    return {"items": F.when(_type("list") & (F.size("items") >= 2) & mixed, fixed).otherwise(F.col("items"))}


@columns("U.01", "blocks")
def _u01(p: dict) -> dict[str, Column]:
    return _text_runs(lambda x: F.regexp_replace(x, rf"(\d+) ({R._UNITS}){R._EDGE}", f"$1{NBSP}$2"))  # noqa: SLF001


@columns("U.02", "blocks")
def _u02(p: dict) -> dict[str, Column]:
    return _text_runs(lambda x: F.regexp_replace(x, rf"(\d+)[.,]({R._UNITS}){R._EDGE}", f"$1{NBSP}$2"))  # noqa: SLF001


@columns("U.03", "blocks")
def _u03(p: dict) -> dict[str, Column]:
    """A year is 1500 and more, or has five digits and more; pages keep their full stop."""
    rest = "|".join(re.escape(u) for u in sorted(R.SI_UNITS, key=len, reverse=True) if u not in ("г", "с"))
    small = rf"(?<!\d)((?:\d{{1,3}}|1[0-4]\d{{2}}|0\d{{3}})[\s\u00a0]?)г\.{R._EDGE}"  # noqa: SLF001
    return _text_runs(lambda x: F.regexp_replace(F.regexp_replace(x, rf"(\d+[\s\u00a0]?)({rest})\.{R._EDGE}", "$1$2"), small, "$1г"))  # noqa: SLF001
