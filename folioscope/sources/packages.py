"""Documents from word-processor packages (WordprocessingML).

A task reads a package and emits its parts as tagged rows: the document, its page section, and the elements of the body
in order, each with the formats its style chain gives it. What depends on neighbours is done on the rows: sections nest
by the levels of their headings, captions join the table below or the figure above them, list paragraphs become lists,
the paragraphs of the bibliography become entries, and bracketed numbers of entries become citations.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import blank, collapse, strip, text_of
from folioscope.operators.bibliography import entry_fields, entry_type
from folioscope.session import materialize
from folioscope.sources.corpus import CELL, RUN, SCHEMAS, Corpus, make

BIBLIOGRAPHY_HEADINGS = ("список использованных источников", "список литературы", "библиографический список", "список источников")
# Name spaces of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Paper sizes in millimetres, short side first.
PAPERS = {"A4": (210.0, 297.0), "A3": (297.0, 420.0), "A5": (148.0, 210.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6)}
# Page number formats, and alignments, by their name in the file.
NUMBER_FORMATS = {"decimal": "arabic", "decimalZero": "arabic", "lowerRoman": "roman", "upperRoman": "roman", "lowerLetter": "uppercase_letter", "upperLetter": "uppercase_letter"}
ALIGNMENTS = {"left": "left", "start": "left", "right": "right", "end": "right", "center": "center", "both": "justify"}
# What captions, continued tables and typed list markers look like.
CAPTION_STYLES = ["caption", "image caption", "figure caption", "table caption"]
FIGURE_CAPTION = r"^Рис(?:унок)?\.?[\s ]+(?:\d|[А-Я]\.\d)"
TABLE_CAPTION = r"^Таблица[\s ]+(?:\d|[А-Я]\.\d)"
CONTINUED = re.compile(r"^продолжение\s+таблицы\s+[\dА-Яа-я.]+", re.IGNORECASE)
BULLET_ITEM, NUMBER_ITEM = r"^([–—•*◦])\s+(.+)$", r"^(\d{1,3})[.)]\s+(.+)$"
CITATION = r"\[(\d{1,3})(?:,\s*[сС]\.\s*([\d,\s\-–—]+?))?\]"

_ELEMENT = (
    "n int, kind string, level int, style_name string, alignment string, line_spacing double, first_line_indent_cm double, page_break_before boolean, "
    f"space_before_pt double, space_after_pt double, dpi int, latex string, number string, ordered boolean, num_id string, headers array<array<{CELL}>>, rows array<array<{CELL}>>, "
    "runs array<struct<kind:string,text:string,bold:boolean,italic:boolean,font:string,size_pt:double,color_hex:string,target_id:string,prefix:string>>"
)


def _val(node, tag: str, attribute: str = "val") -> str | None:  # noqa: ANN001
    """The attribute of a child, "" when the child has none, None without the child."""
    child = node.find(f"{_W}{tag}") if node is not None else None
    return None if child is None else child.get(f"{_W}{attribute}", "")


def _toggle(node, tag: str) -> bool | None:  # noqa: ANN001
    v = _val(node, tag)
    return None if v is None else v.lower() not in ("0", "false", "off")


def _number(v: str | None, unit: float = 1.0) -> float | None:
    try:
        return float(v) * unit if v else None
    except ValueError:
        return None


def _texts(node) -> str:  # noqa: ANN001
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


class _Styles:
    """Formats of the styles of one package, looked up along the chain of styles they are based on."""

    def __init__(self, root):  # noqa: ANN001
        self.by = {s.get(f"{_W}styleId"): s for s in root.iter(f"{_W}style")} if root is not None else {}
        self.known: dict[str | None, dict] = {}

    def name(self, style: str | None) -> str | None:
        found = self.by.get(style)
        return style if found is None else _val(found, "name") or style

    def formats(self, style: str | None) -> dict:
        if style not in self.known:
            out: dict = {}
            seen: set = set()
            at = style
            while at in self.by and at not in seen:
                seen.add(at)
                node = self.by[at]
                linked = self.by.get(_val(node, "link"))
                for source in (node, linked):
                    if source is not None:
                        for k, v in _run_formats(source.find(f"{_W}rPr")).items():
                            if source is node or k == "color_hex":
                                out.setdefault(k, v)
                flag = _toggle(node.find(f"{_W}pPr"), "pageBreakBefore")
                if flag is not None:
                    out.setdefault("page_break_before", flag)
                at = _val(node, "basedOn")
            self.known[style] = out
        return self.known[style]


def _run_formats(rpr) -> dict:  # noqa: ANN001
    """The formats a run or style states itself."""
    if rpr is None:
        return {}
    color = _val(rpr, "color")
    found = {
        "bold": _toggle(rpr, "b"), "italic": _toggle(rpr, "i"), "font": _val(rpr, "rFonts", "ascii") or None, "size_pt": _number(_val(rpr, "sz"), 0.5),
        "color_hex": color.upper() if color and color.lower() != "auto" else None,
    }
    return {k: v for k, v in found.items() if v is not None}


def _field_words(p) -> list[str]:  # noqa: ANN001
    """The first word of every field of a paragraph, simple and complex."""
    codes = [f.get(f"{_W}instr", "") for f in p.iter(f"{_W}fldSimple")]
    inside = None
    for x in p.iter():
        if x.tag == f"{_W}fldChar":
            kind = x.get(f"{_W}fldCharType")
            if kind == "begin":
                inside = ""
            elif kind in ("separate", "end") and inside is not None:
                codes.append(inside)
                inside = None
        elif x.tag == f"{_W}instrText" and inside is not None:
            inside += x.text or ""
    return [c.split()[0].upper() for c in codes if c.split()]


def _runs(p, base: dict) -> list[dict]:  # noqa: ANN001
    """The inline elements of a paragraph; references take the opening bracket before them as their prefix."""
    out: list[dict] = []

    def text_run(r) -> None:  # noqa: ANN001
        if r.find(f"{_M}oMath") is not None:
            out.append({"kind": "formula", "text": "".join(t.text or "" for t in r.iter(f"{_M}t"))})
        elif text := "".join(t.text or "" for t in r.findall(f"{_W}t")):
            out.append({"kind": "text", "text": text} | {k: v for k, v in (base | _run_formats(r.find(f"{_W}rPr"))).items() if k != "page_break_before"})

    for x in p:
        if x.tag == f"{_W}r":
            text_run(x)
        elif x.tag == f"{_M}oMath":
            out.append({"kind": "formula", "text": "".join(t.text or "" for t in x.iter(f"{_M}t"))})
        elif x.tag == f"{_W}hyperlink":
            for r in x.iter(f"{_W}r"):
                text_run(r)
        elif x.tag == f"{_W}fldSimple":
            words = x.get(f"{_W}instr", "").split()
            if words and words[0].upper() == "REF" and len(words) > 1:
                prefix = ""
                if out and out[-1]["kind"] == "text" and (m := re.search(r"\s*\((?:[^()\s]+\.?\s*)?$", out[-1]["text"])):
                    prefix, out[-1]["text"] = m[0], out[-1]["text"][: m.start()]
                out.append({"kind": "xref", "text": _texts(x), "target_id": words[1], "prefix": prefix or None})
            elif text := _texts(x):
                out.append({"kind": "text", "text": text})
    return [r for r in out if r["kind"] != "text" or r["text"]]


def _table(t, styles: _Styles) -> dict:  # noqa: ANN001
    """Header rows and rows of cells; rows that only announce a continued table are left out."""
    kept, heads = [], []
    for row in t.findall(f"{_W}tr"):
        cells = []
        for c in row.findall(f"{_W}tc"):
            first = c.find(f"{_W}p")
            base = styles.formats(_val(first.find(f"{_W}pPr"), "pStyle")) if first is not None else {}
            sizes = [r["size_pt"] for r in (_runs(first, base) if first is not None else []) if r.get("size_pt")]
            span = int(_number(_val(c.find(f"{_W}tcPr"), "gridSpan")) or 1)
            cells += [{"text": _texts(first) if first is not None else "", "size_pt": sizes[0] if sizes else None}] * span
        if cells and CONTINUED.match(cells[0]["text"].strip()):
            continue
        kept.append(cells)
        heads.append(_toggle(row.find(f"{_W}trPr"), "tblHeader") or False)
    if kept and not any(heads):
        heads[0] = True  # without a mark the first row is the header
    last = max((k for k, h in enumerate(heads) if h), default=-1)
    above = [r for r, h in zip(kept, heads) if h]
    return {"headers": [above[-1], *above[:-1]] if above else [], "rows": kept[last + 1 :]}


def _dpi(image: bytes) -> int | None:
    """Dots per inch that a PNG or JPEG file states."""
    if image[:8] == b"\x89PNG\r\n\x1a\n" and (at := image.find(b"pHYs", 0, 4096)) > 0:
        x, y, unit = struct.unpack(">IIB", image[at + 4 : at + 13])
        return round(min(x, y) * 0.0254) if unit == 1 else None
    if image[:2] == b"\xff\xd8" and image[6:10] == b"JFIF":
        unit, x, y = struct.unpack(">BHH", image[13:18])
        return {1: min(x, y), 2: round(min(x, y) * 2.54)}.get(unit)
    return None


class _Package:
    """The parts of one package."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.body = self.xml("word/document.xml").find(f"{_W}body")
        self.styles = _Styles(self.xml("word/styles.xml", needed=False))
        rels = self.xml("word/_rels/document.xml.rels", needed=False)
        self.rels = {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target", ""))) for r in rels} if rels is not None else {}
        numbering = self.xml("word/numbering.xml", needed=False)
        self.bullets: dict[str, bool] = {}
        if numbering is not None:
            kinds = {a.get(f"{_W}abstractNumId"): _val(a.find(f"{_W}lvl"), "numFmt") == "bullet" for a in numbering.findall(f"{_W}abstractNum")}
            self.bullets = {n.get(f"{_W}numId"): kinds.get(_val(n, "abstractNumId"), False) for n in numbering.findall(f"{_W}num")}

    def xml(self, name: str, needed: bool = True):  # noqa: ANN201
        if not needed and name not in self.zip.namelist():
            return None
        return ElementTree.fromstring(self.zip.read(name))

    def document(self) -> dict:
        core = self.xml("docProps/core.xml", needed=False)
        got = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in core} if core is not None else {}
        settings = self.xml("word/settings.xml", needed=False)
        hyphen = None if settings is None else bool(_toggle(settings, "autoHyphenation"))
        year = re.match(r"\d{4}", got.get("created", ""))
        return {"title": got.get("title") or None, "author": got.get("creator") or None, "work_year": int(year[0]) if year else None, "auto_hyphenation": hyphen}

    def page(self) -> dict:
        """Geometry, border, numbering, header, footer and title block of the first physical section."""
        sect = next(self.body.iter(f"{_W}sectPr"), None)
        sect = ElementTree.Element("none") if sect is None else sect
        mm = lambda tag, a: round((_number(_val(sect, tag, a)) or 0.0) * 25.4 / 1440, 1)
        w, h = mm("pgSz", "w"), mm("pgSz", "h")
        paper = next((n for n, (a, b) in PAPERS.items() if abs(min(w, h) - a) <= 2 and abs(max(w, h) - b) <= 2), "Unknown")
        sides = sect.find(f"{_W}pgBorders")
        side = next((x for s in ("top", "left", "bottom", "right") if sides is not None and (x := sides.find(f"{_W}{s}")) is not None), None)
        border = None if side is None else {"enabled": True, "style": side.get(f"{_W}val") or "single", "size": _number(side.get(f"{_W}sz")) or 4.0}
        start, form = _number(_val(sect, "pgNumType", "start")), _val(sect, "pgNumType", "fmt")
        out = {
            "ps_ord": 0, "ps_id": "main", "ps_type": "main", "paper": paper, "orientation": "landscape" if w > h else "portrait",
            "margins_mm": {s: mm("pgMar", s) for s in ("top", "right", "bottom", "left")}, "border": border, "visible": True,
            "format": NUMBER_FORMATS.get(form or "decimal", "arabic"), "start_mode": "continue" if start is None else "start_at",
            "start_value": None if start is None else int(start), "title_block": False,
        }
        for name in ("header", "footer"):
            part = next((self.rels.get(x.get(f"{_R}id")) for x in sect.findall(f"{_W}{name}Reference") if x.get(f"{_W}type", "default") == "default"), None)
            root = self.xml(part, needed=False) if part else None
            if root is None:
                continue
            if name == "footer":
                out["title_block"] = root.find(f"{_W}tbl") is not None
            numbered = next((p for p in root.findall(f"{_W}p") if "PAGE" in _field_words(p)), None)
            if numbered is not None:
                place = ALIGNMENTS.get(_val(numbered.find(f"{_W}pPr"), "jc") or "", "center")
                out[name] = {place if place in ("left", "right") else "center": "{page}"}
        return out

    def elements(self) -> Iterator[dict]:
        for n, x in enumerate(self.body):
            if x.tag == f"{_W}tbl":
                yield {"n": n, "kind": "table"} | _table(x, self.styles)
            elif x.tag == f"{_W}p":
                yield {"n": n} | self.paragraph(x)

    def paragraph(self, p) -> dict:  # noqa: ANN001
        ppr = p.find(f"{_W}pPr")
        style = _val(ppr, "pStyle")
        name, base = self.styles.name(style), self.styles.formats(style)
        line, rule = _number(_val(ppr, "spacing", "line")), _val(ppr, "spacing", "lineRule")
        indent = _number(_val(ppr, "ind", "firstLine"), 2.54 / 1440)
        flag = _toggle(ppr, "pageBreakBefore")
        out = {
            "kind": "paragraph", "style_name": name, "alignment": ALIGNMENTS.get(_val(ppr, "jc") or ""),
            "line_spacing": None if line is None else line / (20 if rule in ("exact", "atLeast") else 240),  # points, or lines
            "first_line_indent_cm": None if indent is None else round(indent, 2), "page_break_before": base.get("page_break_before") if flag is None else flag,
            "space_before_pt": _number(_val(ppr, "spacing", "before"), 1 / 20), "space_after_pt": _number(_val(ppr, "spacing", "after"), 1 / 20), "runs": _runs(p, base),
        }
        low = (name or "").lower()
        box = next(p.iter(f"{_W}txbxContent"), None)
        math = p.find(f".//{_M}oMathPara")
        numbered = ppr.find(f"{_W}numPr") if ppr is not None else None
        if m := re.fullmatch(r"heading\s*(\d)", low):
            return out | {"kind": "heading", "level": int(m[1])}
        if low.startswith(("list number", "list bullet")) or numbered is not None:
            num = _val(numbered, "numId")
            bullet = low.startswith("list bullet") or (not low.startswith("list number") and self.bullets.get(num, False))
            return out | {"kind": "item", "ordered": not bullet, "num_id": num}
        if box is not None and _texts(box):
            return out | {"runs": [{"kind": "text", "text": _texts(box)}]}
        if (drawing := next(p.iter(f"{_W}drawing"), None)) is not None:
            blip = next(drawing.iter(f"{_A}blip"), None)
            part = self.rels.get(blip.get(f"{_R}embed")) if blip is not None else None
            return out | {"kind": "figure", "runs": [], "dpi": _dpi(self.zip.read(part)) if part in self.zip.namelist() else None}
        if "TOC" in _field_words(p):
            return out | {"kind": "toc"}
        if math is not None:
            number = re.search(r"\((\d+(?:\.\d+)?)\)\s*$", _texts(p))
            return out | {"kind": "formula", "latex": "".join(t.text or "" for t in math.iter(f"{_M}t")), "number": f"({number[1]})" if number else None, "runs": []}
        return out


def _rows(path: str, content: bytes) -> list[tuple]:
    """(path, tag, n, payload) of a package; unreadable packages give nothing."""
    try:
        p = _Package(content)
        head = [(path, "doc", 0, json.dumps(p.document(), ensure_ascii=False)), (path, "page", 0, json.dumps(p.page(), ensure_ascii=False))]
        return head + [(path, "element", e["n"], json.dumps(e, ensure_ascii=False)) for e in p.elements()]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return []


def read_packages(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """(doc_id, path, tag, n, payload): the parts of all word-processor files below a folder; the id is the hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(_rows(path, bytes(content)), columns=["path", "tag", "n", "payload"])

    return files.mapInPandas(work, "path string, tag string, n int, payload string").select(F.xxhash64("path").alias("doc_id"), "path", "tag", "n", "payload")


def nested_sections(df: DataFrame, level: str, n: str, prefix: str, deepest: int = 9) -> DataFrame:
    """*df* with the column path: ids (*prefix* and *n*) of the headings a row lies under, itself included.

    An ancestor counts only while no heading of a smaller level has come after it.
    """
    w = Window.partitionBy("doc_id").orderBy(n)
    df = df.withColumns({f"__l{k}": F.last(F.when(F.col(level) == k, F.col(n)), ignorenulls=True).over(w) for k in range(1, deepest + 1)})
    live = []
    for k in range(1, deepest + 1):
        smaller = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"__l{j}", F.lit(-1)) for j in range(1, k)])
        live.append(F.when(F.col(f"__l{k}") > smaller, F.concat(F.lit(prefix), F.col(f"__l{k}"))))
    return df.withColumn("path", F.array_compact(F.array(*live))).drop(*[f"__l{k}" for k in range(1, deepest + 1)])


def _full_runs(runs: Column) -> Column:
    kinds = dict(p.split(":") for p in RUN[7:-1].split(","))
    have = ("kind", "text", "bold", "italic", "font", "size_pt", "color_hex", "target_id", "prefix")
    return F.transform(runs, lambda r, i: F.struct(*[(i if k == "run_ord" else r[k] if k in have else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]))


def cited_runs(runs: Column, entries: Column) -> Column:
    """*runs* with `[N]` and `[N, с. P]` in text cut out as citations where N is the number of an entry (1 to *entries*)."""

    def cut(r: Column) -> Column:
        around = F.split(r["text"], CITATION, -1)
        n, pages, whole = (F.regexp_extract_all(r["text"], F.lit(CITATION), F.lit(k)) for k in (1, 2, 0))

        def piece(t: Column, i: Column) -> Column:
            number = F.try_element_at(n, i + 1).try_cast("int")
            real = F.coalesce((number >= 1) & (number <= entries), F.lit(False))
            citation = r.withField("kind", F.lit("citation")).withField("text", F.lit(None).cast("string")).withField("source_id", F.concat(F.lit("ref-"), number)).withField("pages", F.nullif(strip(F.regexp_replace(F.try_element_at(pages, i + 1), r"\s+", " ")), F.lit("")))
            return F.array(r.withField("text", t), F.when(real, citation).otherwise(r.withField("text", F.coalesce(F.try_element_at(whole, i + 1), F.lit("")))))

        return F.filter(F.flatten(F.transform(around, piece)), lambda x: (x["kind"] != "text") | (x["text"] != ""))

    alone = lambda r: (r["kind"] == "text") & r["text"].rlike(CITATION)
    out = F.flatten(F.transform(runs, lambda r: F.when(alone(r), cut(r)).otherwise(F.array(r))))
    return F.transform(out, lambda r, i: r.withField("run_ord", i))


def from_packages(spark: SparkSession, folder: str) -> Corpus:
    """Documents from word-processor files. Packages that cannot be read give no document.

    The packages are opened once; what they hold is written to the shared folder.
    """
    rows = materialize(read_packages(spark, folder), "packages")
    doc = rows.where("tag = 'doc'").withColumn("v", F.from_json("payload", "title string, author string, work_year int, auto_hyphenation boolean"))
    docs = doc.select("doc_id", F.coalesce("v.title", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("title"), F.col("v.work_year").alias("work_year"), F.col("v.auto_hyphenation").alias("auto_hyphenation"))
    pages = rows.where("tag = 'page'").select("doc_id", F.from_json("payload", SCHEMAS["pages"].replace("doc_id bigint, ", "")).alias("v")).select("doc_id", "v.*")
    e = rows.where("tag = 'element'").select("doc_id", F.from_json("payload", _ELEMENT).alias("v")).select("doc_id", "v.*").withColumn("runs", _full_runs(F.col("runs")))
    e = nested_sections(e, "level", "n", "sec-")
    heads = e.where("kind = 'heading'")
    secs = heads.select("doc_id", F.concat(F.lit("sec-"), "n").alias("sec_id"), F.try_element_at("path", F.lit(-2)).alias("parent_id"), F.col("n").alias("sec_ord"), "level", "path", F.col("runs").alias("heading"))
    body = e.where("kind <> 'heading'").withColumn("container_id", F.try_element_at("path", F.lit(-1)))
    named = heads.where((F.col("level") == 1) & collapse(text_of("runs")).isin(*BIBLIOGRAPHY_HEADINGS)).select("doc_id", F.concat(F.lit("sec-"), "n").alias("container_id"))
    body = _lists(_glued(body), named)
    listed = body.where((F.col("kind") == "paragraph") & ~blank(text_of("runs"))).join(named, ["doc_id", "container_id"], "left_semi")
    listed = listed.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("ordinal"), strip(text_of("runs")).alias("raw"))
    raw = F.col("raw")
    entries = listed.select("doc_id", "ordinal", F.concat(F.lit("ref-"), "ordinal").alias("entry_id"), entry_type(raw).alias("entry_type"), F.map_concat(F.create_map(F.lit("raw"), raw), entry_fields(raw)).alias("fields"))
    known = listed.groupBy("doc_id").agg(F.max("ordinal").alias("known"))
    body = body.join(known, "doc_id", "left")
    runs = F.when((F.col("kind") == "paragraph") & (F.col("known") > 0), cited_runs(F.col("runs"), F.col("known"))).otherwise(F.col("runs"))
    letter = {"paragraph": "p", "figure": "fig", "table": "t", "formula": "formula", "toc": "toc", "list": "list"}
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("n"))
    prefix = F.create_map(*[F.lit(x) for kv in letter.items() for x in kv])[F.col("kind")]
    blocks = body.withColumn("runs", runs).withColumn("block_id", F.concat(prefix, F.lit("-"), nth)).withColumnsRenamed({"n": "block_ord", "kind": "block_type"})
    return make(spark, docs=docs, pages=pages, secs=secs, blocks=blocks, entries=entries)


def _glued(body: DataFrame) -> DataFrame:
    """Captions right below a figure, or right above a table, become its runs and are no paragraphs any more."""
    text = strip(text_of("runs"))
    styled = F.lower(F.coalesce("style_name", F.lit(""))).isin(*CAPTION_STYLES)
    w = Window.partitionBy("doc_id", "container_id").orderBy("n")
    par = F.col("kind") == "paragraph"
    body = body.withColumns({"__fig": par & (styled | text.rlike(FIGURE_CAPTION)) & (F.lag("kind").over(w) == "figure"), "__tab": par & (styled | text.rlike(TABLE_CAPTION)) & (F.lead("kind").over(w) == "table")})
    body = body.withColumns({"__below": F.when(F.lead("__fig").over(w), F.lead("runs").over(w)), "__above": F.when(F.lag("__tab").over(w) & ~F.coalesce(F.lag("__fig").over(w), F.lit(False)), F.lag("runs").over(w))})
    runs = F.when(F.col("kind") == "figure", F.coalesce("__below", "runs")).when(F.col("kind") == "table", F.coalesce("__above", "runs")).otherwise(F.col("runs"))
    return body.withColumn("runs", runs).where(~F.coalesce(F.col("__fig") | F.col("__tab"), F.lit(False))).drop("__fig", "__tab", "__below", "__above")


def _lists(body: DataFrame, sources: DataFrame) -> DataFrame:
    """Neighbouring list paragraphs of one kind, and two or more neighbouring paragraphs that begin with one marker, become lists.

    Typed markers are taken off. What lies in the sections *sources*, or below them, keeps its typed numbers.
    """
    text = F.coalesce(text_of("runs"), F.lit(""))
    bullet, number = F.regexp_extract(text, BULLET_ITEM, 1), F.regexp_extract(text, NUMBER_ITEM, 1)
    body = body.withColumn("top", F.try_element_at("path", F.lit(1))).join(sources.select("doc_id", F.col("container_id").alias("top"), F.lit(True).alias("__src")), ["doc_id", "top"], "left")
    typed = F.when((F.col("kind") != "paragraph") | F.col("__src"), None).when(bullet != "", F.concat(F.lit("typed "), bullet)).when(number != "", F.lit("typed 1"))
    key = F.when(F.col("kind") == "item", F.concat_ws(" ", F.lit("item"), F.col("ordered"), F.coalesce("num_id", F.lit("")))).otherwise(typed)
    w = Window.partitionBy("doc_id", "container_id").orderBy("n")
    body = body.withColumns({"__text": text, "__key": key}).withColumn("__new", F.when(F.col("__key").eqNullSafe(F.lag("__key").over(w)) & F.col("__key").isNotNull(), 0).otherwise(1))
    body = body.withColumn("__run", F.sum("__new").over(w))
    g = Window.partitionBy("doc_id", "container_id", "__run")
    body = body.withColumns({"__n": F.count("*").over(g), "__k": F.row_number().over(g.orderBy("n"))})
    plain = F.when(F.col("kind") == "item", F.col("__text")).otherwise(F.regexp_extract("__text", r"^(?:[–—•*◦]|\d{1,3}[.)])\s+(.+)$", 1))
    body = body.withColumn("__items", F.transform(F.sort_array(F.collect_list(F.struct("n", plain.alias("x"))).over(g)), lambda x: x["x"]))
    is_list = F.col("__key").isNotNull() & ((F.col("kind") == "item") | (F.col("__n") > 1))
    body = body.withColumn("__list", is_list).where(~F.col("__list") | (F.col("__k") == 1))
    return body.select(
        "doc_id", "container_id", "path", "n", F.when(F.col("__list"), "list").otherwise(F.col("kind")).alias("kind"),
        "style_name", "alignment", "line_spacing", "first_line_indent_cm", "page_break_before", "space_before_pt", "space_after_pt", "dpi", "latex", "number",
        F.when(F.col("__list"), F.coalesce("ordered", F.col("__key") == "typed 1")).alias("ordered"), F.when(F.col("__list"), F.col("__items")).alias("items"), "headers", "rows",
        F.when(F.col("__list"), F.array().cast(f"array<{RUN}>")).otherwise(F.col("runs")).alias("runs"),
    )
