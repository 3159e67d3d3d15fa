import struct
import zipfile
import zlib

import pytest

from folioscope.operators.engine import Profile, validate
from folioscope.sources.packages import from_packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = """<w:style w:type="paragraph" w:styleId="1"><w:name w:val="heading 1"/><w:basedOn w:val="B"/><w:link w:val="1c"/></w:style>
<w:style w:type="paragraph" w:styleId="2"><w:name w:val="heading 2"/><w:basedOn w:val="1"/></w:style>
<w:style w:type="character" w:styleId="1c"><w:name w:val="h1 char"/><w:rPr><w:color w:val="0000ff"/><w:i/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="Base"/><w:pPr><w:pageBreakBefore/></w:pPr><w:rPr><w:b/><w:sz w:val="28"/><w:rFonts w:ascii="Serif"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="C"><w:name w:val="Caption"/></w:style><w:style w:type="paragraph" w:styleId="L"><w:name w:val="List Bullet"/></w:style>"""


def p(text="", style=None, ppr="", rpr="", more=""):
    st = f'<w:pStyle w:val="{style}"/>' if style else ""
    run = f'<w:r><w:rPr>{rpr}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>' if text else ""
    return f"<w:p><w:pPr>{st}{ppr}</w:pPr>{run}{more}</w:p>"


def row(*cells, head=False, rpr=""):
    return "<w:tr><w:trPr>" + ("<w:tblHeader/>" if head else "") + "</w:trPr>" + "".join(f"<w:tc>{p(c, rpr=rpr)}</w:tc>" for c in cells) + "</w:tr>"


def png(dpi):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1))


def drawing(rid):
    return f'<w:r><w:drawing><a:blip r:embed="{rid}"/></w:drawing></w:r>'


BODY = [
    p("Введение", "1"), p("Текст по [1] и [2, с. 5] и [9].", ppr='<w:jc w:val="both"/><w:spacing w:line="360" w:before="120"/><w:ind w:firstLine="709"/>', rpr='<w:b w:val="0"/><w:sz w:val="24"/>'),
    p("Обзор", "2"), p("– раз", ppr=""), p("– два"), p("* одна"), p("Таблица 1 — Имя"), "<w:tbl>" + row("a", "b", head=True) + row("Продолжение таблицы 1", "") + row("1", "", rpr='<w:sz w:val="20"/>') + "</w:tbl>",
    p(more=drawing("rId7")), p("Рисунок 2 — Вид", "C"), p("пункт", "L"), p("ещё", "L"), p("номер", ppr='<w:numPr><w:ilvl w:val="0"/><w:numId w:val="5"/></w:numPr>'),
    p("(см. ", more='<w:fldSimple w:instr=" REF fig_2 \\h"><w:r><w:t>рис. 2</w:t></w:r></w:fldSimple><w:r><w:t>)</w:t></w:r>'), "<w:p><m:oMathPara><m:oMath><m:r><m:t>x=1</m:t></m:r></m:oMath></m:oMathPara><w:r><w:t>(3)</w:t></w:r></w:p>",
    p(more='<w:fldSimple w:instr="TOC \\o"/>'), p("Список литературы", "1"), p("1. Иванов И. И. Книга. — Москва : Наука, 2019."), p("2. Site. URL: https://a.b/c."), p(" "),
    '<w:sectPr><w:footerReference w:type="default" r:id="rId8"/><w:pgSz w:w="16838" w:h="11906"/><w:pgMar w:top="1134" w:right="850" w:bottom="1134" w:left="1701"/><w:pgNumType w:start="3" w:fmt="upperRoman"/><w:pgBorders><w:top w:val="double" w:sz="6"/></w:pgBorders></w:sectPr>',
]


def write(path, body=BODY):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{STYLES}</w:styles>")
        z.writestr("word/settings.xml", f"<w:settings {W}><w:autoHyphenation/></w:settings>")
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="2"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="2"/></w:num></w:numbering>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId7" Target="media/i.png"/><Relationship Id="rId8" Target="footer1.xml"/></Relationships>')
        z.writestr("word/media/i.png", png(96))
        z.writestr("word/footer1.xml", f'<w:ftr {W}><w:p><w:pPr><w:jc w:val="right"/></w:pPr><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p></w:ftr>')
        z.writestr("docProps/core.xml", '<c xmlns:d="x"><d:title>Работа</d:title><d:creator>А</d:creator><d:created>2023-05-01</d:created></c>')


@pytest.fixture(scope="module")
def corpus_of_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    write(folder / "a.docx")
    (folder / "sub").mkdir()
    write(folder / "sub" / "empty.docx", [])
    (folder / "b.docx").write_bytes(b"no package")
    return from_packages(spark, str(folder)).written()


def test_document_and_page(corpus_of_files):
    d = {r["title"]: r for r in corpus_of_files.docs.collect()}
    assert set(d) == {"Работа"} and corpus_of_files.docs.count() == 2 and (d["Работа"]["work_year"], d["Работа"]["auto_hyphenation"]) == (2023, True)
    page = corpus_of_files.pages.where("title_block is not null").orderBy("paper").first()
    assert (page["paper"], page["orientation"], page["margins_mm"]["left"], page["border"]["style"], page["border"]["size"]) == ("A4", "landscape", 30.0, "double", 6.0)
    assert (page["format"], page["start_mode"], page["start_value"], page["footer"]["right"], page["header"]) == ("roman", "start_at", 3, "{page}", None)


def test_sections_and_formats(corpus_of_files):
    secs = {r["sec_id"]: r for r in corpus_of_files.secs.collect()}
    assert {k: (r["level"], r["parent_id"], r["path"]) for k, r in secs.items()} == {"sec-0": (1, None, ["sec-0"]), "sec-2": (2, "sec-0", ["sec-0", "sec-2"]), "sec-16": (1, None, ["sec-16"])}
    h = secs["sec-0"]["heading"][0]
    assert (h["text"], h["bold"], h["size_pt"], h["font"], h["color_hex"], h["italic"]) == ("Введение", True, 14.0, "Serif", "0000FF", None)


def test_blocks(corpus_of_files):
    b = {r["block_id"]: r for r in corpus_of_files.blocks.collect()}
    first = b["p-1"]
    assert (first["alignment"], first["line_spacing"], first["first_line_indent_cm"], first["space_before_pt"], first["page_break_before"]) == ("justify", 1.5, 1.25, 6.0, None)
    assert [(r["kind"], r["text"], r["source_id"], r["pages"]) for r in first["runs"]] == [("text", "Текст по ", None, None), ("citation", None, "ref-1", None), ("text", " и ", None, None), ("citation", None, "ref-2", "5"), ("text", " и ", None, None), ("text", "[9]", None, None), ("text", ".", None, None)]
    lists = sorted((r["block_ord"], r["ordered"], r["items"]) for r in b.values() if r["block_type"] == "list")
    assert lists == [(3, False, ["раз", "два"]), (10, False, ["пункт", "ещё"]), (12, True, ["номер"])]
    t, f = b["t-1"], b["fig-1"]
    assert ("".join(r["text"] for r in t["runs"]), [[c["text"] for c in r] for r in t["headers"]], [[(c["text"], c["size_pt"]) for c in r] for r in t["rows"]]) == ("Таблица 1 — Имя", [["a", "b"]], [[("1", 10.0), ("", None)]])
    assert (f["dpi"], f["runs"][0]["text"], b["formula-1"]["latex"], b["formula-1"]["number"], b["toc-1"]["container_id"]) == (96, "Рисунок 2 — Вид", "x=1", "(3)", "sec-2")
    ref = next(r for r in b.values() if any(x["kind"] == "xref" for x in r["runs"]))
    assert [(x["kind"], x["text"], x["target_id"], x["prefix"]) for x in ref["runs"]] == [("xref", "рис. 2", "fig_2", "(см. "), ("text", ")", None, None)]


def test_bibliography_and_rules(spark, corpus_of_files):
    e = {r["entry_id"]: r for r in corpus_of_files.entries.collect()}
    assert {k: (r["entry_type"], r["ordinal"]) for k, r in e.items()} == {"ref-1": ("book", 1), "ref-2": ("web", 2)} and e["ref-2"]["fields"]["url"] == "https://a.b/c"
    got = {(r["check_code"], r["location"]) for r in validate(corpus_of_files, Profile(), codes=["F.02", "F.03", "F.04", "F.05", "F.07", "F.08", "T.06", "B.06", "B.07", "I.05", "I.08", "C.04", "H.01", "R.05", "K.03"], suppress=False).collect()}
    assert got >= {("F.03", "page_section[main]"), ("F.04", "page_section[main]"), ("F.05", "page_section[main]"), ("F.07", "page_section[main]"), ("F.08", "page_section[main]"), ("T.06", "document"), ("B.06", "table[t-1]"), ("B.07", "table[t-1]"), ("I.05", "figure[fig-1]"), ("I.08", "figure[fig-1]"), ("C.04", "paragraph[p-1]"), ("H.01", "section[sec-0]")}
    assert not [x for x in got if x[0] == "R.05"]


def test_folder_without_packages(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(b"")
    c = from_packages(spark, str(tmp_path))
    assert [getattr(c, n).count() for n in ("docs", "pages", "secs", "blocks", "entries")] == [0] * 5
