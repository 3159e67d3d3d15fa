"""Corpus from saved editor states and Markdown; and Markdown and HTML out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import blank, collapse, strip
from folioscope.operators.bibliography import entry_fields, entry_type
from folioscope.operators.nested import flat_tables, tagged_rows
from folioscope.sources.corpus import CELL, RUN, Corpus, make
from folioscope.sources.packages import BIBLIOGRAPHY_HEADINGS, nested_sections

_RUN_NAMES = [p.split(":")[0] for p in RUN[7:-1].split(",")]


def _run(**values):  # noqa: ANN003, ANN202
    kinds = dict(p.split(":") for p in RUN[7:-1].split(","))
    return F.struct(*[(values[n] if n in values else F.lit(None)).cast(kinds[n]).alias(n) for n in _RUN_NAMES])


def _cell_rows(rows: Column) -> Column:
    """Rows of texts as rows of cells; a state holds no size of its cells."""
    return F.transform(rows, lambda row: F.transform(row, lambda t: F.struct(t.alias("text"), F.lit(None).cast("double").alias("size_pt")))).cast(f"array<array<{CELL}>>")


def from_states(spark: SparkSession, states: DataFrame, key: str = "state_id", payload: str = "payload", order: str | None = "saved_at") -> Corpus:
    """Documents from saved editor states; the state is the document. A block's old `text` counts as one run.

    The references of bibliography sections, at any depth, become the entries ref-1, ref-2, ... of the document.
    Numbered formulas are counted through. The latex of an inline formula is the text of its run, which no rule reads.
    A target that is the `id` of a section stands for that section.
    """
    flat = flat_tables(tagged_rows(states, key, payload, order), key)
    s, b, r = flat["section"], flat["block"], flat["run"]
    path = F.transform(F.sequence(F.lit(1), F.size(F.split("node_path", "/"))), lambda k: F.array_join(F.slice(F.split("node_path", "/"), 1, k), "/"))
    head = F.array(_run(kind=F.lit("text"), text=F.coalesce("heading", F.lit(""))))
    w = Window.partitionBy(key).orderBy("sort")
    sort = F.transform(F.split("node_path", "/"), lambda x: F.struct(F.substring(x, 1, 1).alias("l"), F.substring(x, 2, 9).cast("int").alias("n")))
    secs = s.withColumn("sort", sort).select(
        F.col(key).alias("doc_id"), F.col("node_path").alias("sec_id"), F.nullif("parent_path", F.lit("")).alias("parent_id"), F.row_number().over(w).alias("sec_ord"),
        F.size(F.split("node_path", "/")).alias("level"), path.alias("path"), head.alias("heading"), "disabled_checks",
    )
    refs = s.where("is_bibliography").select(key, sort.alias("sort"), F.posexplode("references").alias("at", "ref")).where(~blank("ref"))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("sort", "at"))
    refs = refs.select(F.col(key).alias("doc_id"), ordinal.alias("ordinal"), strip("ref").alias("raw"))
    entries = refs.select(
        "doc_id", "ordinal", F.concat(F.lit("ref-"), "ordinal").alias("entry_id"), entry_type(F.col("raw")).alias("entry_type"),
        F.map_concat(F.create_map(F.lit("raw"), F.col("raw")), entry_fields(F.col("raw"))).alias("fields"),
    )
    named = s.where("id is not null").groupBy(key, F.col("id").alias("target_id")).agg(F.min_by("node_path", sort).alias("target_path"))
    r = r.join(named, [key, "target_id"], "left").withColumn("target_id", F.coalesce("target_path", "target_id"))
    text = F.when(F.col("kind") == "formula", F.coalesce("text", "latex")).otherwise(F.col("text"))
    runs = r.groupBy(key, "parent_path").agg(F.sort_array(F.collect_list(_run(run_ord=F.col("place"), kind=F.coalesce("kind", F.lit("text")), text=text, bold=F.col("bold"), target_id=F.col("target_id"), prefix=F.col("prefix"), source_id=F.col("source_id"), pages=F.col("pages")))).alias("runs"))
    old = F.array(_run(run_ord=F.lit(0), kind=F.lit("text"), text=F.coalesce(F.when(F.col("kind").isin("figure", "table"), F.col("caption")), F.col("text"))))
    v = Window.partitionBy(key).orderBy("sort")
    counted = (F.col("kind") == "formula") & ~blank("latex") & F.coalesce("numbered", F.lit(True))
    number = F.when(counted, F.count_if(counted).over(v).cast("string"))
    headers = F.when(F.size("headers") > 0, F.array("headers")).when(F.col("headers").isNotNull(), F.array().cast("array<array<string>>"))
    blocks = (
        b.withColumn("sort", sort).withColumns({"block_ord": F.row_number().over(v), "number": number}).join(runs.withColumnRenamed("parent_path", "node_path"), [key, "node_path"], "left")
        .select(F.col(key).alias("doc_id"), F.col("node_path").alias("block_id"), "block_ord", F.col("parent_path").alias("container_id"), F.col("kind").alias("block_type"),
                F.get_json_object("meta", "$.dpi").try_cast("int").alias("dpi"), F.col("latex"), "number", F.col("ordered"), F.col("items"),
                _cell_rows(headers).alias("headers"), _cell_rows(F.col("rows")).alias("rows"), F.coalesce("runs", old).alias("runs"))
    )
    docs = states.select(F.col(key).alias("doc_id"), F.get_json_object(payload, "$.title").alias("title"), F.get_json_object(payload, "$.year").try_cast("int").alias("work_year")).where("doc_id is not null").dropDuplicates(["doc_id"])
    return make(spark, docs=docs, secs=secs, blocks=blocks, entries=entries)


def markdown_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, level, value): lines of Markdown by kind: heading, bullet, number, table, formula, image, blank, text."""
    lines = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    l = F.col("line")
    kind = (
        F.when(strip(l) == "", "blank").when(l.rlike(r"^#{1,6}\s"), "heading").when(l.rlike(r"^\s*[-*+]\s"), "bullet").when(l.rlike(r"^\s*\d{1,3}[.)]\s"), "number")
        .when(l.rlike(r"^\s*\|.*\|\s*$"), "table").when(l.rlike(r"^\s*\$\$"), "formula").when(l.rlike(r"^\s*!\[[^\]]*\]\([^)]*\)"), "image").otherwise("text")
    )
    level = F.when(kind == "heading", F.length(F.regexp_extract(l, "^(#+)", 1))).otherwise(0)
    value = strip(F.regexp_replace(l, r"^(#{1,6}\s+|\s*[-*+]\s+|\s*\d{1,3}[.)]\s+)", ""))
    return lines.select("doc_id", "line_no", kind.alias("kind"), level.alias("level"), value.alias("value"))


def from_markdown(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> Corpus:
    """Documents from Markdown: headings nest by level, neighbouring lines of one kind make one block.

    The parent of a heading is the last earlier heading of a smaller level.
    """
    lines = markdown_lines(df.where(F.col(text).isNotNull()), key, text)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opened = nested_sections(lines, "level", "line_no", "h", 6)
    heads = opened.where("kind = 'heading'")
    secs = heads.select(
        "doc_id", F.concat(F.lit("h"), "line_no").alias("sec_id"), F.try_element_at("path", F.lit(-2)).alias("parent_id"), F.col("line_no").alias("sec_ord"), F.size("path").alias("level"),
        "path", F.array(_run(kind=F.lit("text"), text=F.col("value"))).alias("heading"),
    )
    same = F.when((F.col("kind") == F.lag("kind").over(w)), 0).otherwise(1)
    body = opened.withColumn("island", F.sum(same).over(w)).where("kind not in ('heading', 'blank')")
    g = body.groupBy("doc_id", "island", "kind").agg(F.min("line_no").alias("o"), F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("v"), F.min_by("path", "line_no").alias("path"))
    values = F.transform("v", lambda x: x["value"])
    kind = F.when(F.col("kind").isin("bullet", "number"), "list").when(F.col("kind") == "image", "figure").when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind"))
    text_ = F.when(F.col("kind") == "image", F.regexp_extract(values[0], r"!\[([^\]]*)\]", 1)).otherwise(F.array_join(values, " "))
    blocks = g.select(
        "doc_id", F.concat(F.lit("b"), "o").alias("block_id"), F.col("o").alias("block_ord"), F.try_element_at("path", F.lit(-1)).alias("container_id"), kind.alias("block_type"),
        (F.col("kind") == "number").alias("ordered"), F.when(kind == "list", values).alias("items"), F.when(F.col("kind") == "formula", F.array().cast(f"array<{RUN}>")).otherwise(F.array(_run(run_ord=F.lit(0), kind=F.lit("text"), text=text_))).alias("runs"),
        F.when(F.col("kind") == "formula", strip(F.replace(F.array_join(values, " "), F.lit("$$"), F.lit("")))).alias("latex"),
    )
    return make(spark, docs=df.select(F.col(key).alias("doc_id")).distinct(), secs=secs, blocks=blocks)


def _inline(runs: Column, bold: str, italic: str, both: str, formula: str, safe: Callable[[Column], Column]) -> Column:
    """The inline elements of a block as one string: styled text, formulas, citations and references."""

    def shown(r: Column) -> Column:
        t = safe(F.coalesce(r["text"], F.lit("")))
        b, i = (F.coalesce(r[n], F.lit(False)) & (t != "") for n in ("bold", "italic"))
        styled = F.when(b & i, F.format_string(both, t)).when(b, F.format_string(bold, t)).when(i, F.format_string(italic, t)).otherwise(t)
        source, pages, target, prefix = (F.coalesce(r[n], F.lit("")) for n in ("source_id", "pages", "target_id", "prefix"))
        cited = F.concat(F.lit("["), source, F.when(pages != "", F.concat(F.lit(", с. "), pages)).otherwise(""), F.lit("]"))
        return (
            F.when(r["kind"] == "formula", F.format_string(formula, t)).when(r["kind"] == "citation", safe(cited))
            .when(r["kind"] == "xref", safe(F.concat(prefix, F.lit("[→"), target, F.lit("]")))).otherwise(styled)
        )

    return F.coalesce(F.array_join(F.transform(runs, shown), ""), F.lit(""))


def _source() -> Column:
    """The description of an entry, else its fields."""
    f = F.col("fields")
    return F.coalesce(F.when(~blank(f["raw"]), f["raw"]), F.array_join(F.map_values(F.map_filter(f, lambda k, v: k != "raw")), ". "), F.lit(""))


def _exported(c: Corpus, head: Column, block: Column, entry: Callable[[Column, Column], Column], around: tuple[str, str] = ("", "")) -> DataFrame:
    """(doc_id, sec_ord, o, id, x) of headings, blocks and the bibliography, which follows its section or ends the document."""
    heads = c.relation("heads")
    h = heads.select("doc_id", "sec_ord", F.lit(-1).alias("o"), F.col("sec_id").alias("id"), head.alias("x"))
    order = heads.select("doc_id", F.col("sec_id").alias("container_id"), "sec_ord")
    # rendered before the join, so that strings and not runs are moved
    b = c.relation("blocks").select("doc_id", "container_id", F.col("block_ord").alias("o"), F.col("block_id").alias("id"), block.alias("x")).where("x is not null")
    b = b.join(order, ["doc_id", "container_id"], "left").select("doc_id", F.coalesce("sec_ord", F.lit(0)).alias("sec_ord"), "o", "id", "x")
    place = heads.where(collapse("text").isin(*BIBLIOGRAPHY_HEADINGS)).groupBy("doc_id").agg(F.min("sec_ord").alias("sec_ord"))
    last = F.lit(2**31 - 1)
    items = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "entry_id", _source().alias("x")))), lambda r, i: entry(r["x"], i + 1))
    e = c.relation("entries").groupBy("doc_id").agg(F.concat(F.lit(around[0]), F.array_join(items, "\n"), F.lit(around[1])).alias("x"))
    e = e.join(place, "doc_id", "left").select("doc_id", F.coalesce("sec_ord", last).alias("sec_ord"), last.alias("o"), F.lit("").alias("id"), "x")
    return h.unionByName(b).unionByName(e)


def to_markdown(c: Corpus) -> DataFrame:
    """(doc_id, line_no, line): documents as lines of Markdown, in document order, ready to be written as text.

    Lists, tables and the bibliography have a row for each of their lines.
    """
    t = _inline(F.col("runs"), "**%s**", "*%s*", "***%s***", "$%s$", lambda x: x)
    items = F.transform("items", lambda x, i: F.concat(F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), F.coalesce(x, F.lit(""))))

    def line(cells: Column) -> Column:
        texts = F.transform(cells, lambda x: F.replace(F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))

    no = F.array().cast(f"array<array<{CELL}>>")
    headers, rows = F.coalesce("headers", no), F.coalesce("rows", no)
    rule = F.transform(F.slice(headers, 1, 1), lambda row: F.concat(F.lit("|"), F.array_join(F.transform(row, lambda x: F.lit("---")), "|"), F.lit("|")))
    grid = F.concat(F.transform(F.slice(headers, 1, 1), line), rule, F.transform(F.filter(headers, lambda row, i: i > 0), line), F.transform(rows, line))
    plain = _inline(F.col("runs"), "%s", "%s", "%s", "$%s$", lambda x: x)
    table = F.concat_ws("\n\n", F.when(plain != "", F.concat(F.lit("**"), plain, F.lit("**"))), F.when(F.size(grid) > 0, F.array_join(grid, "\n")))
    block = (
        F.when((F.col("block_type") == "list") & F.col("items").isNotNull(), F.array_join(items, "\n")).when(F.col("block_type") == "figure", F.concat(F.lit("!["), plain, F.lit("]()")))
        .when(F.col("block_type") == "formula", F.concat(F.lit("$$"), F.coalesce("latex", F.lit("")), F.lit("$$"))).when(F.col("block_type") == "table", table).otherwise(t)
    )
    head = F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), "text")
    x = _exported(c, head, block, lambda s, n: F.concat(n.cast("string"), F.lit(". "), s))
    w = Window.partitionBy("doc_id").orderBy("sec_ord", "o", "id", "x", "part")
    lines = x.select("doc_id", "sec_ord", "o", "id", "x", F.posexplode(F.split("x", "\n", -1)).alias("part", "line"))
    return lines.select("doc_id", F.row_number().over(w).alias("line_no"), "line")


def escaped(c):  # noqa: ANN001, ANN202
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tagged(tag: str, x: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attributes}>"), F.coalesce(x, F.lit("")), F.lit(f"</{tag}>"))


def to_html(c: Corpus) -> DataFrame:
    """(doc_id, html): each document as HTML: headings, blocks of every type with their inline elements, bibliography.

    Paragraphs that show nothing give no element.
    """
    t = _inline(F.col("runs"), "<strong>%s</strong>", "<em>%s</em>", "<strong><em>%s</em></strong>", "\\(%s\\)", escaped)

    def grid(rows: str, tag: str, around: str) -> Column:
        lines = F.transform(rows, lambda row: _tagged("tr", F.array_join(F.transform(row, lambda x: _tagged(tag, escaped(x["text"]))), "")))
        return F.when(F.size(rows) > 0, _tagged(around, F.array_join(lines, "")))

    items = F.array_join(F.transform("items", lambda x: _tagged("li", escaped(x))), "")
    caption = F.when(t != "", _tagged("caption", t))
    kind = F.col("block_type")
    block = (
        F.when(kind == "paragraph", F.when(~blank(t), _tagged("p", t)))
        .when((kind == "list") & F.col("items").isNotNull(), F.when(F.col("ordered"), _tagged("ol", items)).otherwise(_tagged("ul", items)))
        .when(kind == "table", _tagged("table", F.concat_ws("", caption, grid("headers", "th", "thead"), grid("rows", "td", "tbody"))))
        .when(kind == "figure", _tagged("figure", F.when(t != "", _tagged("figcaption", t))))
        .when(kind == "formula", _tagged("div", F.concat(F.lit("$$ "), escaped(F.coalesce("latex", F.lit(""))), F.lit(" $$")), ' class="formula"'))
        .when(kind == "toc", _tagged("nav", t, ' class="toc"')).otherwise(F.when(~blank(t), _tagged("div", t)))
    )
    level = F.least("level", F.lit(6))
    head = F.concat(F.lit("<h"), level, F.lit(">"), escaped(F.col("text")), F.lit("</h"), level, F.lit(">"))
    x = _exported(c, head, block, lambda s, n: _tagged("li", escaped(s)), ('<ol class="bibliography">\n', "\n</ol>"))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sec_ord", "o", "id", "x"))), lambda r: r["x"]), "\n").alias("html"))
