"""Measures, searches and rewrites over saved editor states, on their flat tables (operators.nested.flat_tables).

A state is a row set per tag: sections, blocks and runs with their paths; what lies inside a section is what has its path
as a prefix. All operators keep one row per state or element and work on all states at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import blank, collapse, words

Flat = dict[str, DataFrame]
# The structural elements of a work that are looked for.
READY = ["title_page", "contents", "introduction", "main_part", "conclusion", "sources", "appendices"]


def _top(path: str = "node_path") -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def _with_text(flat: Flat, key: str) -> DataFrame:
    """Blocks with t: their text, or where that is empty the text of their text runs in order."""
    runs = flat["run"].where("kind = 'text'").groupBy(key, F.col("parent_path").alias("node_path")).agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))).alias("r"))
    joined = F.array_join(F.transform("r", lambda x: x["text"]), "")
    return flat["block"].join(runs, [key, "node_path"], "left").withColumn("t", F.coalesce(F.nullif("text", F.lit("")), joined, F.lit(""))).drop("r")


def progress(flat: Flat, key: str = "state_id") -> DataFrame:
    """How far each state is: top sections and those that hold something, paragraphs, objects, list items, sources, words.

    A section counts as filled when a block or a source anywhere in it shows something. States without sections have no row.
    """
    kind = F.col("kind")
    some = (kind == "paragraph") & ~blank("t")
    b = _with_text(flat, key).groupBy(key, _top().alias("top")).agg(
        F.count_if(kind == "paragraph").alias("paragraphs"), F.count_if(some).alias("nonempty_paragraphs"),
        *[F.count_if(kind == k).alias(f"{k}s") for k in ("table", "figure", "formula")],
        F.sum(F.when(kind == "list", F.coalesce(F.size("items"), F.lit(0))).otherwise(0)).alias("list_items"),
        F.sum(F.when(some, words("t")).otherwise(0)).alias("words"), F.bool_or(some | kind.isin("table", "figure", "formula", "list")).alias("filled"),
    )
    listed = F.when(F.col("is_bibliography"), F.coalesce(F.size("references"), F.lit(0))).otherwise(0)
    s = flat["section"].groupBy(key, _top().alias("top")).agg(F.sum(listed).alias("sources"))
    counts = ["paragraphs", "nonempty_paragraphs", "tables", "figures", "formulas", "list_items", "words", "sources"]
    full = F.coalesce("filled", F.lit(False)) | (F.col("sources") > 0)
    return s.join(b, [key, "top"], "left").groupBy(key).agg(F.count("*").alias("sections"), F.count_if(full).alias("filled_sections"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def readiness(flat: Flat, key: str = "state_id") -> DataFrame:
    """Which structural elements each state has, by the headings of its top sections; a flag for each of READY."""
    n = collapse(F.coalesce("heading", F.lit("")))
    sources = F.coalesce("is_bibliography", F.lit(False)) | (n == "литература") | (n.startswith("список") & (n.contains("источник") | n.contains("литератур")))
    tests = [n == "титульный лист", n == "содержание", n == "введение", n.rlike(r"^\d+(\.\d+)*\.?(\s|$)") & F.col("heading").rlike(r"^\s*\d+(\.\d+)*\.?\s") | n.startswith("глава "), n == "заключение", sources, n.startswith("приложение")]
    return flat["section"].where("parent_path = ''").groupBy(key).agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(x) for x, t in zip(READY, tests)])


def _strings(flat: Flat, key: str) -> DataFrame:
    """(key, node_path, s): every string of a state a reader sees: headings, sources, texts, items, captions, cells."""
    none = F.array().cast("array<string>")
    heads = flat["section"].select(key, "node_path", F.explode(F.concat(F.array("heading"), F.when(F.col("is_bibliography"), F.coalesce("references", none)).otherwise(none))).alias("s"))
    kind = F.col("kind")
    parts = (
        F.when(kind == "paragraph", F.array("text")).when(kind == "list", F.coalesce("items", none)).when(kind == "figure", F.array("caption"))
        .when(kind == "table", F.concat(F.array("caption"), F.coalesce("headers", none), F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>")))))
    )
    blocks = flat["block"].select(key, "node_path", "kind", F.explode(parts).alias("s"))
    par = flat["block"].where("kind = 'paragraph'").select(key, F.col("node_path").alias("parent_path"))
    runs = flat["run"].where("kind = 'text'").join(par, [key, "parent_path"], "left_semi").select(key, "node_path", F.col("text").alias("s"))
    return heads.unionByName(blocks.select(key, "node_path", "s")).unionByName(runs).where("s is not null")


def search(flat: Flat, query: str, key: str = "state_id") -> DataFrame:
    """(key, node_path) of the top sections in which the query occurs anywhere, whatever its case; an empty query finds all."""
    if not query:
        return flat["section"].where("parent_path = ''").select(key, "node_path")
    return _strings(flat, key).where(F.lower("s").contains(query.lower())).select(key, _top().alias("node_path")).distinct()


def replacements(flat: Flat, find: str, key: str = "state_id") -> DataFrame:
    """(key, hits): how often a literal occurs in each state, wherever a replacement would change it; states without are left out."""
    if not find:
        return flat["section"].select(key, F.lit(0).alias("hits")).where("false")
    n = (F.length("s") - F.length(F.replace("s", F.lit(find), F.lit("")))) / len(find)
    return _strings(flat, key).groupBy(key).agg(F.sum(n.cast("int")).alias("hits")).where("hits > 0")


def replaced(column: Column, find: str, by: str) -> Column:
    """A string, or array of strings, with a literal replaced."""
    return F.replace(column, F.lit(find), F.lit(by)) if find else column


def title_case(c: Column) -> Column:
    """Each word with a capital first, the rest of the word as it is; words that begin with no letter stay."""
    return F.array_join(F.transform(F.split(c, " ", -1), lambda w: F.when(w.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))).otherwise(w)), " ")


def retitled(flat: Flat, key: str = "state_id") -> DataFrame:
    """(key, node_path, heading, new_heading) of the headings title case would change."""
    new = title_case(F.col("heading"))
    return flat["section"].where(F.col("heading") != new).select(key, "node_path", "heading", new.alias("new_heading"))


def bare_caption(c: Column, word: str) -> Column:
    """A caption without its label and number (Таблица 1 — ), also where they were put before it several times."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), rf"(?U)^(?:{word}\s+\d+(?:\.\d+)*(?:\s*[—–\-.:]\s*|\s+|$))+", ""))


def bare_captions(flat: Flat, key: str = "state_id") -> DataFrame:
    """(key, node_path, kind, caption) of tables and figures, captions without label and number."""
    b = flat["block"].where(F.col("kind").isin("table", "figure") & F.col("caption").isNotNull())
    return b.select(key, "node_path", "kind", F.when(F.col("kind") == "table", bare_caption(F.col("caption"), "Таблица")).otherwise(bare_caption(F.col("caption"), "Рисунок")).alias("caption"))


def empty_paragraphs(flat: Flat, key: str = "state_id") -> DataFrame:
    """(key, node_path) of the paragraphs that show nothing and can be removed."""
    return _with_text(flat, key).where((F.col("kind") == "paragraph") & blank("t")).select(key, "node_path")


def header_merges(row: Column) -> Column:
    """(col, colspan) of the cells of a header row that extend over the blank cells to their right; blank cells at the start stand alone."""
    start = F.filter(F.transform(row, lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(start, 2, F.greatest(F.size(start), F.lit(1))), F.array(F.size(row)))
    spans = F.zip_with(start, ends, lambda a, b: F.struct(a.alias("col"), (b - a).alias("colspan")))
    return F.filter(spans, lambda s: s["colspan"] > 1)


def versions_diff(flat: Flat, order: DataFrame, key: str = "state_id") -> DataFrame:
    """(doc_id, key, heading, change): how top sections differ from the version of the document before.

    *order* is (key, doc_id, saved_at). Sections are told apart by their heading (#n without one; of equal ones the last
    counts): `added`, `removed`, or `modified` when the number or the content of their blocks, their subsections,
    disabled checks or sources differ. All versions are compared in one pass: each is matched with its successor.
    """
    w = Window.partitionBy("doc_id").orderBy("saved_at", key)
    pairs = order.withColumn("before", F.lag(key).over(w)).where("before is not null").select("doc_id", key, "before")
    inside = flat["block"].select(key, F.col("parent_path").alias("node_path"), F.struct("place", F.xxhash64(*[F.to_json(c) if t.startswith("array") else F.col(c) for c, t in flat["block"].dtypes if c not in (key, "node_path", "parent_path", "place")])).alias("b"), "node_path")
    inside = inside.toDF(key, "node_path", "b", "block_path")
    runs = flat["run"].groupBy(key, F.col("parent_path").alias("block_path")).agg(F.sort_array(F.collect_list(F.xxhash64("place", *[c for c in flat["run"].columns if c not in (key, "node_path", "parent_path", "place")]))).alias("r"))
    blocks = inside.join(runs, [key, "block_path"], "left").groupBy(key, "node_path").agg(F.sort_array(F.collect_list(F.struct("b", "r"))).alias("blocks"))
    subs = flat["section"].where("parent_path <> ''").groupBy(key, F.col("parent_path").alias("node_path")).agg(F.count("*").alias("subs"))
    top = flat["section"].where("parent_path = ''").join(blocks, [key, "node_path"], "left").join(subs, [key, "node_path"], "left")
    name = F.when(F.coalesce("heading", F.lit("")) == "", F.concat(F.lit("#"), "place")).otherwise(F.col("heading"))
    state = F.xxhash64(F.coalesce(F.to_json("blocks"), F.lit("[]")), F.coalesce("subs", F.lit(0)), F.array_join(F.array_sort(F.coalesce("disabled_checks", F.array().cast("array<string>"))), "\n"), F.coalesce(F.array_join("references", "\n"), F.lit("")))
    top = top.groupBy(key, name.alias("name")).agg(F.max_by(state, "place").alias("h"))
    now = pairs.join(top, key).select("doc_id", key, F.col("name").alias("heading"), F.col("h").alias("b"))
    then = pairs.join(top.withColumnRenamed(key, "before"), "before").select("doc_id", key, F.col("name").alias("heading"), F.col("h").alias("a"))
    both = then.join(now, ["doc_id", key, "heading"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select("doc_id", key, "heading", change.alias("change")).where("change is not null")


def in_order(path: str = "node_path") -> Column:
    """Sorts elements as they are read: blocks of a section before its subsections, each by its place."""
    return F.transform(F.split(path, "/"), lambda x: F.struct(F.substring(x, 1, 1).alias("l"), F.substring(x, 2, 9).cast("int").alias("n")))


# Kinds of elements a reference can name, with the prefix of their ids, their label and the text shown without one.
TARGETS = {"figure": ("fig", "Рисунок", "(без подписи)"), "table": ("tbl", "Таблица", "(без подписи)"), "formula": ("formula", "Формула", "(пусто)")}


def reference_targets(flat: Flat, key: str = "state_id") -> DataFrame:
    """(key, node_path, target_id, label): what a reference of each state can name: figures, tables and numbered formulas, counted by kind.

    Sources are left aside. Long formulas are cut to 30 characters in the label.
    """
    sources = flat["section"].where("is_bibliography and parent_path = ''").select(key, F.col("node_path").alias("top"))
    b = flat["block"].where(F.col("kind").isin("figure", "table") | ((F.col("kind") == "formula") & F.coalesce("numbered", F.lit(True))))
    b = b.withColumn("top", _top()).join(sources, [key, "top"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy(key, "kind").orderBy(in_order())))
    names = [F.create_map(*[F.lit(x) for k, v in TARGETS.items() for x in (k, v[j])])[F.col("kind")] for j in range(3)]
    short = F.when(F.length("latex") > 30, F.concat(F.substring("latex", 1, 30), F.lit("…"))).otherwise(F.col("latex"))
    shown = F.coalesce(F.nullif(F.when(F.col("kind") == "formula", short).otherwise(F.col("caption")), F.lit("")), names[2])
    return b.select(key, "node_path", F.concat(names[0], F.lit("-"), "n").alias("target_id"), F.concat(names[1], F.lit(" "), "n", F.lit(": "), shown).alias("label"))


def citation_options(flat: Flat, key: str = "state_id") -> DataFrame:
    """(key, source_id, label): the sources a citation can name, by their place in the first section of sources; long ones cut to 57 characters."""
    first = flat["section"].where("is_bibliography and parent_path = ''").groupBy(key).agg(F.min_by("references", "place").alias("r"))
    s = first.select(key, F.posexplode("r").alias("i", "s")).where(~blank("s")).withColumn("s", F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))
    short = F.when(F.length("s") > 60, F.concat(F.substring("s", 1, 57), F.lit("…"))).otherwise(F.col("s"))
    return s.select(key, F.concat(F.lit("bib-"), F.col("i") + 1).alias("source_id"), F.concat(F.lit("["), F.col("i") + 1, F.lit("] "), short).alias("label"))
