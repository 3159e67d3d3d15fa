"""The corpus as related frames, and how it is read from tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import strip, text_of
from folioscope.session import materialize, table

RUN = "struct<run_ord:int,kind:string,text:string,bold:boolean,italic:boolean,font:string,size_pt:double,color_hex:string,target_id:string,prefix:string,source_id:string,pages:string>"
CELL = "struct<text:string,size_pt:double>"
SCHEMAS = {
    "docs": "doc_id bigint, title string, profile_id string, work_year int, auto_hyphenation boolean",
    "pages": "doc_id bigint, ps_ord int, ps_id string, ps_type string, paper string, orientation string, margins_mm map<string,double>, "
    "border struct<enabled:boolean,style:string,size:double>, header struct<left:string,center:string,right:string>, "
    "footer struct<left:string,center:string,right:string>, visible boolean, format string, start_mode string, start_value int, "
    "link_to_previous boolean, title_block boolean",
    "secs": f"doc_id bigint, sec_id string, parent_id string, sec_ord int, level int, path array<string>, heading array<{RUN}>, disabled_checks array<string>",
    "blocks": "doc_id bigint, block_id string, block_ord int, container_id string, block_type string, style_name string, alignment string, "
    "line_spacing double, first_line_indent_cm double, page_break_before boolean, space_before_pt double, space_after_pt double, dpi int, "
    f"latex string, number string, ordered boolean, items array<string>, headers array<array<{CELL}>>, rows array<array<{CELL}>>, runs array<{RUN}>",
    "entries": "doc_id bigint, ordinal int, entry_id string, entry_type string, fields map<string,string>",
}


@dataclass(frozen=True)
class Corpus:
    """Lazy frames of one collection; every frame has a doc_id, and all rules work on all documents at once."""

    docs: DataFrame
    pages: DataFrame
    secs: DataFrame
    blocks: DataFrame
    entries: DataFrame
    made: dict = field(default_factory=dict, compare=False)

    def relation(self, name: str) -> DataFrame:
        """A frame with the derived columns the rules read; each is planned once."""
        if name not in self.made:
            self.made[name] = DERIVED[name](self)
        return self.made[name]

    def written(self) -> Corpus:
        """The same corpus with its frames, their derived columns and the shared relations written once.

        For runs of all rules: each reads the few columns it needs of what is written, and nothing is derived twice.
        """
        names = ("docs", "pages", "heads", "blocks", "entries")
        with ThreadPoolExecutor(len(names)) as pool:  # small frames do not wait for large ones
            made = dict(zip(names, pool.map(lambda n: materialize(self.relation(n), n), names)))
        plain = made["blocks"].drop("text", "text_x", "category")
        out = Corpus(made["docs"], made["pages"], made["heads"].drop("text"), plain, made["entries"], made)
        with ThreadPoolExecutor(max(1, len(SHARED))) as pool:
            made |= dict(zip(SHARED, pool.map(lambda n: materialize(out.relation(n), n), SHARED)))
        return out


def paragraph_category(text: str = "text") -> Column:
    """caption, footnote, header_footer, heading, placeholder or body, by the style and the text of a paragraph."""
    s = F.lower(strip(F.coalesce("style_name", F.lit(""))))
    return (
        F.when(s.startswith("caption") | s.startswith("название"), "caption")
        .when(s == "footnote text", "footnote")
        .when(s.isin("header", "footer"), "header_footer")
        .when(s.startswith("heading"), "heading")
        .when(strip(text).startswith("[Рисунок:") | strip(text).startswith("[Таблица:"), "placeholder")
        .otherwise("body")
    )


def with_text(blocks: DataFrame) -> DataFrame:
    """Blocks with text (of their text runs), text_x (with references) and the category of a paragraph."""
    plain = text_of("runs")
    shown = text_of("runs", lambda r: r["kind"].isin("text", "xref"))
    texts = blocks.withColumns({"text": F.coalesce(plain, F.lit("")), "text_x": F.coalesce(shown, F.lit(""))})
    return texts.withColumn("category", paragraph_category())


#: Derived relations by name; rules read them through Corpus.relation.
DERIVED: dict[str, Callable[[Corpus], DataFrame]] = {
    "docs": lambda c: c.docs,
    "pages": lambda c: c.pages,
    "heads": lambda c: c.secs.withColumn("text", text_of("heading")),
    "blocks": lambda c: with_text(c.blocks),
    "entries": lambda c: c.entries,
}
#: Derived relations that several rules read.
SHARED: list[str] = []


def derived(name: str, shared: bool = False):  # noqa: ANN201
    """Register a derived relation: a function from the corpus to a frame."""

    def add(fn: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        DERIVED[name] = fn
        if shared:
            SHARED.append(name)
        return fn

    return add


def latest(df: DataFrame, keys: list[str], loaded: str = "loaded_at", deleted: str | None = "is_deleted") -> DataFrame:
    """The current row of each key: the one loaded last (a live one wins a tie), unless it is deleted."""
    rest = [c for c in df.columns if c not in (*keys, loaded, deleted)]
    live = (~F.coalesce(F.col(deleted), F.lit(False))) if deleted else F.lit(True)
    row = F.struct(F.col(loaded), live.alias("live"), F.struct(*rest).alias("r"))
    # maps cannot be compared, so the row is picked by its time and not ordered itself
    one = df.select(*keys, F.struct(F.col(loaded).alias("a"), live.alias("b")).alias("o"), row.alias("w")).groupBy(*keys).agg(F.max_by("w", "o").alias("w"))
    return one.where("w.live").select(*keys, *[F.col(f"w.r.{c}").alias(c) for c in rest])


def shaped(spark: SparkSession, name: str, df: DataFrame | None = None) -> DataFrame:
    """*df* with exactly the columns of a frame; those it lacks are null. Without *df* an empty frame."""
    schema = spark.createDataFrame([], SCHEMAS[name]).schema
    if df is None:
        return spark.createDataFrame([], schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def make(spark: SparkSession, **frames: DataFrame) -> Corpus:
    """A corpus from the frames given; the others are empty."""
    return Corpus(**{n: shaped(spark, n, frames.get(n)) for n in SCHEMAS})


def from_tables(spark: SparkSession, d: str) -> Corpus:
    """The current state of the documents in the tables: redelivered rows once, deleted ones not."""
    docs = table(spark, d, "documents").select("doc_id", "title", "profile_id", "work_year")
    secs = latest(table(spark, d, "sections"), ["doc_id", "sec_id"]).withColumnsRenamed({"sec_level": "level", "sec_path": "path"})
    empty = {"run_ord": "int", "italic": "boolean", "font": "string", "color_hex": "string", "target_id": "string", "prefix": "string", "source_id": "string", "pages": "string"}
    order = [p.split(":")[0] for p in RUN[7:-1].split(",")]
    head = F.transform("heading", lambda r: F.struct(*[(F.lit(None).cast(empty[n]) if n in empty else r[n]).alias(n) for n in order]))
    secs = secs.withColumn("heading", head)
    runs = table(spark, d, "runs").where("block_id is not null").withColumn("color_hex", F.lit(None).cast("string"))
    part = F.struct(F.struct(*[F.col(n) for n in order]).alias("r"), F.col("run_id"))
    inside = runs.groupBy("doc_id", "block_id").agg(F.sort_array(F.collect_set(part)).alias("p")).select("doc_id", "block_id", F.col("p.r").alias("runs"))
    blocks = latest(table(spark, d, "blocks"), ["doc_id", "block_id"]).join(inside, ["doc_id", "block_id"], "left")
    blocks = blocks.withColumn("runs", F.coalesce("runs", F.array().cast(f"array<{RUN}>")))
    entries = latest(table(spark, d, "bibliography"), ["doc_id", "entry_id"]).withColumnRenamed("entry_fields", "fields")
    return make(spark, docs=docs, secs=secs, blocks=blocks, entries=entries)
