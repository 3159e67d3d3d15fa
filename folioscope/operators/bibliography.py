"""Bibliography text: types, fields, missing standards and laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import LEFT, RIGHT
from folioscope.operators.rules import _is
from folioscope.sources.corpus import Corpus


# What names the kind of a source; the first kind named counts, a book is the rest.
KINDS = [
    ("web", r"(?i)https?://"),
    ("standard", rf"{LEFT}ГОСТ{RIGHT}"),
    ("thesis", rf"(?iu){LEFT}(?:дис\.|диссертация{RIGHT}|автореф\.)"),
    ("conference", rf"(?iu){LEFT}(?:конференция{RIGHT}|материалы{RIGHT}|сб\.\s*ст\.)"),
    ("law", rf"(?iu){LEFT}(?:закон{RIGHT}|федер\.\s*закон{RIGHT}|постановление{RIGHT})"),
    ("article", rf"(?:^|\s)//\s|{LEFT}Журнал{RIGHT}|журн\.|{LEFT}No\.|№"),
]
# Where the fields of a description stand (pattern and group), in the order they are tried.
FIELDS = [
    ("author", r"^(?:[А-ЯЁ][а-яё]+\s[А-ЯЁ]\.\s?[А-ЯЁ]\.|[A-Z][a-z]+,?\s[A-Z]\.\s?[A-Z]\.)", 0),
    ("year", rf"{LEFT}(?:19|20)\d{{2}}{RIGHT}", 0),
    ("url", r"https?://\S+", 0),
    ("doi", r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", 0),
    ("access_date", r"(?iu)дата\s+обращения:\s*(\d{1,2}\.\d{1,2}\.\d{4})", 1),
    ("place", r"—\s*([А-ЯЁ][а-яё]+(?:[ \-][А-ЯЁ][а-яё]+)?)\s*:", 1),
]
# Marks of the surrounding sentence at the end of a link.
CLOSING = ").,;"


def entry_type(raw: Column) -> Column:
    """The kind of source a description names: web, standard, thesis, conference, law, article or book."""
    named = F.filter(F.array(*[F.when(raw.rlike(pattern), kind) for kind, pattern in KINDS]), lambda k: k.isNotNull())
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("book"))


def entry_fields(raw: Column) -> Column:
    """Fields found in a description, as a map without the absent ones; links end before marks of the sentence."""
    found = []
    for name, pattern, group in FIELDS:
        value = F.regexp_extract(raw, pattern, group)
        found.append((name, F.rtrim(value, F.lit(CLOSING)) if name in ("url", "doi") else value))
    found.append(("language", F.when(raw.rlike("^[А-ЯЁа-яё]"), "ru").when(raw.rlike("^[A-Za-z]"), "en")))
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in found]), lambda x: F.coalesce(x["v"], F.lit("")) != "")
    return F.map_from_entries(pairs)


STANDARD = r"ГОСТ(?:\s+Р)?\s+\d+(?:\.\d+)*\s*[-–—]\s*\d{4}"
LAW = r"(?iu)(?:№\s*)?(\d{1,4})\s*[-–—]\s*ФЗ"


def missing_sources(c: Corpus, pattern: str = STANDARD) -> DataFrame:
    """(doc_id, source, ordinal): standards and laws named in the text that the bibliography lacks, to be appended.

    Dashes and blanks are brought to one form; each source once per document, in the order of first mention.
    """

    def tidy(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"\s*[-–—]\s*", "-"), r"\s+", " ")

    par = c.relation("blocks").where(_is("paragraph")).select("doc_id", "block_ord", F.col("text").alias("t"))
    std = par.select("doc_id", "block_ord", F.posexplode(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("pos", "m")).withColumn("source", tidy(F.col("m")))
    law = par.select("doc_id", "block_ord", F.posexplode(F.regexp_extract_all("t", F.lit(LAW), F.lit(1))).alias("pos", "m")).withColumn("source", F.concat("m", F.lit("-ФЗ")))
    first = std.unionByName(law).groupBy("doc_id", "source").agg(F.min(F.struct("block_ord", "pos")).alias("at"))
    raw = tidy(F.coalesce(F.col("fields")["raw"], F.lit("")))
    e = c.relation("entries")
    have = e.select("doc_id", F.explode(F.concat(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), F.transform(F.regexp_extract_all(raw, F.lit(LAW), F.lit(1)), lambda x: F.concat(x, F.lit("-ФЗ"))))).alias("source"))
    last = e.groupBy("doc_id").agg(F.max("ordinal").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("at", "source")
    new = first.join(have, ["doc_id", "source"], "left_anti").withColumn("k", F.row_number().over(w)).join(last, "doc_id", "left")
    return new.select("doc_id", "source", (F.coalesce("last", F.lit(0)) + F.col("k")).alias("ordinal"))
