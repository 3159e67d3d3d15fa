"""Visually identical text with different characters.

Text is exploded to positioned code points; decomposition and look-alike tables are joined to them from a
broadcast; combining marks are put into the order of their classes; the rest is recomposed and the strings rebuilt
(:mod:`folioscope.llm.codepoints`). Rows whose consistent forms agree look the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.codepoints import driver_tables, worker_mapper
from folioscope.session import materialize


def consistent_text(df: DataFrame, text: str, form: str = "form", look_alikes: bool = True) -> DataFrame:
    """*df* with the column *form*: the text of the column *text* in one consistent form.

    Width, presentation forms and joined letters fold to plain letters, accents compose, invisible characters go,
    every kind of blank becomes a space, runs of blanks one, blanks at the ends none. With *look_alikes* letters
    shaped like Latin ones become Latin, which serves comparison rather than reading. Case, accents, digits,
    raised digits and added marks stay. Null stays null, blank text becomes empty. A column already called *form*
    is replaced.
    """
    tables = df.sparkSession.sparkContext.broadcast(driver_tables())
    rest = df.drop(form)
    schema = T.StructType([*rest.schema.fields, T.StructField(form, T.StringType())])
    names = list(rest.columns)
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_mapper(tables)
        for b in batches:
            values = b.column(at).to_pylist()
            done = [None if v is None else d for v, d in zip(values, m.consistent(values, look_alikes))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], names=[*names, form])

    return rest.mapInArrow(work, schema)


def look_keys(df: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(scope, id, look, chars): 128-bit keys of each text's consistent form and of its characters.

    Rows with null scope, null id, or a text that shows nothing are left out.
    """
    tables = df.sparkSession.sparkContext.broadcast(driver_tables())
    kept = df.select(F.col(scope).alias("scope"), F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kept = kept.where("scope is not null and id is not null and text is not null and text <> ''")
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("look", T.BinaryType()), T.StructField("chars", T.BinaryType())])

    def digest(values: list[str]) -> list[bytes]:
        return [blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest() for v in values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_mapper(tables)
        for b in batches:
            values = b.column(2).to_pylist()
            forms, stored = m.consistent(values), m.squeezed(values)
            shown = pa.array([k for k, f in enumerate(forms) if f], pa.int64())
            out = [*b.columns[:2], pa.array(digest(forms), pa.binary()), pa.array(digest(stored), pa.binary())]
            yield pa.RecordBatch.from_arrays([c.take(shown) for c in out], names=["scope", "id", "look", "chars"])

    return kept.mapInArrow(work, schema)


def look_alike_pairs(df: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(<key>_a, <key>_b): all pairs of rows of one *scope* whose texts look the same but have other characters.

    The smaller key comes first. Rows with the same characters (up to blanks at the ends and runs of blanks) are no
    pair; rows delivered twice count once. Only variants of one look are paired, then joined to their rows, so many
    copies of one text never meet each other.
    """
    rows = materialize(look_keys(df, scope, key, text), "look")
    several = (
        rows.groupBy("scope", "look")
        .agg(F.min("chars").alias("lo"), F.max("chars").alias("hi"))
        .where("lo <> hi")
        .select("scope", "look")
    )
    members = materialize(rows.join(several, ["scope", "look"], "left_semi").distinct(), "look-members")
    variants = members.select("scope", "look", "chars").distinct()
    a = variants.withColumnRenamed("chars", "chars_a")
    b = variants.withColumnRenamed("chars", "chars_b")
    pairs = a.join(b, ["scope", "look"]).where("chars_a < chars_b")
    left = members.select("scope", "look", F.col("chars").alias("chars_a"), F.col("id").alias("x"))
    right = members.select("scope", "look", F.col("chars").alias("chars_b"), F.col("id").alias("y"))
    both = pairs.join(left, ["scope", "look", "chars_a"]).join(right, ["scope", "look", "chars_b"])
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
