"""Mixing sources to target weights.

Each source gets a number of copies per document that brings its tokens to its share of the total. The fractional
part is settled by pivotal dependent rounding: two documents with fractional copies transfer mass at random until
one of them is whole, so that the tokens of the source stay what they were. Every partition rounds its own rows and
hands on one residual document per source; residuals meet in a reduction tree.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that cuts text before byte-pair merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: More sources than this are no mixture but a join; the plan of shares is made on the driver.
MOST_SOURCES = 100_000

_ENCODERS: dict[str, object] = {}


def _encoder(name: str, ranks_file: bytes):  # noqa: ANN202
    if name not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def source_name(c: Column | str) -> Column:
    """Sources spelled otherwise (case, blanks) as one; null and blank read as null."""
    return F.nullif(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def token_counts(df: DataFrame, text: str, out: str = "tokens", vocabulary: str = VOCABULARY, drop_text: bool = True) -> DataFrame:
    """*df* with the number of tokens of each text, whole; null and empty texts have none.

    *vocabulary* is a file of ranks of a byte-level BPE; the driver reads it and sends it to the workers (a vocabulary
    has a fixed size of about a megabyte). A column called *out* is replaced.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    rest = df.drop(out)
    names = [c for c in rest.columns if not (drop_text and c == text)]
    at = rest.columns.index(text)
    keep = [rest.columns.index(c) for c in names]
    schema = T.StructType([*(rest.schema[c] for c in names), T.StructField(out, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(vocabulary, ranks.value)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], names=[*names, out])

    return rest.mapInArrow(work, schema)


@dataclass(frozen=True)
class Share:
    """What one source gives to the mixture: its tokens, copies per document, and tokens wanted."""

    source: str
    target: float
    repeats: int
    tokens: int
    copies: float


def plan_shares(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int | None = None) -> list[Share]:
    """Copies per document of every listed source.

    Shares are taken relative to their sum. *total* is the size of the mixture, by default the tokens all listed
    sources hold. A source cannot give more than its tokens times its repeats; what it lacks goes to the others in
    proportion to their shares, as far as they can give, so every source comes as near to its share as possible.
    A source listed twice counts with its last row by share; null or negative shares and repeats read as 0.
    """
    rows: dict[str, tuple[float, int]] = {}
    for name, share, repeats in sorted(targets, key=lambda r: (r[0], r[1] or 0, r[2] or 0)):
        rows[name] = (max(0.0, share or 0.0), max(0, repeats or 0))
    whole = sum(s for s, _ in rows.values()) or 1.0
    supply = {n: tokens.get(n, 0) * r for n, (_, r) in rows.items()}
    if total is None:
        total = sum(tokens.get(n, 0) for n in rows)
    gives: dict[str, float] = {}
    open_, left = {n for n, (s, _) in rows.items() if s > 0 and supply[n] > 0}, float(total)
    while open_:
        scale = left / sum(rows[n][0] for n in open_)
        full = {n for n in open_ if rows[n][0] * scale >= supply[n]}
        if not full:
            gives |= {n: rows[n][0] * scale for n in open_}
            break
        for n in full:
            gives[n] = float(supply[n])
        left = max(0.0, left - sum(supply[n] for n in full))
        open_ -= full
    return [
        Share(n, s / whole, r, tokens.get(n, 0), gives.get(n, 0.0) / tokens[n] if tokens.get(n) else 0.0) for n, (s, r) in sorted(rows.items())
    ]


def _chance(*keys: object) -> float:
    """A number in [0, 1) that depends on the keys only, so a repeated task decides alike."""
    return int.from_bytes(blake2b("|".join(map(str, keys)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(rows: Iterator[tuple[object, int, float]], seed: str) -> Iterator[tuple[object, int, float]]:
    """Round (key, weight, probability) rows pairwise; the last one may stay fractional and comes last.

    The sum of weight times probability is kept, and each row's probability is its chance to end at 1. Rows of
    weight 0 decide alone.
    """
    held: tuple[object, int, float] | None = None
    for key, w, p in rows:
        if p <= 1e-12 or p >= 1 - 1e-12:
            yield key, w, float(round(p))
            continue
        if w <= 0:
            yield key, w, float(_chance(seed, key) < p)
            continue
        if held is None:
            held = (key, w, p)
            continue
        k, v, q = held
        up = min(1 - q, p * w / v)  # mass the held row can take
        down = min(q, (1 - p) * w / v)  # mass it can give
        if _chance(seed, k, key) < down / (up + down):
            q2, p2 = q + up, p - up * v / w
        else:
            q2, p2 = q - down, p + down * v / w
        first, second = (k, v, q2), (key, w, p2)
        held = None
        for r in (first, second):
            if r[2] <= 1e-12 or r[2] >= 1 - 1e-12:
                yield r[0], r[1], float(round(r[2]))
            else:
                held = r
    if held is not None:
        yield held


def round_copies(df: DataFrame, key: str, group: str, weight: str, copies: str, seed: str = "mix", fan: int = 4096) -> DataFrame:
    """*df* with *copies* rounded to whole numbers within each *group*, keeping the sum of weight times copies.

    Partitions round alone; each hands on at most one row per group. These residuals meet in a reduction tree: on each
    level the rows of a group are spread over ever fewer parts, at most *fan* residuals to a part, until a group is one
    part, whose last row is decided by chance. The number of levels depends on how many partitions a group lies in,
    never on the number of groups. A group of any size is spread over all partitions that hold it. Null copies and
    rows of null group get 0. Each level is written to the shared folder, so that a lost executor cannot change what
    was decided.
    """
    schema = T.StructType([*df.drop(copies, "settled").schema.fields, T.StructField(copies, T.DoubleType()), T.StructField("settled", T.BooleanType())])
    rest = df.drop(copies, "settled").columns
    names = list(schema.names)
    ki, gi, wi = rest.index(key), rest.index(group), rest.index(weight)

    def level(n: int, last: bool):  # noqa: ANN202
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[object, tuple[tuple, float]] = {}
            kinds = None
            for b in batches:
                kinds = b.schema
                cols = [b.column(c).to_pylist() for c in (*rest, copies)]
                done: list[tuple] = []
                for row in zip(*cols):
                    c = row[-1] or 0.0
                    if row[gi] is None:
                        c = 0.0
                    whole = float(np.floor(c + 1e-12))
                    part = max(0.0, c - whole)
                    if part <= 1e-12:
                        done.append((*row[:-1], whole, True))
                        continue
                    mine = held.pop(row[gi], None)
                    if mine is None:
                        mine_rows = [(0, row[wi] or 0, part)]
                        both = {0: (row[:-1], whole)}
                    else:
                        (old, old_whole), old_part = mine
                        mine_rows = [(0, old[wi] or 0, old_part), (1, row[wi] or 0, part)]
                        both = {0: (old, old_whole), 1: (row[:-1], whole)}
                    for k, _, p in pivot(iter(mine_rows), f"{seed}|{n}|{both[0][0][ki]}|{both.get(1, both[0])[0][ki]}"):
                        r, wh = both[k]
                        if 1e-12 < p < 1 - 1e-12:
                            held[row[gi]] = ((r, wh), p)
                        else:
                            done.append((*r, wh + round(p), True))
                yield _rows(done, kinds, names)
            left = []
            for (r, wh), p in held.values():
                if last:
                    left.append((*r, wh + float(_chance(seed, "last", r[ki]) < p), True))
                else:
                    left.append((*r, wh + p, False))
            if left:
                yield _rows(left, kinds, names)

        return work

    first = materialize(df.select(*rest, copies).mapInArrow(level(1, last=False), schema), "round-1")
    layers, left, n = [first.where("settled")], first.where("not settled").select(*rest, copies), 1
    parts = left.groupBy(group).count().agg(F.max("count")).first()[0] or 0  # residuals of the group that has most
    while parts:
        parts = -(-parts // max(2, fan))
        n, last = n + 1, parts == 1
        salt = F.pmod(F.xxhash64(F.col(key), F.lit(n)), F.lit(parts))
        out = materialize(left.repartition(F.col(group), salt).mapInArrow(level(n, last), schema), f"round-{n}")
        layers.append(out.where("settled"))
        if last:
            break
        left = out.where("not settled").select(*rest, copies)
    done = layers[0]
    for x in layers[1:]:
        done = done.unionByName(x)
    return done.select(*rest, F.col(copies).cast("long").alias(copies))


def _rows(rows: list[tuple], kinds: pa.Schema, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    types = [kinds.field(k).type for k in range(len(names) - 2)] + [pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(<key>, source, tokens) of every document, written once."""
    some = docs.select(key, source_name(source).alias("source"), F.col(text).cast("string").alias("__text"))
    return materialize(token_counts(some, "__text", vocabulary=vocabulary), "sizes")


def shares_of(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[Share]:
    """The plan for the sources in *targets* (source, target_share, max_repeats)."""
    listed = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    rows = listed.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    per = sizes.join(F.broadcast(listed.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n"))
    tokens = {r["source"]: int(r["n"] or 0) for r in per.collect()}
    return plan_shares([(r["source"], r["target_share"], r["max_repeats"]) for r in rows], tokens, total)


def mixture(sizes: DataFrame, shares: list[Share], key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """(<key>, source, tokens, copies): how often each document of a listed source comes; 0 for those left out.

    Documents without a listed source are no part of the mixture.
    """
    spark = sizes.sparkSession
    plan = spark.createDataFrame([(s.source, s.copies) for s in shares], "source string, copies double")
    return round_copies(sizes.join(F.broadcast(plan), "source").select(key, "source", "tokens", "copies"), key, "source", "tokens", "copies", seed)


def share_report(mixed: DataFrame, shares: list[Share]) -> DataFrame:
    """Per listed source its target share, what it holds and gives, the share reached, and its largest repetition."""
    spark = mixed.sparkSession
    plan = spark.createDataFrame(
        [(s.source, s.target, s.repeats, s.tokens) for s in shares], "source string, target_share double, max_repeats int, tokens_held long"
    )
    got = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_mixed"), F.sum("copies").alias("documents_mixed"), F.max("copies").alias("most_copies")
    )
    all_ = got.agg(F.sum("tokens_mixed").alias("whole"))
    out = plan.join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(all_))  # one row
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens_mixed", "documents_mixed", "most_copies")}
    return out.withColumns(zero).select(
        "source", "target_share", "max_repeats", "tokens_held", "tokens_mixed", "documents_mixed", "most_copies",
        F.coalesce(F.try_divide("tokens_mixed", "whole"), F.lit(0.0)).alias("actual_share"),
    )
