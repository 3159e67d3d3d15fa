"""Deeply nested semi-structured records as related flat tables.

One depth-first pass over each record emits tagged rows (table tag, own path, parent path, place, payload); the
rows are written partitioned by tag, and each tag gets its own schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import fresh_path


@dataclass(frozen=True)
class Node:
    """A kind of nested object: its tag, the letter of its path step, the keys that hold it, the kinds below it."""

    tag: str
    letter: str
    key: str
    below: tuple[str, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.tag, self.letter, self.key, self.below))


# The shape of builder states: sections hold blocks and sections, blocks hold runs.
STATE_ROOT = ("section",)
STATE_NODES = (
    Node("section", "s", "sections", ("section:subsections", "block"),
         {"id": "string", "heading": "string", "is_bibliography": "boolean", "references": "array<string>", "disabled_checks": "array<string>"}),
    Node("block", "b", "blocks", ("run",),
         {"kind": "string", "text": "string", "caption": "string", "latex": "string", "ordered": "boolean", "items": "array<string>",
          "headers": "array<string>", "rows": "array<array<string>>", "image_path": "string", "numbered": "boolean", "meta": "string"}),
    Node("run", "r", "runs", (),
         {"kind": "string", "text": "string", "bold": "boolean", "source_id": "string", "target_id": "string", "pages": "string",
          "prefix": "string", "latex": "string"}),
)


def _reject(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


# The forms of a JSON number and the blanks between JSON tokens.
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _scalar(text: str, at: int) -> tuple[object, int]:
    """The string, number or word that begins at *at*, and where it ends."""
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(f"no JSON value at {at}")
    return (float(m[0]) if m[1] or m[2] else int(m[0])), m.end()


def _load_deep(text: str):  # noqa: ANN202
    """What json.loads returns, for nesting of any depth: open containers are kept in a list instead of on the stack."""
    top: list = []
    stack: list[list] = [[top, None]]  # container and the key that waits for its value
    at = _BLANK.match(text).end()
    while True:
        # a value is due here
        ch = text[at : at + 1]
        if ch in "[{" and ch:
            value: object = [] if ch == "[" else {}
            at += 1
        else:
            value, at = _scalar(text, at)
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(value)
        else:
            box[key] = value
        first = ch in "[{" and bool(ch)
        if first:
            stack.append([value, None])
        # close what ends here, then go to the next value
        while True:
            at = _BLANK.match(text, at).end()
            if len(stack) == 1:
                if at != len(text):
                    raise ValueError(f"more behind the JSON value at {at}")
                return top[0]
            box = stack[-1][0]
            close = "]" if isinstance(box, list) else "}"
            if text[at : at + 1] == close:
                stack.pop()
                at, first = at + 1, False
                continue
            if not first:
                if text[at : at + 1] != ",":
                    raise ValueError(f"no comma at {at}")
                at = _BLANK.match(text, at + 1).end()
            if isinstance(box, dict):
                if text[at : at + 1] != '"':
                    raise ValueError(f"no key at {at}")
                stack[-1][1], at = scanstring(text, at + 1, True)
                at = _BLANK.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"no colon at {at}")
                at = _BLANK.match(text, at + 1).end()
            break


def _load(text: str):  # noqa: ANN202
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:
        return _load_deep(text)


def _dump(value) -> str:  # noqa: ANN001
    """*value* as JSON, for nesting of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Mark):
            out.append(x)
        elif isinstance(x, dict):
            parts = [p for k, v in x.items() for p in (_Mark(", "), _Mark(json.dumps(k, ensure_ascii=False) + ": "), v)][1:]
            todo += [_Mark("}"), *reversed(parts), _Mark("{")]
        elif isinstance(x, list):
            parts = [p for v in x for p in (_Mark(", "), v)][1:]
            todo += [_Mark("]"), *reversed(parts), _Mark("[")]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


class _Mark(str):
    """Text that is written as it stands."""


def _opened(value):  # noqa: ANN001, ANN202
    """A value stored as a JSON string, perhaps repeatedly, as the value itself; None if it is not valid."""
    while isinstance(value, str):
        try:
            value = _load(value)
        except ValueError:
            return None
    return value


def _elements(value) -> list:  # noqa: ANN001
    value = _opened(value)
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def visit(payload: str | None, nodes: tuple[Node, ...] = STATE_NODES, root: tuple[str, ...] = STATE_ROOT) -> Iterator[tuple]:
    """(tag, path, parent path, place, payload) of each nested object, depth first; nothing for unreadable payloads."""
    state = _opened(payload) if payload is not None else None
    if not isinstance(state, dict):
        return
    kinds = {n.tag: n for n in nodes}

    def children(obj: dict, below: tuple[str, ...], path: str) -> list[tuple]:
        out = []
        for name in below:
            tag, _, key = name.partition(":")
            kind = kinds[tag]
            for place, item in enumerate(_elements(obj.get(key or kind.key))):
                if isinstance(item, dict):
                    out.append((kind, item, f"{path}/{kind.letter}{place}" if path else f"{kind.letter}{place}", path, place))
        return out

    stack = children(state, root, "")[::-1]
    while stack:
        kind, obj, path, parent, place = stack.pop()
        inner = {(n.partition(":")[2] or kinds[n.partition(":")[0]].key) for n in kind.below}
        rest = {k: v for k, v in obj.items() if k not in inner}
        yield kind.tag, path, parent, place, _dump(rest)
        stack.extend(children(obj, kind.below, path)[::-1])


def tagged_rows(
    df: DataFrame, key: str, payload: str, order: str | None = None, nodes: tuple[Node, ...] = STATE_NODES, root: tuple[str, ...] = STATE_ROOT
) -> DataFrame:
    """(<key>, tag, node_path, parent_path, place, payload): one row per nested object of every record.

    A record delivered more than once counts once (the row latest by *order*, if given). Null and invalid payloads
    and records whose top is no object give no rows; neither does an element that is no object, though it keeps its
    place. An object where an array belongs is element 0. Arrays and records stored as JSON strings are read like
    the thing itself. Of keys repeated inside an object the last counts. Other columns are left aside.
    """
    late = [F.col(order).alias("o")] if order else []
    one = df.groupBy(key).agg(F.max(F.struct(*late, F.col(payload).alias("p"))).alias("last")).select(key, F.col("last.p").alias("p"))
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("tag", T.StringType()),
            T.StructField("node_path", T.StringType()),
            T.StructField("parent_path", T.StringType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("payload", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for k, p in enumerate(b.column(1).to_pylist()):
                for r in visit(p, nodes, root):
                    at.append(k)
                    rows.append(r)
                if len(rows) > 20_000:
                    yield _batch(b, at, rows, key)
                    at, rows = [], []
            yield _batch(b, at, rows, key)

    return one.mapInArrow(work, schema)


def _batch(b: pa.RecordBatch, at: list[int], rows: list[tuple], key: str) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))],
        names=[key, "tag", "node_path", "parent_path", "place", "payload"],
    )


def typed_table(rows: DataFrame, key: str, node: Node) -> DataFrame:
    """The flat table of one tag: key, node_path, parent_path, place, the columns of the node's schema, and rest.

    rest holds the keys the schema does not list, as a JSON object; null if there are none. A value that does not fit its column reads as null.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in node.columns.items())
    own = rows.where(F.col("tag") == node.tag).withColumn("v", F.from_json("payload", schema))
    others = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: ~k.isin(*node.columns))
    rest = F.when(F.size(others) > 0, F.to_json(others, {"ignoreNullFields": "false"})).alias("rest")
    return own.select(key, "node_path", "parent_path", "place", *[F.col("v")[c].alias(c) for c in node.columns], rest)


def write_tables(rows: DataFrame, path: str) -> None:
    """Write tagged rows partitioned by tag, so that each table is read alone."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def flat_tables(rows: DataFrame, key: str, nodes: tuple[Node, ...] = STATE_NODES) -> dict[str, DataFrame]:
    """The flat table of every tag, from one pass over the records, written partitioned by tag to the shared folder."""
    path = fresh_path(rows.sparkSession, "tagged")
    write_tables(rows, path)
    return read_tables(rows.sparkSession, path, rows.schema, key, nodes)


def read_tables(spark: SparkSession, path: str, schema: T.StructType, key: str, nodes: tuple[Node, ...] = STATE_NODES) -> dict[str, DataFrame]:
    """The flat tables from what :func:`write_tables` wrote; each reads the files of its tag only."""
    back = spark.read.schema(schema).parquet(path)
    return {n.tag: typed_table(back, key, n) for n in nodes}
