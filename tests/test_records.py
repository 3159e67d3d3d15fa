import json

from folioscope.operators.nested import STATE_NODES, tagged_rows, typed_table, visit, write_tables
from folioscope.operators.orphans import Reference, orphan_cascade, orphan_report, records, references

TARGET = "doc_id long, k string, loaded_at timestamp_ntz, is_deleted boolean, status string"
RUNS = "run_id long, doc_id long, source_id string, target_id string, loaded_at timestamp_ntz, level int"


def at(day):
    import datetime

    return datetime.datetime(2024, 1, day)


def test_orphan_statuses(spark):
    refs = [Reference("run", "source_id", "e"), Reference("run", "target_id", "e")]
    targets = [(1, "a", at(1), False, ""), (1, "b", at(1), False, ""), (1, "b", at(3), True, ""), (1, "c", at(9), None, ""), (1, "c", at(9), None, ""), (1, "d", at(2), True, ""), (1, "d", at(2), False, ""), (1, None, at(1), False, ""), (2, "z", at(1), False, "")]
    runs = [(1, 1, " a ", None, at(2), 0), (2, 1, "b", "  ", at(5), 0), (3, 1, "c", "zz", at(2), 0), (3, 1, "c", "zz", at(20), 0), (4, 1, "d", "", at(3), 0), (5, 2, "a", None, at(3), 0), (6, None, "a", None, at(3), 0), (7, 1, None, "​ ", at(3), 0)]
    nodes = records(spark.createDataFrame(targets, TARGET), "e", "doc_id", "k", "loaded_at", "is_deleted")
    edges = references(spark.createDataFrame(runs, RUNS), "doc_id", "run_id", "loaded_at", refs)
    got = {(r["key"], r["field"], r["status"]) for r in orphan_cascade([edges], [nodes], refs).collect()}
    assert got == {(2, "source_id", "deleted"), (3, "source_id", "late"), (3, "target_id", "missing"), (5, "source_id", "missing"), (6, "source_id", "missing")}
    empty = orphan_cascade([edges.where("false")], [nodes], refs)
    assert empty.count() == 0 and orphan_report(empty).count() == 0


def test_cascade_and_circle(spark):
    refs = [Reference("n", "up", "n")]
    rows = [(1, "a", "gone"), (1, "b", "a"), (1, "c", "b"), (1, "d", None), (1, "e", "d"), (1, "x", "y"), (1, "y", "x")]
    df = spark.createDataFrame([(d, k, u, at(2), False) for d, k, u in rows], "doc_id long, k string, up string, loaded_at timestamp_ntz, is_deleted boolean")
    out = orphan_cascade([references(df, "doc_id", "k", "loaded_at", refs)], [records(df, "n", "doc_id", "k", "loaded_at", "is_deleted")], refs).collect()
    assert {(r["key"], r["status"], r["level"]) for r in out} == {("a", "missing", 0), ("b", "inherited", 1), ("c", "inherited", 2)}


def test_visit_shapes():
    state = {"sections": json.dumps([7, {"blocks": {"runs": [None, {"text": "t"}, "x"]}, "subsections": json.dumps(json.dumps([{"id": "q"}]))}])}
    got = [r[:3] for r in visit(json.dumps(json.dumps(state)))]
    assert got == [("section", "s1", ""), ("section", "s1/s0", "s1"), ("block", "s1/b0", "s1"), ("run", "s1/b0/r1", "s1/b0")]
    for bad in (None, "", "{", "[]", "3", "null", '{"sections": NaN}', '"{"', '{"sections": [1, "{}"]}'):
        assert list(visit(bad)) == []
    deep = {"sections": []}
    node = deep
    for _ in range(300):
        child = {"subsections": []}
        node[next(iter(node))].append(child)
        node = child
    assert len(list(visit(json.dumps(deep)))) == 300


def test_records_of_any_depth():
    n = 5000
    text = '{"sections": [' + '{"id": "q", "subsections": [' * n + "]}" * n + "]}"
    rows = list(visit(text))
    assert len(rows) == n and rows[-1][1].count("/") == n - 1 and rows[0][4] == '{"id": "q"}'
    assert list(visit(json.dumps(text)))[-1] == rows[-1] and list(visit(text[:-1])) == []
    deep = '{"meta": ' + "[" * n + '"x", {}' + "]" * n + "}"
    got = list(visit('{"sections": [' + deep + "]}"))
    assert [r[4] for r in got] == [deep]


def test_iterative_reader_agrees():
    import random

    from folioscope.operators.nested import _dump, _load_deep

    rng = random.Random(3)

    def value(d):
        k = rng.randrange(8 if d else 5)
        return [None, True, rng.randrange(-9, 99), rng.random() * 1e9, "a\"\\\nж𝒳"][k] if k < 5 else [value(d - 1) for _ in range(rng.randrange(4))] if k < 7 else {str(j): value(d - 1) for j in range(rng.randrange(4))}

    for _ in range(300):
        v = value(5)
        assert _load_deep(json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)) == v and json.loads(_dump(v)) == v
    for bad in ("", "{", "[1,]", "[1 2]", '{"a" 1}', '{"a":1,}', "{1:2}", "tru", "NaN", "01", "[1]]", '"a', '["\n"]', "[,1]", "-", "1."):
        try:
            json.loads(bad, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
            ok = True
        except ValueError:
            ok = False
        try:
            _load_deep(bad)
            assert ok, bad
        except ValueError:
            assert not ok, bad


def test_tables_round_trip(spark, tmp_path):
    payload = json.dumps({"sections": [{"heading": "H", "disabled_checks": ["a"], "blocks": [{"kind": "paragraph", "runs": [{"kind": "text", "text": "т", "bold": True}, {"text": 5}]}]}]})
    df = spark.createDataFrame([(1, payload, 1, "x"), (1, payload, 1, "x"), (2, "{", 1, "x"), (3, None, 1, "x")], "state_id long, payload string, saved_at int, tag string")
    rows = tagged_rows(df, "state_id", "payload", "saved_at")
    write_tables(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["tag"] for r in back.collect()) == ["block", "run", "run", "section"]
    assert [(r["text"], r["bold"]) for r in typed_table(rows, "state_id", STATE_NODES[2]).orderBy("place").collect()] == [("т", True), ("5", None)]
    assert typed_table(rows, "state_id", STATE_NODES[0]).first()["disabled_checks"] == ["a"]
    assert tagged_rows(df.where("false"), "state_id", "payload").count() == 0


def test_cascade_tells_when_levels_do_not_suffice(spark):
    import pytest

    refs = [Reference("n", "up", "n")]
    df = spark.createDataFrame([(1, k, u, at(2), False) for k, u in ("ax", "ba", "cb", "dc")], "doc_id long, k string, up string, loaded_at timestamp_ntz, is_deleted boolean")
    edges, nodes = [references(df, "doc_id", "k", "loaded_at", refs)], [records(df, "n", "doc_id", "k", "loaded_at", "is_deleted")]
    assert orphan_cascade(edges, nodes, refs, levels=3).count() == 4
    with pytest.raises(ValueError):
        orphan_cascade(edges, nodes, refs, levels=2)


def test_blocks_keep_meta_numbered_and_unlisted_keys(spark):
    block = {"kind": "figure", "numbered": False, "meta": {"dpi": 79, "runs": [{"text": "n"}]}, "new": {"a": 1}}
    payload = json.dumps({"sections": [{"blocks": [block, {"kind": "list", "items": ["x"]}]}]})
    rows = tagged_rows(spark.createDataFrame([(1, payload)], "state_id long, payload string"), "state_id", "payload")
    a, b = typed_table(rows, "state_id", STATE_NODES[1]).orderBy("place").collect()
    assert a["numbered"] is False and json.loads(a["meta"]) == block["meta"] and json.loads(json.loads(a["rest"])["new"]) == {"a": 1}
    assert (b["meta"], b["rest"], b["items"]) == (None, None, ["x"])
