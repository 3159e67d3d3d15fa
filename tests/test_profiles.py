import datetime
import json

import pytest

from folioscope.operators import comments as C
from folioscope.operators import profiles as P
from folioscope.operators.engine import RULES, runnable, validate
from test_rules import corpus, par, run

BASE = {"id": "base", "name": "B", "version": "1.0", "styles": {"page": {"size": "A4", "margins_mm": {"top": 20, "left": 30}}, "body": {"font": "Serif", "line_spacing": 1.5}},
        "checks": {"T.01": {}, "T.03": {"params": {"line_spacing": 2.0, "x": [1, 2]}}, "T.05": {"enabled": False}, "Z.99": {}}, "based_on": ["a", "b"]}
MID = {"id": "mid", "name": "M", "extends": "base", "styles": {"body": {"font": "Sans"}}, "checks": {"T.03": {"severity": "info", "params": {"x": []}}, "T.05": {"enabled": True}}, "based_on": []}
LEAF = {"id": "leaf", "name": "L", "version": "3", "extends": "mid", "styles": {"page": {"margins_mm": {"top": 25}}}, "checks": {"T.01": {"enabled": False}}}


@pytest.fixture
def folder(tmp_path):
    for t in (BASE, MID, LEAF):
        (tmp_path / f"{t['id']}.json").write_text(json.dumps(t))
    return str(tmp_path)


def test_deep_merge():
    assert P.deep_merge({"a": 1, "b": {"c": 1}, "l": [1]}, {"a": None, "b": {"d": 2}, "l": [], "n": 3}) == {"a": 1, "b": {"c": 1, "d": 2}, "l": [1], "n": 3}
    assert P.deep_merge([1], [2, 3]) == [2, 3] and P.deep_merge(1, 0) == 0 and P.deep_merge({"a": 1}, 5) == 5


def test_inheritance(folder):
    t = P.load_tree("leaf", [folder])
    assert (t["id"], t["name"], t["version"], t["extends"], t["based_on"]) == ("leaf", "L", "3", "mid", ["a", "b"])
    assert t["styles"]["page"]["margins_mm"] == {"top": 25, "left": 30} and t["styles"]["body"] == {"font": "Sans", "line_spacing": 1.5}
    assert t["checks"]["T.03"] == {"params": {"line_spacing": 2.0, "x": [1, 2]}, "severity": "info"} and P.skipped_codes(t) == ["Z.99"]
    p = P.to_profile(t)
    assert runnable(p) == ["T.03", "T.05"] and p.severity == {"T.03": "info"} and p.of("T.03")["line_spacing"] == 2.0 and "T.01" in p.disabled
    assert P.load_profile("mid", [folder]).of("T.01") == {"font": "Sans"} and len(RULES) > 100


def test_many_levels_circles_and_errors(tmp_path):
    for k in range(100):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"id": f"p{k}", "extends": f"p{k + 1}" if k < 99 else None, "styles": {"body": {f"k{k}": k}}}))
    assert len(P.load_tree("p0", [str(tmp_path)])["styles"]["body"]) == 100
    (tmp_path / "x.json").write_text('{"id": "x", "extends": "x"}')
    with pytest.raises(ValueError):
        P.load_tree("x", [str(tmp_path)])
    with pytest.raises(FileNotFoundError):
        P.load_tree("none", [str(tmp_path)])
    for bad in ("[]", '{"name": 1}', '{"id": "a", "checks": [1]}'):
        with pytest.raises(ValueError):
            P.read_tree(bad)


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "y.yaml").write_text("id: y\nchecks:\n  T.03:\n    params:\n      line_spacing: 1.25\n")
    assert P.load_profile("y", [str(tmp_path)]).of("T.03") == {"line_spacing": 1.25}


def test_styles_reach_the_rules(spark, folder):
    c = corpus(spark, blocks=[par(1, run("x", font="Serif"), line_spacing=2.0), par(2, run("y", font="Sans"), line_spacing=1.5)])
    got = {(r["check_code"], r["location"], r["severity"]) for r in validate(c, P.load_profile("mid", [folder])).collect()}
    assert got == {("T.01", "paragraph[p-1]", "error"), ("T.03", "paragraph[p-2]", "info")}


def test_diff(spark, folder):
    a, b = P.load_tree("base", [folder]), P.load_tree("leaf", [folder])
    rows = {(r["kind"], r["name"]): (r["in_a"], r["in_b"]) for r in P.profile_diff(spark, a, b).collect()}
    assert rows == {("check", "T.01"): ("true", None), ("check", "T.05"): (None, "true"), ("style", "page.margins_mm"): ('{"left": 30, "top": 20}', '{"left": 30, "top": 25}'), ("style", "body.font"): ('"Serif"', '"Sans"')}
    assert P.profile_diff(spark, a, a).count() == 0


def test_registry(spark, tmp_path, folder):
    path = str(tmp_path / "registry")
    assert P.installed_profiles(spark, path).count() == 0 and not P.uninstall_profile(spark, path, "q")
    assert P.install_profile(spark, path, json.dumps({"id": "own", "extends": "base", "styles": {"body": {"font": "A"}}})) == "own"
    P.install_profile(spark, path, json.dumps({"id": "own", "extends": "base", "styles": {"body": {"font": "B"}}}))
    P.install_profile(spark, path, json.dumps({"id": "base", "checks": {"T.01": {}}}))
    texts = P.installed_texts(spark, path)
    assert sorted(texts) == ["base", "own"] and P.load_profile("own", [folder], texts).of("T.01") == {"font": "B"}
    assert P.uninstall_profile(spark, path, "base") and [r["profile_id"] for r in P.installed_profiles(spark, path).collect()] == ["own"]
    with pytest.raises(ValueError):
        P.install_profile(spark, path, "[]")


def test_comments(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    subs = spark.createDataFrame([(1,), (2,), (2,)], "submission_id long")
    new = spark.createDataFrame([(1, None, None, "  a ", at(1)), (1, "N", "supervisor", "b", at(2)), (1, "N", "supervisor", "b", at(2)), (2, "", "boss", "c", at(1)), (3, "", "student", "d", at(1)), (1, "", "student", "  ", at(1)), (None, "", "student", "e", None)], "submission_id long, author string, role string, body string, created_at timestamp")
    good, bad = C.checked(new, subs)
    assert sorted(r["reason"] for r in bad.collect()) == ["body", "role", "submission", "submission"]
    kept = C.added(spark.createDataFrame([], C.SCHEMA), good)
    assert C.added(kept, good).count() == 2
    a, b = C.listed(kept, 1).collect()
    assert (a["author"], a["role"], a["body"], b["body"]) == ("", "anonymous", "a", "b")
    done = C.resolved(kept, spark.createDataFrame([(a["comment_id"],), ("none",)], "comment_id string"))
    assert [r["body"] for r in C.listed(done, 1, include_resolved=False).collect()] == ["b"]
    assert [tuple(r)[:3] for r in C.open_counts(done).collect()] == [(1, 2, 1)] and C.latest(done).first()["body"] == "b"
    assert C.open_counts(kept.where("false")).count() == 0
