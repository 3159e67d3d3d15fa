import json

from test_rules import corpus, obj, par, run, sec

from folioscope.operators import bibliography as B
from folioscope.operators import reports as R
from folioscope.operators.engine import validate
from folioscope.sources.imports import from_markdown, from_states, to_html, to_markdown
from folioscope.streaming.check import check_stream, submissions_per_window
from pyspark.sql import functions as F

V = "doc_id long, check_code string, severity string, location string, detail string"


def test_stats(spark):
    c = corpus(spark, docs=(1, 2), secs=[sec(1, "A"), sec(2, "B", 2, parent="s1")], blocks=[par(1, "Привет мир"), par(2, " "), par(3, "раз два три", container_id="s2"), par(4, "вне", container_id=None)])
    s = {r["doc_id"]: r for r in R.document_stats(c).collect()}
    assert (s[1]["words"], s[1]["paragraphs"], s[1]["nonempty_paragraphs"], s[1]["words_per_paragraph"], s[1]["sections_2"]) == (6, 4, 3, 2.0, 1)
    assert s[2]["words"] == 0 and s[2]["words_per_paragraph"] == 0.0
    assert {(r["sec_id"], r["words"]) for r in R.section_stats(c).collect()} == {("s1", 5), (None, 1)}
    more = corpus(spark, secs=[sec(1, "A"), sec(2, "B"), sec(3, "C", 2, parent="s2")], blocks=[par(1, "x", run(None, "xref", target_id="t"), run("y", "formula")), obj("list", 2, None, items=["p", "q"])])
    got = {r["sec_id"]: r for r in R.section_stats(more).collect()}
    assert set(got) == {"s1", "s2"} and (got["s2"]["paragraphs"], got["s2"]["heading"]) == (0, "B")
    assert [got["s1"][k] for k in ("lists", "list_items", "paragraphs_with_xref", "paragraphs_with_formula", "paragraphs_with_citation")] == [1, 2, 1, 1, 0]


def test_reports_and_diff(spark):
    a = spark.createDataFrame([(1, "T.01", "error", "p", "A  b"), (1, "T.02", "info", "p", None), (1, "T.02", "info", "p", None)], V)
    b = spark.createDataFrame([(1, "T.01", "error", "p", "a b"), (2, "S.01", "warning", "q", "x")], V)
    assert {(r["change"], r["check_code"]) for r in R.violation_diff(a, b).collect()} == {("fixed", "T.02"), ("introduced", "S.01")}
    assert R.severity_pivot(a).first().asDict() == {"doc_id": 1, "errors": 1, "warnings": 0, "infos": 2, "total": 3}
    assert [r["check_code"] for r in R.top_codes(a, 1).collect()] == ["T.02"]
    assert R.filtered(a, ["info"], ["T"]).count() == 2 and R.filtered(a).count() == 3
    assert R.category_rollup(a).count() == 3
    d = R.full_diff(a.dropDuplicates(["check_code"]), b, ["check_code"], ["severity", "detail"]).collect()
    assert {(r["check_code"], r["status"]) for r in d} == {("T.01", "changed"), ("T.02", "removed"), ("S.01", "added")}


def test_violations_in_their_place(spark):
    c = corpus(spark, docs=(1, 2), secs=[sec(1, "A"), sec(2, "B"), sec(3, "C", 2, parent="s2")], blocks=[par(1, "x", container_id="s3"), par(2, "y", container_id=None)])
    v = spark.createDataFrame([(1, "T.01", "error", "paragraph[p-1]", "a|b"), (1, "T.01", "error", "paragraph[p-2]", None), (1, "S.01", "error", "document", "x"), (1, "H.05", "info", "section[s3]", ""), (1, "R.04", "error", "bibliography[p-1]", "q")], V)
    got = {r["location"]: (r["top"], r["top_no"]) for r in R.placed(v, c).collect()}
    assert got == {"paragraph[p-1]": ("s2", 1), "paragraph[p-2]": (None, None), "document": (None, None), "section[s3]": ("s2", 1), "bibliography[p-1]": (None, None)}
    lines = [r["line"] for r in R.markdown_report(v.where("check_code in ('T.01', 'H.05')")).orderBy("line_no").collect()]
    head = ["", "| code | severity | location | detail |", "| --- | --- | --- | --- |"]
    assert lines == ["## 1", "", "### H", *head, "| H.05 | info | section[s3] |  |", "", "### T", *head, "| T.01 | error | paragraph[p-1] | a\\|b |", "| T.01 | error | paragraph[p-2] |  |", ""]
    assert R.markdown_report(v.where("false")).count() == 0 and R.placed(v.where("false"), c).count() == 0


def test_inheritance_and_history(spark, tmp_path):
    p = spark.createDataFrame([("a", None, "A", "1"), ("b", "a", None, "2"), ("c", "b", None, None), ("x", "y", None, "9"), ("y", "x", "Y", None), ("z", "gone", None, None)], "id string, up string, name string, version string")
    got = {r["id"]: (r["name"], r["version"]) for r in R.inherited(p, "id", "up", ["name", "version"]).collect()}
    assert got == {"a": ("A", "1"), "b": ("A", "2"), "c": ("A", "2"), "x": ("Y", "9"), "y": ("Y", "9"), "z": (None, None)}
    s = spark.createDataFrame([(1, 7, 1, "p"), (2, 7, 2, "p"), (3, 7, 3, "q"), (4, 8, 1, None)], "state_id long, doc_id long, saved_at int, payload string")
    assert {r["state_id"] for r in R.retained(s, 1).collect()} == {3, 4} and {r["state_id"] for r in R.changed_versions(s).collect()} == {1, 3, 4}
    assert R.without(s, s.where("doc_id = 7"), ["doc_id"]).count() == 1
    sub = spark.createDataFrame([(1, "f")], "id long, filename string").withColumn("created_at", F.timestamp_ntz_literal("2024-02-03") if hasattr(F, "timestamp_ntz_literal") else F.lit("2024-02-03").cast("timestamp_ntz"))
    sub = sub.withColumnRenamed("id", "submission_id")
    found = spark.createDataFrame([(1, "T.01", "error"), (1, "T.02", "info"), (9, "T.01", "error")], "submission_id long, check_code string, severity string")
    for _ in range(2):  # recording twice changes nothing
        R.record(sub, found, str(tmp_path / "h"))
    R.record(sub.withColumn("submission_id", F.lit(2).cast("long")), found.where("submission_id = 1").withColumn("submission_id", F.lit(2).cast("long")), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h/violations")).count() == 4 and spark.read.parquet(str(tmp_path / "h/submissions")).count() == 2
    head, body = R.get_submission(spark, str(tmp_path / "h"), 1)
    assert head.first()["filename"] == "f" and {r["check_code"] for r in body.collect()} == {"T.01", "T.02"}
    sub = sub.withColumnRenamed("submission_id", "id")
    assert R.recent(sub.withColumn("error_count", F.lit(1)), 5, "f").count() == 1


def test_bibliography_text(spark):
    raw = ["Иванов И. И. Книга. — Москва : Наука, 2019.", "Smith, J. K. Site. URL: https://a.b/c (дата обращения: 01.02.2020)", "ГОСТ 7.32-2017", "Петров П. П. дис. канд.", "О чём-то // Журнал. 2001. № 3"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    out = {r["k"]: r for r in df.select("k", B.entry_type(F.col("raw")).alias("t"), B.entry_fields(F.col("raw")).alias("f")).collect()}
    assert [out[k]["t"] for k in range(5)] == ["book", "web", "standard", "thesis", "article"]
    assert out[0]["f"]["place"] == "Москва" and out[1]["f"]["access_date"] == "01.02.2020" and out[1]["f"]["language"] == "en" and "doi" not in out[0]["f"]
    c = corpus(spark, blocks=[par(1, "по ГОСТ 7.1 - 2003, ГОСТ 7.1–2003 и № 273-ФЗ"), par(2, "ГОСТ Р 1.5-2012")], entries=[{"doc_id": 1, "ordinal": 4, "entry_id": "r", "fields": {"raw": "ГОСТ Р 1.5 – 2012."}}])
    assert [(r["source"], r["ordinal"]) for r in B.missing_sources(c).orderBy("ordinal").collect()] == [("273-ФЗ", 5), ("ГОСТ 7.1-2003", 6)]
    links = spark.createDataFrame([("Site (https://a.b/c). doi: 10.1000/xyz123.",)], "raw string").select(B.entry_fields(F.col("raw")).alias("f")).first()["f"]
    assert (links["url"], links["doi"]) == ("https://a.b/c", "10.1000/xyz123") and "year" not in links


def test_markdown_and_html(spark):
    text = "# A\n\none\ntwo\n\n### B\n- x\n- y\n1. z\n\n## C\n![cap](f.png)\n$$x$$\n<b>&"
    c = from_markdown(spark, spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    secs = {r["sec_id"]: (r["parent_id"], r["level"]) for r in c.secs.collect()}
    assert secs == {"h0": (None, 1), "h5": ("h0", 2), "h10": ("h0", 2)}
    kinds = sorted((r["block_ord"], r["block_type"], r["container_id"]) for r in c.blocks.collect())
    assert kinds == [(2, "paragraph", "h0"), (6, "list", "h5"), (8, "list", "h5"), (11, "figure", "h10"), (12, "formula", "h10"), (13, "paragraph", "h10")]
    lines = [r["line"] for r in to_markdown(c).orderBy("line_no").collect()]
    assert lines == ["# A", "one two", "## B", "- x", "- y", "1. z", "## C", "![cap]()", "$$x$$", "<b>&"]
    assert "&lt;b&gt;&amp;" in to_html(c).first()["html"]


def test_streams(spark, tmp_path):
    c = corpus(spark, blocks=[par(1, "a  b", line_spacing=1.0), par(2, "c")])
    c.blocks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.blocks.schema).parquet(str(tmp_path / "in"))
    q = check_stream(stream, ["T.03", "T.08", "none"]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["check_code"] for r in spark.sql("select * from found").collect()} == {"T.03", "T.08"}
    s = spark.createDataFrame([(1, "p", "2024-01-02 00:00:00", 3), (1, "p", "2024-01-02 00:00:00", 3), (2, "p", "2024-01-03 00:00:00", None)], "id long, profile_id string, created_at string, error_count int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [(r["submissions"], r["errors"]) for r in submissions_per_window(s).collect()] == [(2, 3)]


def test_states_keep_cells_references_and_dpi(spark):
    table = {"kind": "table", "caption": "T", "headers": ["a", ""], "rows": [["1", " "], ["", "2"]]}
    blank = {"kind": "table", "caption": "T", "headers": [], "rows": [[" "]]}
    figure = {"kind": "figure", "caption": "F", "meta": {"dpi": 79, "runs": [{"kind": "text", "text": "n"}]}}
    runs = [{"kind": "citation", "source_id": "ref-2"}, {"kind": "citation", "source_id": "ref-9"}, {"kind": "xref", "target_id": "sec-7"}, {"kind": "formula", "latex": "x^2"}]
    inner = {"id": "sec-7", "heading": "B", "is_bibliography": True, "references": ["Smith, J. K. Site. 2021. https://a.b/c", " ", "short"]}
    state = {"title": "t", "sections": [{"heading": "A", "blocks": [table, blank, figure, {"kind": "formula", "latex": "y", "numbered": True}, {"kind": "formula", "latex": "z", "numbered": False}, {"kind": "paragraph", "runs": runs}], "subsections": [inner]}]}
    c = from_states(spark, spark.createDataFrame([(1, 1, json.dumps(state)), (2, 1, None)], "state_id long, saved_at int, payload string"))
    assert [(r["ordinal"], r["entry_id"], r["entry_type"], r["fields"].get("year")) for r in c.entries.orderBy("ordinal").collect()] == [(1, "ref-1", "web", "2021"), (2, "ref-2", "book", None)]
    b = {r["block_id"]: r for r in c.blocks.collect()}
    assert [[x["text"] for x in row] for row in b["s0/b0"]["headers"] + b["s0/b0"]["rows"]] == [["a", ""], ["1", " "], ["", "2"]]
    assert b["s0/b2"]["dpi"] == 79 and (b["s0/b3"]["number"], b["s0/b4"]["number"]) == ("1", None) and b["s0/b5"]["runs"][3]["text"] == "x^2"
    v = {(r["check_code"], r["location"], r["detail"]) for r in validate(c, codes=["B.07", "B.10", "I.08", "R.05", "R.04", "C.06", "M.01"]).collect()}
    assert v >= {("B.07", "table[s0/b0]", "0,1"), ("B.10", "table[s0/b1]", ""), ("I.08", "figure[s0/b2]", "79"), ("R.05", "bibliography[ref-1]", "1"), ("R.04", "bibliography[ref-2]", "length"), ("M.01", "formula[s0/b4]", "")}
    assert [x for x in v if x[0] in ("C.06", "M.01")] and {x[2] for x in v if x[0] == "C.06"} == {"citation ref-9"} and not [x for x in v if x[:2] == ("R.05", "bibliography[ref-2]")]


def test_reports_cover_rules_and_fixers_beyond_layout(spark, monkeypatch):
    from folioscope.operators import engine
    from folioscope.plans import reports
    from test_fixers import sample

    c = corpus(spark, docs=(1, 2), blocks=[par(1, "a", line_spacing=1.0)], entries=[{"doc_id": 2, "ordinal": 1, "entry_id": "r", "fields": {"raw": "x"}}])
    from folioscope.plans import rules as rule_plans

    monkeypatch.setattr(rule_plans, "from_tables", lambda spark, d: c)
    monkeypatch.setattr(engine, "RULES", {k: engine.RULES[k] for k in ("T.03", "R.04", "R.05", "R.11")})
    pivot = {r["doc_id"]: (r["errors"], r["warnings"]) for r in reports.severity_pivot_all(spark, "").collect()}
    assert pivot == {1: (1, 1), 2: (1, 2)}
    assert {r["category"] for r in reports.category_rollup_all(spark, "").collect()} == {"R", "T", None}
    assert [r["check_code"] for r in reports.top_codes_all(spark, "").collect()] == ["R.11", "R.04", "R.05", "T.03"]
    monkeypatch.setattr(reports, "from_tables", lambda spark, d: sample(spark))
    log = {r["fixer_code"] for r in reports.fix_log(spark, "").collect()}
    assert log >= {"T.01", "T.02", "T.07", "H.04", "F.01", "L.04"}


def test_exports_keep_every_block_inline_element_and_entry(spark):
    cell = lambda *texts: [(t, None) for t in texts]
    blocks = [
        par(1, "a<", run("b", bold=True), run(None, "citation", source_id="ref-2", pages="5"), run(None, "xref", prefix="см. ", target_id="t-1"), run("x^2", "formula")),
        obj("table", 2, "Cap", headers=[cell("h", "i")], rows=[cell("1|2", "<")]), obj("figure", 3, "Fig"), obj("formula", 4, None, latex="y<1"),
        obj("list", 5, None, ordered=True, items=["p", "q"]), obj("toc", 6, "Toc"),
    ]
    entries = [{"doc_id": 1, "ordinal": k, "entry_id": f"ref-{k}", "fields": {"raw": f"E & {k}"}} for k in (2, 1)]
    c = corpus(spark, secs=[sec(1, "A"), sec(2, "Список литературы"), sec(3, "Z")], blocks=blocks, entries=entries)
    lines = [r["line"] for r in to_markdown(c).orderBy("line_no").collect()]
    assert lines == ["# A", "a<**b**[ref-2, с. 5]см. [→t-1]$x^2$", "**Cap**", "", "| h | i |", "|---|---|", "| 1\\|2 | < |", "![Fig]()", "$$y<1$$", "1. p", "2. q", "Toc", "# Список литературы", "1. E & 1", "2. E & 2", "# Z"]
    assert to_html(c).first()["html"].split("\n") == [
        "<h1>A</h1>", "<p>a&lt;<strong>b</strong>[ref-2, с. 5]см. [→t-1]\\(x^2\\)</p>",
        "<table><caption>Cap</caption><thead><tr><th>h</th><th>i</th></tr></thead><tbody><tr><td>1|2</td><td>&lt;</td></tr></tbody></table>",
        "<figure><figcaption>Fig</figcaption></figure>", '<div class="formula">$$ y&lt;1 $$</div>', "<ol><li>p</li><li>q</li></ol>", '<nav class="toc">Toc</nav>',
        "<h1>Список литературы</h1>", '<ol class="bibliography">', "<li>E &amp; 1</li>", "<li>E &amp; 2</li>", "</ol>", "<h1>Z</h1>",
    ]


def test_inheritance_over_long_chains(spark):
    rows = [("p0", None, "N")] + [(f"p{k}", f"p{k - 1}", None) for k in range(1, 70)]
    got = R.inherited(spark.createDataFrame(rows, "id string, up string, name string"), "id", "up", ["name"]).collect()
    assert len(got) == 70 and {r["name"] for r in got} == {"N"}
