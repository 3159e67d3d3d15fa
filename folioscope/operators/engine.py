"""The rule engine: a registry, one scan per relation for the row-local rules, suppression by section."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize
from folioscope.sources.corpus import Corpus

VIOLATION = "check_code string, severity string, location string, detail string"
COLUMNS = ["doc_id", "check_code", "severity", "location", "detail", "sec"]
_ITEM = "array<struct<severity:string,location:string,detail:string>>"


@dataclass(frozen=True)
class Rule:
    """*local* gives a column of findings from one row of *relation*; *whole* gives a frame from the corpus."""

    code: str
    relation: str = ""
    local: Callable[[dict], Column] | None = None
    whole: Callable[[Corpus, dict], DataFrame] | None = None


@dataclass
class Profile:
    """Which checks run, with which parameters; severities may be overridden."""

    name: str = "base"
    disabled: set[str] = field(default_factory=set)
    params: dict[str, dict] = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)

    def of(self, code: str) -> dict:
        return self.params.get(code, {})


RULES: dict[str, Rule] = {}
#: Registered codes that find nothing by design; they cost a run of several rules nothing.
EMPTY: set[str] = set()


def register(rule: Rule) -> Rule:
    """Add a rule; a code can be taken once only."""
    if rule.code in RULES:
        raise ValueError(f"{rule.code} is registered already")
    RULES[rule.code] = rule
    return rule


def local(code: str, relation: str):  # noqa: ANN201
    """Register a row-local rule: a function from parameters to a column of findings."""
    return lambda fn: register(Rule(code, relation, local=fn)) and fn


def whole(code: str):  # noqa: ANN201
    """Register a rule over the corpus: a function from corpus and parameters to doc_id, severity, location, detail[, sec]."""
    return lambda fn: register(Rule(code, whole=fn)) and fn


def rule_sql(code: str, relation: str, predicate: str, severity: str = "warning", location: str = "''", detail: str = "''") -> Rule:
    """Register a rule given as SQL expressions on one relation."""
    return register(Rule(code, relation, local=lambda p: one(F.expr(predicate), severity, F.expr(location), F.expr(detail))))


def rule_per_document(code: str, relation: str, fn: Callable, severity: str = "warning") -> Rule:  # noqa: ANN001
    """Register a rule given as a function from a document's rows (pandas) to rows of location and detail.

    One document is one group, so the function sees a document whole and never a larger share of the corpus.
    """

    def run(c: Corpus, p: dict) -> DataFrame:
        def per(pdf):  # noqa: ANN001, ANN202
            out = fn(pdf, p)
            out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
            return out[["doc_id", "location", "detail"]]

        rows = c.relation(relation)
        kind = rows.schema["doc_id"].dataType.simpleString()
        found = rows.groupBy("doc_id").applyInPandas(per, f"doc_id {kind}, location string, detail string")
        return found.withColumn("severity", F.lit(severity))

    return register(Rule(code, whole=run))


def one(cond: Column, severity: Column | str, location: Column | str, detail: Column | str = "") -> Column:
    """A finding where *cond* holds (null does not)."""
    s, l, d = (F.lit(x) if isinstance(x, str) else x for x in (severity, location, detail))
    item = F.array(F.struct(s.alias("severity"), l.alias("location"), d.cast("string").alias("detail")))
    return F.when(cond, item.cast(_ITEM)).otherwise(F.array().cast(_ITEM))


def many(details: Column, severity: str, location: Column) -> Column:
    """A finding for each detail of an array."""
    found = F.transform(details, lambda d: F.struct(F.lit(severity).alias("severity"), location.alias("location"), d.cast("string").alias("detail")))
    return F.coalesce(found.cast(_ITEM), F.array().cast(_ITEM))


def located(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}["), F.col(key) if isinstance(key, str) else key, F.lit("]"))


def runnable(profile: Profile) -> list[str]:
    """Codes that are registered and enabled, sorted."""
    return sorted(c for c in RULES if c not in profile.disabled)


def validate(c: Corpus, profile: Profile | None = None, codes: list[str] | None = None, suppress: bool = True) -> DataFrame:
    """(doc_id, check_code, severity, location, detail): every violation of every document.

    All row-local rules of a relation share one scan of it; the other rules add a frame each. *codes* narrows the
    run to the rules named, else the profile decides; a code nobody registered is skipped. Violations inside a
    section that disables the check, or all checks ("*"), itself or in a section above it, are left out.
    """
    profile = profile or Profile()
    frames = [make() for make in _parts(c, profile, codes)]
    if not frames:
        return c.docs.sparkSession.createDataFrame([], f"doc_id {c.docs.schema['doc_id'].dataType.simpleString()}, {VIOLATION}")
    return _settled(reduce(DataFrame.unionByName, frames), c, profile, suppress)


def validate_in_parts(c: Corpus, profile: Profile | None = None, suppress: bool = True, at_once: int | None = None) -> DataFrame:
    """What validate finds with all enabled rules, each relation and each corpus rule as a job of its own, written once.

    *at_once* jobs are planned and run beside each other, which keeps plans small and the cluster busy; by default one for
    each quarter of a gigabyte of the driver's heap, at most eight. *c* should be written (Corpus.written), so that the
    parts share what is derived.
    """
    profile = profile or Profile()
    parts = _parts(c, profile, None)
    if not parts:
        return validate(c, profile, ["none"], suppress)
    if at_once is None:
        heap = c.docs.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()  # noqa: SLF001
        at_once = max(1, min(8, heap >> 28))
    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(lambda make: materialize(make(), "found"), parts))
    return _settled(reduce(DataFrame.unionByName, found), c, profile, suppress)


def validate_iter(c: Corpus, profile: Profile | None = None) -> Iterator[tuple[list[str], DataFrame]]:
    """The codes and the findings of one part of the rules after the other, each written as it is reached, to report progress.

    What sections disable is left out; together the parts are what validate finds.
    """
    profile = profile or Profile()
    for make in _parts(c, profile, None):
        codes = [r.code for r in make.args[2]] if make.func is _scan_of else [make.args[1].code]
        yield codes, _settled(materialize(make(), "found"), c, profile, suppress=True)


def _parts(c: Corpus, profile: Profile, codes: list[str] | None) -> list[Callable[[], DataFrame]]:
    """What makes the findings (COLUMNS) of each relation's local rules and of each corpus rule."""
    codes = [x for x in (codes or runnable(profile)) if x in RULES]
    by: dict[str, list[Rule]] = {}
    parts: list[Callable[[], DataFrame]] = []
    for r in (RULES[x] for x in codes if x not in EMPTY or len(codes) == 1):
        if r.local:
            by.setdefault(r.relation, []).append(r)
        else:
            parts.append(partial(_whole, c, r, profile))
    return [*(partial(_scan_of, c, name, rules, profile) for name, rules in by.items()), *parts]


def _scan_of(c: Corpus, name: str, rules: list[Rule], profile: Profile) -> DataFrame:
    return _scan(c.relation(name), rules, profile)


def _whole(c: Corpus, r: Rule, profile: Profile) -> DataFrame:
    f = r.whole(c, profile.of(r.code)).withColumns({"check_code": F.lit(r.code), "detail": F.col("detail").cast("string")})
    return (f if "sec" in f.columns else f.withColumn("sec", F.lit(None).cast("string"))).select(*COLUMNS)


def _settled(found: DataFrame, c: Corpus, profile: Profile, suppress: bool) -> DataFrame:
    """Severities as the profile wants them, without what sections disable."""
    if profile.severity:
        names = F.create_map(*[F.lit(x) for kv in profile.severity.items() for x in kv])
        found = found.withColumn("severity", F.coalesce(names[F.col("check_code")], "severity"))
    if suppress:
        found = suppressed(found, c.relation("heads"))
    return found.drop("sec")


def _coded(items: Column, code: str) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(code).alias("check_code"), x["severity"].alias("severity"), x["location"].alias("location"), x["detail"].alias("detail")))


_FINDINGS: dict[tuple, Column] = {}


def _findings(r: Rule, p: dict) -> Column:
    """The column of findings of a row-local rule; it depends on rule and parameters only and is built once."""
    key = (id(SparkContext._gateway), r, repr(sorted(p.items())))  # noqa: SLF001
    if key not in _FINDINGS:
        _FINDINGS[key] = _coded(r.local(p), r.code)
    return _FINDINGS[key]


def _scan(df: DataFrame, rules: list[Rule], profile: Profile) -> DataFrame:
    sec = next((x for x in ("sec", "container_id", "sec_id") if x in df.columns), None)  # the section a row lies in
    parts = [_findings(r, profile.of(r.code)) for r in rules]
    found = F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]
    where = F.col(sec) if sec else F.lit(None).cast("string")
    return df.select("doc_id", where.alias("sec"), F.inline(found)).select(*COLUMNS)


def suppressed(found: DataFrame, heads: DataFrame) -> DataFrame:
    """*found* without what a section disables; both joins are on keys, whatever the number of sections."""
    off = heads.where(F.size("disabled_checks") > 0).select("doc_id", F.col("sec_id").alias("up"), F.explode("disabled_checks").alias("code"))
    inside = heads.select("doc_id", "sec_id", F.explode(F.array_union(F.coalesce("path", F.array().cast("array<string>")), F.array("sec_id"))).alias("up"))
    quiet = inside.join(off, ["doc_id", "up"]).select("doc_id", F.col("sec_id").alias("sec"), "code").distinct()
    every = quiet.where("code = '*'").select("doc_id", "sec").distinct()
    left = found.join(every, ["doc_id", "sec"], "left_anti")
    return left.join(quiet.withColumnRenamed("code", "check_code"), ["doc_id", "sec", "check_code"], "left_anti").select(*COLUMNS)
