"""Rule profiles from files: loading, inheritance by deep merge, comparison, and a registry of installed ones.

A profile is a small tree (YAML or JSON) with id, name, version, extends, styles and checks. It is read on the driver, as
it only decides which rules run and with which parameters; what is compared or listed comes out as rows.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.engine import RULES, Profile
from folioscope.session import exists, materialize

# Fields that name a profile and are never inherited.
OWN = ("id", "name", "version", "extends", "effective_from", "effective_until")
# Where styles of a profile give a rule its expectation, unless the rule has a parameter of its own.
STYLES = {
    "F.01": {"margins_mm": "page.margins_mm"}, "F.02": {"paper": "page.size"}, "F.07": {"style": "page.border.style", "size": "page.border.size_eighth_pt", "enabled": "page.border.enabled"},
    "F.08": {"enabled": "page.title_block.enabled"}, "T.01": {"font": "body.font"}, "T.02": {"body_size": "body.size_pt", "caption_size": "extra.caption_size_pt", "footnote_size": "extra.footnote_size_pt"},
    "T.03": {"line_spacing": "body.line_spacing"}, "T.04": {"first_line_indent_cm": "body.first_line_indent_cm"}, "T.05": {"alignment": "body.alignment"},
    "T.14": {"expected_before_pt": "body.space_before_pt", "expected_after_pt": "body.space_after_pt"},
    "H.01": {"font": "heading_1.font", "size_pt": "heading_1.size_pt", "bold": "heading_1.bold", "upper": "heading_1.uppercase"},
    "H.02": {"font": "heading_2.font", "size_pt": "heading_2.size_pt", "bold": "heading_2.bold", "upper": "heading_2.uppercase"},
    "I.03": {"format": "figure.caption.format"}, "I.11": {"format": "figure.caption.format"}, "I.09": {"alignment": "figure.alignment"},
    "B.03": {"format": "table.caption.format"}, "B.12": {"format": "table.caption.format"}, "B.06": {"cell_font_size_pt": "table.cell_size_pt"},
}
COMPARED = ["page.margins_mm", "body.font", "body.size_pt", "body.line_spacing", "body.first_line_indent_cm", "body.alignment"]


def deep_merge(parent: object, child: object) -> object:
    """*child* over *parent*: objects key by key, a list that is not empty as a whole, a value that is not None."""
    if isinstance(parent, dict) and isinstance(child, dict):
        return {k: deep_merge(parent[k], child[k]) if k in parent and k in child else (child if k in child else parent)[k] for k in (*parent, *(k for k in child if k not in parent))}
    if isinstance(parent, list) and isinstance(child, list):
        return child or parent
    return parent if child is None else child


def read_tree(text: str, name: str = "") -> dict:
    """A profile from YAML (where a reader for it is installed) or JSON; anything but an object with an id is an error."""
    try:
        tree = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{name}: not JSON, and no reader for YAML is installed") from None
        try:
            tree = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"{name}: {e}") from None
    if not isinstance(tree, dict) or not tree.get("id"):
        raise ValueError(f"{name}: a profile is an object with an id")
    checks = tree.get("checks") or {}
    if not isinstance(checks, dict) or not all(v is None or isinstance(v, dict) for v in checks.values()):
        raise ValueError(f"{name}: checks map codes to settings")
    return tree


def load_tree(profile_id: str, folders: list[str], installed: dict[str, str] | None = None) -> dict:
    """The profile of that id with all it inherits; *installed* texts by id go before files. A circle is an error."""
    chain: list[dict] = []
    at: str | None = profile_id
    while at:
        if any(t["id"] == at for t in chain):
            raise ValueError(f"{at} extends itself")
        text = (installed or {}).get(at)
        if text is None:
            found = [p for d in folders for p in (Path(d) / f"{at}.yaml", Path(d) / f"{at}.json") if p.is_file()]
            if not found:
                raise FileNotFoundError(f"no profile {at} in {folders}")
            text = found[0].read_text(encoding="utf-8")
        tree = read_tree(text, at)
        chain.append(tree | {"id": at})
        at = tree.get("extends")
    out = chain[-1]
    for child in chain[-2::-1]:
        out = deep_merge(out, child) | {k: child[k] for k in OWN if child.get(k) is not None}
        if "extends" not in child:
            out.pop("extends", None)
    return out


def _styled(tree: dict, path: str) -> object:
    at: object = tree.get("styles") or {}
    for step in path.split("."):
        at = at.get(step) if isinstance(at, dict) else None
    return at


def to_profile(tree: dict) -> Profile:
    """What the engine runs: registered codes the profile enables, with their parameters, styles and severities."""
    checks = {k: v or {} for k, v in (tree.get("checks") or {}).items()}
    on = {k for k, v in checks.items() if v.get("enabled", True)}
    params = {}
    for code in on:
        styles = {k: v for k, p in STYLES.get(code, {}).items() if (v := _styled(tree, p)) is not None}
        if own := styles | (checks[code].get("params") or {}):
            params[code] = own
    severity = {k: v["severity"] for k, v in checks.items() if v.get("severity")}
    return Profile(tree["id"], set(RULES) - on, params, severity)


def load_profile(profile_id: str, folders: list[str], installed: dict[str, str] | None = None) -> Profile:
    return to_profile(load_tree(profile_id, folders, installed))


def skipped_codes(tree: dict) -> list[str]:
    """Codes the profile enables that no rule is registered for."""
    return sorted(k for k, v in (tree.get("checks") or {}).items() if (v or {}).get("enabled", True) and k not in RULES)


def profile_diff(spark: SparkSession, a: dict, b: dict) -> DataFrame:
    """(kind, name, in_a, in_b): checks only one side enables, parameters of common checks, and styles that differ; values as JSON."""
    on = [{k: v or {} for k, v in (t.get("checks") or {}).items() if (v or {}).get("enabled", True)} for t in (a, b)]
    show = lambda v: None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True)
    rows = [("check", k, show(True if k in on[0] else None), show(True if k in on[1] else None)) for k in sorted(set(on[0]) ^ set(on[1]))]
    for k in sorted(set(on[0]) & set(on[1])):
        x, y = (t[k].get("params") or {} for t in on)
        if x != y:
            rows.append(("params", k, show(x), show(y)))
    rows += [("style", p, show(x), show(y)) for p in COMPARED for x, y in [(_styled(a, p), _styled(b, p))] if x != y]
    return spark.createDataFrame(rows, "kind string, name string, in_a string, in_b string")


_INSTALLED = "profile_id string, name string, version string, extends_id string, text string, installed_at timestamp"


def installed_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The registry below *path*, by id; empty where nothing was installed."""
    return (spark.read.schema(_INSTALLED).parquet(path) if exists(spark, path) else spark.createDataFrame([], _INSTALLED)).orderBy("profile_id")


def install_profile(spark: SparkSession, path: str, text: str) -> str:
    """Add a profile to the registry after checking it, in place of one of the same id; returns the id."""
    tree = read_tree(text)
    values = [tree["id"], tree.get("name"), str(tree.get("version", "1.0")), tree.get("extends"), text]
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(n) for n, v in zip(("profile_id", "name", "version", "extends_id", "text"), values)], F.current_timestamp().alias("installed_at"))
    kept = materialize(installed_profiles(spark, path).where(F.col("profile_id") != tree["id"]).unionByName(row), "profiles")
    kept.coalesce(1).write.mode("overwrite").parquet(path)  # a registry of a few texts
    return tree["id"]


def uninstall_profile(spark: SparkSession, path: str, profile_id: str) -> bool:
    """Take a profile out of the registry; false when it was not there."""
    have = installed_profiles(spark, path)
    if have.where(F.col("profile_id") == profile_id).isEmpty():
        return False
    materialize(have.where(F.col("profile_id") != profile_id), "profiles").coalesce(1).write.mode("overwrite").parquet(path)
    return True


def installed_texts(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["profile_id"]: r["text"] for r in installed_profiles(spark, path).collect()}
