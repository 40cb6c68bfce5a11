"""Policies: a YAML document of thresholds for namespaces; the first that matches a table holds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import DAY, THRESHOLDS
from .stats import MIB

_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def parse_duration(text: str) -> int:
    """Milliseconds of 30d, 12h, 1h30m and the like; days stand alone and are positive."""
    t = text.strip()
    if m := re.fullmatch(r"([1-9][0-9]*)d", t):
        return int(m[1]) * DAY
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", t)
    if t != "0" and (not parts or "".join(a + b for a, b in parts) != t.lstrip("+-")):
        raise ValueError(f"not a duration: {text!r}")
    return int(sum(float(n) * _UNITS[u] for n, u in parts)) * (-1 if t.startswith("-") else 1)


@dataclass
class Policy:
    name: str
    target_namespace: str = ""
    min_file_size_mb: int = 0
    max_manifest_files: int = 0
    max_snapshot_age: str = ""
    delete_file_ratio_warn: float = 0.0
    delete_file_ratio_fail: float = 0.0
    #: Read, but nothing in a score depends on it; min_health_score can be asked for as a gate.
    min_health_score: int = 0
    write_pattern: str = ""
    fail_on_orphans: bool = False
    fail_on_pii_untagged: bool = False
    pii_scan: bool = False

    def thresholds(self) -> dict[str, float]:
        """What the policy sets, by threshold; values of 0 set nothing."""
        out: dict[str, float] = {}
        if self.min_file_size_mb > 0:
            out["min_file_bytes"] = self.min_file_size_mb * MIB
        if self.max_manifest_files > 0:
            out |= {"manifests_warn": self.max_manifest_files, "manifests_crit": 2 * self.max_manifest_files}
        if self.max_snapshot_age and (age := parse_duration(self.max_snapshot_age)) > 0:
            out |= {"age_warn_ms": age, "age_crit_ms": 3 * age}
        if self.delete_file_ratio_warn > 0:
            out["delete_ratio_warn"] = self.delete_file_ratio_warn
        if self.delete_file_ratio_fail > 0:
            out["delete_ratio_crit"] = self.delete_file_ratio_fail
        return out


@dataclass
class Policies:
    version: str
    default_catalog: str = ""
    policies: list[Policy] = field(default_factory=list)


def parse(text: str) -> Policies:
    """A policy document; unknown fields pass, a version and a name for each policy are required."""
    import yaml

    doc = yaml.safe_load(text) or {}
    if not doc.get("version"):
        raise ValueError("a policy document needs a version")
    known = Policy.__dataclass_fields__
    policies = []
    for k, p in enumerate(doc.get("policies") or []):
        if not p.get("name"):
            raise ValueError(f"policy {k} needs a name")
        policies.append(Policy(**{a: b for a, b in p.items() if a in known and b is not None}))
    return Policies(str(doc["version"]), doc.get("default_catalog") or "", policies)


def matches(glob: Column, namespace: Column) -> Column:
    """An empty glob or * is any namespace, p.* is p and what is below it, another is itself."""
    stem = F.regexp_replace(glob, r"\.\*$", "")
    below = glob.endswith(".*") & ((namespace == stem) | namespace.startswith(F.concat(stem, F.lit("."))))
    return (glob == "") | (glob == "*") | below | (namespace == glob)


def _rule(rules: list[str]) -> Column:
    """The place of the first of the globs that matches column namespace, -1 for none: a CASE, so no join."""
    number: Column = F.lit(-1)
    for k, glob in reversed(list(enumerate(rules))):
        number = F.when(matches(F.lit(glob), F.col("namespace")), k).otherwise(number)
    return number


def first_match(tables: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """tables(table_id, namespace) with the name of the first of (name, glob) rules that matches, null for none."""
    names = F.array(*(F.lit(name) for name, _ in rules)).cast("array<string>")
    return tables.select("table_id", F.get(names, _rule([glob for _, glob in rules])).alias("policy"))


def apply(tables: DataFrame, doc: Policies | None) -> DataFrame:
    """tables(table_id, namespace, ...) with threshold columns and the policy's name, by a CASE over the document."""
    rules = doc.policies if doc else []
    number = _rule([p.target_namespace for p in rules])
    out = tables.withColumn("_rule", number)
    name: Column = F.lit(None).cast("string")
    values = {k: F.lit(v) for k, v in THRESHOLDS.items()}
    for k, p in enumerate(rules):
        name = F.when(F.col("_rule") == k, p.name).otherwise(name)
        for key, v in p.thresholds().items():
            values[key] = F.when(F.col("_rule") == k, F.lit(v)).otherwise(values[key])
    return out.withColumns(values | {"policy": name}).drop("_rule")
