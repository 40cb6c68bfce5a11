"""Reports as text, JSON, SARIF and payloads for a data catalog. Inputs are collected reports: a few rows per table."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime
from typing import Any

RULE = "  " + "─" * 65
FORMATS = {"": "text", "text": "text", "json": "json", "sarif": "sarif", "prometheus": "prometheus", "prom": "prometheus"}
LEVELS = {"CRITICAL": "error", "WARNING": "warning", "INFO": "note"}


def parse_format(text: str) -> str:
    try:
        return FORMATS[text.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown format {text!r}") from None


def human_bytes(n: int) -> str:
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        if n >= 1024**power:
            return f"{n / 1024**power:.2f} {unit}"
    return f"{n} B"


def duration(ms: int) -> str:
    h, rest = divmod(ms // 1000, 3600)
    m, s = divmod(rest, 60)
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"


def as_json(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n"


def health_text(r: dict) -> str:
    out = ["", f"  Table: {r['table_id']}  │  Score: {r['score']}/{r['max_score']}  {r['worst_severity']}", RULE]
    for d in r["dimensions"]:
        out.append(f"  {'[' + d['severity'] + ']':<12} {d['name']:<22} {d['score']:2d}/{d['max_score']:<2d}  {d['summary']}")
        if d["remediation"]:
            out.append(f"  {'':>12}   → {d['remediation']}")
    out += [RULE, f"  Catalog: {r['catalog']}  │  Snapshot: {r['snapshot_id']}  │  Format: v{r['format_version']}  │  Scan: {r['scan_ms']}ms", "", ""]
    return "\n".join(out)


def health_json(reports: Iterable[dict]) -> str:
    """One document per table, one after another."""
    return "".join(as_json(r) for r in reports)


def sarif(reports: Iterable[dict], version: str = "1") -> str:
    """One log: a result per dimension that is not OK, a rule per dimension."""
    reports = list(reports)
    names = list(dict.fromkeys(d["name"] for r in reports for d in r["dimensions"]))
    rules = [{"id": f"lakescope/{n}", "name": n, "shortDescription": {"text": f"Iceberg {n} health dimension"}, "defaultConfiguration": {"level": "warning"}} for n in names]
    results = [
        {
            "ruleId": f"lakescope/{d['name']}", "level": LEVELS[d["severity"]], "message": {"text": d["summary"] + (f" — {d['remediation']}" if d["remediation"] else "")},
            "locations": [{"logicalLocations": [{"name": r["table_id"], "kind": "iceberg-table"}]}],
            "properties": {"score": d["score"], "max_score": d["max_score"], "severity": d["severity"]},
        }
        for r in reports for d in r["dimensions"] if d["severity"] in LEVELS
    ]
    driver = {"name": "lakescope", "version": version, "rules": rules}
    log = {"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results, "invocations": [{"executionSuccessful": True}]}]}
    return as_json(log)


def health_payload(reports: Iterable[dict]) -> str:
    """For review in a data catalog: each table's score, failed dimensions and the tag to give it."""
    found = [
        {
            "table": r["table_id"], "health_score": r["score"], "max_score": r["max_score"], "worst_severity": r["worst_severity"],
            **({"write_pattern": r["write_pattern"]} if r.get("write_pattern") else {}),
            **({"failed_dimensions": failed} if (failed := [d["name"] for d in r["dimensions"] if d["severity"] in ("CRITICAL", "WARNING")]) else {}),
            "recommended_tag": f"HEALTH_{r['worst_severity']}",
        }
        for r in reports
    ]
    return as_json({"review_required": True, "findings": found})


def pii_payload(findings: list[dict]) -> str:
    return as_json({"review_required": True, "findings": findings})


def orphans_text(table: str, prefix: str, r: dict) -> str:
    out = ["", f"  [DRY RUN] Orphan File Report: {table}", RULE, f"  Scanned prefix:  {prefix}", f"  Snapshot:        {r['snapshot_id']} (locked)", f"  Grace period:    {duration(r['grace_ms'])}", f"  Active files:    {r['active_files']}"]
    out += [f"  Scanned objects: {r['scanned_objects']}", "", f"  Found {r['candidates']} orphan candidate(s)  │  Reclaimable: {human_bytes(r['total_bytes'])}"]
    if r["preview"]:
        out += ["", "  Preview:", *(f"    {c['uri']}  ({human_bytes(c['size_bytes'])})" for c in r["preview"])]
    return "\n".join([*out, "", ""])


def pii_text(table: str, files: int, findings: list[dict]) -> str:
    out = ["", f"  PII Scan Report: {table}", RULE, f"  Files sampled: {files}", f"  Findings:      {len(findings)} (review required — no auto-tagging)", ""]
    out += [f"    [{f['pii_type']}] column={f['column']}  confidence={f['confidence']:.2f}  samples={f['match_count']}/{f['sample_count']}  → {f['recommend_tag']}" for f in findings]
    return "\n".join([*out, "", ""])


def cost_text(table: str, provider: str, rate: float, points: list[dict]) -> str:
    out = ["", f"  Snapshot Cost Timeline: {table}", RULE, f"  Provider: {provider}   Rate: ${rate:.4f} / GB-month   (list-price estimate)", ""]
    if not points:
        return "\n".join([*out, "  No snapshot data.", ""])
    out.append(f"  {'snapshot':<20} {'ts':<12} {'GB':<12} {'$/mo':<12} tier?")
    for p in points:
        day = datetime.fromtimestamp(p["timestamp_ms"] / 1000, UTC).strftime("%Y-%m-%d")
        out.append(f"  {p['snapshot_id']:<20d} {day:<12} {p['cumulative_gb']:<12.2f} {p['monthly_usd']:<12.2f} {'cold' if p['tier_candidate'] else ''}")
    return "\n".join([*out, "", ""])


def migration_text(reports: Iterable[dict]) -> str:
    out: list[str] = []
    for r in reports:
        out += ["", f"  Migration Readiness: {r['table_id']}  │  Risk: {r['risk']}", RULE, f"  Format version:   v{r['format_version']}", f"  Manifest files:   {r['manifest_count']}", f"  Data files:       {r['data_file_count']}", f"  Total data:       {human_bytes(r['total_data_bytes'])}"]
        if not r["findings"]:
            out.append("  ✓ No migration blockers detected.")
            continue
        out.append("  Findings:")
        for f in r["findings"]:
            out.append(f"    [{f['severity']}] {f['code']}: {f['message']}")
            if f["remediation"]:
                out.append(f"          → {f['remediation']}")
    return "\n".join([*out, "", ""])


def diff_text(tag: str, d: dict) -> str:
    out = ["", f"  Benchmark: {d['table_id']}  │  {tag} → current", "  " + "─" * 68]
    for key, name in (("score", "Health Score:"), ("data_files", "Data Files:"), ("manifest_count", "Manifest Files:"), ("position_deletes", "Position Deletes:"), ("equality_deletes", "Equality Deletes:")):
        out.append(f"  {name:<20} {d[key + '_before']:12d}  →  {d[key + '_after']:<12d}  {d[key + '_change']}")
    out.append(f"  {'Avg File Size:':<20} {human_bytes(d['avg_file_bytes_before']):>12}  →  {human_bytes(d['avg_file_bytes_after']):<12}")
    return "\n".join([*out, "", ""])
