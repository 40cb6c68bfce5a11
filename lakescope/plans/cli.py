"""The command line: audit, orphans, pii, bench, migration, cost, export, version."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.cost import Rates
from ..operators.policy import parse, parse_duration
from ..sources.catalogs import Catalog, catalog
from ..sources.stores import Stores
from . import audit, exits, metrics, render

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    for name in ("--catalog-root", "--glue-catalog", "--rest", "--rest-prefix", "--rest-token", "--oauth-url", "--oauth-client", "--oauth-secret", "--table", "--webhdfs-url", "--webhdfs-user", "--s3-endpoint", "--s3-region"):
        shared.add_argument(name, default="")
    shared.add_argument("--catalog", default="localfs")
    top = argparse.ArgumentParser(prog="lakescope", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **flags):
        c = commands.add_parser(name, parents=[shared])
        for flag, default in flags.items():
            c.add_argument("--" + flag.replace("_", "-"), default=default, type=type(default))
        return c

    command("audit", namespace="", branch="", policy="", format="text", fail_on="critical", push_gateway="", push_job="lakescope", push_instance="", atlas_output="", min_health_score=0)
    command("orphans", data_prefix="", grace_period="24h", format="text", preview=25).add_argument("--confirm", action="store_true")
    command("pii", row_group_fraction=0.05, rows_per_group=1024, min_confidence=0.5, max_files=16, format="text", atlas_output="")
    bench = commands.add_parser("bench").add_subparsers(dest="step", required=True)
    for step in ("start", "compare"):
        c = bench.add_parser(step, parents=[shared])
        c.add_argument("--tag", default="default")
        c.add_argument("--bench-dir", default=".lakescope/bench")
    command("migration", namespace="", format="text")
    command("cost", rate=0.0, provider="s3-standard", cold_tier_days=90, format="text")
    command("export", namespace="", branch="", policy="", listen=":9400", interval="5m")
    commands.add_parser("version")
    return top


def host_port(text: str) -> tuple[str, int]:
    host, mark, port = text.rpartition(":")
    if not mark or not port.isdigit():
        raise exits.Coded(exits.CONFIG, f"host:port expected, not {text!r}")
    return host, int(port)


def catalog_of(a: argparse.Namespace, spark: SparkSession) -> Catalog:
    oauth = (a.oauth_url, a.oauth_client, a.oauth_secret) if a.oauth_url else None
    try:
        return catalog(a.catalog, spark, root=a.catalog_root, catalog_id=a.glue_catalog, url=a.rest, prefix=a.rest_prefix, token=a.rest_token, oauth=oauth)
    except (ValueError, ImportError) as e:
        raise exits.Coded(exits.CONFIG if isinstance(e, ValueError) and "unknown" not in str(e) else exits.CONNECTION, str(e)) from e


def written(path: str, text: str, out) -> None:
    if path == "-":
        out.write(text)
    elif path:
        Path(path).write_text(text)


def run_audit(a, spark: SparkSession, out) -> int:
    kind = render.parse_format(a.format)
    cat = catalog_of(a, spark)
    doc = parse(Path(a.policy).read_text()) if a.policy else None
    if not a.table and not cat.tables(a.namespace):
        out.write("no tables matched\n")
        return exits.OK
    frame = audit.audit(spark, cat, a.table, a.namespace, branch=a.branch or None, doc=doc).orderBy("table_id").cache()
    rows = [r.asDict(recursive=True) for r in frame.toLocalIterator()]
    if kind == "text":
        out.write("".join(map(render.health_text, rows)))
    elif kind == "json":
        out.write(render.health_json(rows))
    elif kind == "sarif":
        out.write(render.sarif(rows, VERSION))
    else:
        out.write(metrics.exposition(frame))
    written(a.atlas_output, render.health_payload(rows), out)
    if a.push_gateway:
        metrics.push(a.push_gateway, a.push_job, metrics.exposition(frame), a.push_instance)
    worst = max((exits.exit_from(r["worst_severity"], a.fail_on) for r in rows), default=exits.OK)
    low = a.min_health_score and any(r["score"] < a.min_health_score for r in rows)
    return max(worst, exits.CRITICAL if low else exits.OK)


def run_orphans(a, spark: SparkSession, out) -> int:
    if a.confirm:
        print("--confirm has no effect: nothing is ever deleted", file=sys.stderr)
    r = audit.orphans(spark, catalog_of(a, spark), a.table, a.data_prefix, parse_duration(a.grace_period), a.preview)
    out.write(render.as_json(r) if a.format == "json" else render.orphans_text(a.table, r["prefix"], r))
    return exits.OK


def run_pii(a, spark: SparkSession, out) -> int:
    files, found = audit.pii(spark, catalog_of(a, spark), a.table, a.row_group_fraction, a.rows_per_group, a.min_confidence, a.max_files)
    out.write({"json": render.as_json(found), "atlas": render.pii_payload(found)}.get(a.format) or render.pii_text(a.table, files, found))
    written(a.atlas_output, render.pii_payload(found), out)
    return exits.PII if found else exits.OK


def run_bench(a, spark: SparkSession, out) -> int:
    cat = catalog_of(a, spark)
    if a.step == "start":
        out.write(f"kept {audit.bench_start(spark, cat, a.table, a.tag, a.bench_dir)}\n")
    else:
        out.write(render.diff_text(a.tag, audit.bench_compare(spark, cat, a.table, a.tag, a.bench_dir)))
    return exits.OK


def run_migration(a, spark: SparkSession, out) -> int:
    rows = [{**r.asDict(recursive=True), "findings": [f.asDict() for f in r["findings"] or []]} for r in audit.migration(spark, catalog_of(a, spark), a.table, a.namespace).orderBy("table_id").toLocalIterator()]
    out.write(render.as_json(rows) if a.format == "json" else render.migration_text(rows))
    return max(({"HIGH": exits.CRITICAL, "MEDIUM": exits.WARNING}.get(r["risk"], exits.OK) for r in rows), default=exits.OK)


def run_cost(a, spark: SparkSession, out) -> int:
    rates = Rates(a.provider, a.rate)
    points = [r.asDict() for r in audit.cost(spark, catalog_of(a, spark), a.table, rates, a.cold_tier_days).toLocalIterator()]
    if a.format == "json":
        out.write(render.as_json({"table": a.table, "provider": rates.name, "rate_usd_gb_mo": rates.rate(), "timeline": points}))
    else:
        out.write(render.cost_text(a.table, rates.name, rates.rate(), points))
    return exits.OK


def run_export(a, spark: SparkSession, out) -> int:
    from ..streaming import monitor

    doc = parse(Path(a.policy).read_text()) if a.policy else None
    cat = catalog_of(a, spark)
    state = monitor.State()
    server = monitor.serve(state, *host_port(a.listen))
    out.write(f"listening on {a.listen} (interval {a.interval})\n")
    kept: list[DataFrame] = []

    def scan() -> DataFrame:
        audit.release(kept)
        return audit.audit(spark, cat, a.table, a.namespace, kept=kept, branch=a.branch or None, doc=doc)

    query = monitor.watch(spark, scan, state, parse_duration(a.interval))
    try:
        query.awaitTermination()
    finally:
        server.shutdown()
    return exits.OK


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        out.write(f"lakescope {VERSION}\n")
        return exits.OK
    try:
        if a.command in ("orphans", "pii", "bench", "cost") and not a.table:
            raise exits.Coded(exits.CONFIG, "--table is required")
        session = spark or SparkSession.builder.appName("lakescope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        Stores(a.webhdfs_url, a.webhdfs_user, a.s3_endpoint, a.s3_region).set(session)
        return globals()[f"run_{a.command}"](a, session, out)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return exits.code_of(e)
