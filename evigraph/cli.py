"""Commands: validate-config, probe, ingest, report, serve."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import reports
from .operators.frontier import listings
from .operators.store import Snapshots
from .plans.ingest import ingest
from .sources.config import Settings, described, load_config, load_vocabulary
from .sources.pages import normalize


def probe(spark: SparkSession, fetched, config, folder: str) -> tuple[dict, int]:  # type: ignore[no-untyped-def]
    """Seeds are normalised, items and a report written, nothing is stored; code 3 if a source has no item."""
    profiles = spark.createDataFrame([(p.name, p.adapter, p.body_selector, list(p.exclude_selectors)) for p in config.sources], "source_name string, adapter string, body_selector string, exclude_selectors array<string>")
    rows = fetched.drop("adapter", "body_selector", "exclude_selectors", "is_listing").where("depth = 0").withColumn("page_id", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(profiles), "source_name").withColumn("source", F.col("source_name"))
    rows = listings(rows, config.frame(spark), "final_url")
    items = normalize(rows, "page_id", config.crawl.max_comments_per_thread, config.crawl.max_body_characters).join(rows.select("page_id", "source_name"), "page_id")
    items.write.mode("overwrite").json(f"{folder}/items")
    got = {r.source_name: r.n for r in spark.read.schema(items.schema).json(f"{folder}/items").where("reason IS NULL").groupBy("source_name").agg(F.count("*").alias("n")).collect()}
    missing = [p.name for p in config.sources if not got.get(p.name)]
    report = {"kind": "probe", "items": got, "missing_sources": missing, "exit_code": 3 if missing else 0}
    reports.write_report(spark, report, folder)
    return report, report["exit_code"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evigraph")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate-config", "probe", "ingest", "serve"):
        c = commands.add_parser(name)
        c.add_argument("--config", type=Path)
        if name in ("probe", "ingest"):
            c.add_argument("--pages", required=True, help="Parquet table of fetched pages")
        if name == "serve":
            c.add_argument("--port", type=int, default=8000)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        settings = Settings.from_env()
        path = args.config or Path(settings.config_path)
        config = load_config(path)
        vocabulary = load_vocabulary(config, path)
        if args.command == "validate-config":
            print(json.dumps(described(config, vocabulary)))
            return 0
        spark = spark or SparkSession.builder.appName("evigraph").getOrCreate()
        store = Snapshots(spark, settings.store_path)
        if args.command == "serve":
            from .api import Service, serve

            serve(Service(store, settings.growth_min_delta, settings.growth_min_ratio), port=args.port).serve_forever()
            return 0
        fetched = spark.read.parquet(args.pages)
        if args.command == "probe":
            report, code = probe(spark, fetched, config, settings.report_dir)
        else:
            run = 1 + (store.read("crawl_runs").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if "crawl_runs" in store.tables() else 0)
            report = ingest(spark, fetched, config, vocabulary, store, run, datetime.now(UTC))
            reports.write_report(spark, report, settings.report_dir)
            code = report["exit_code"]
        print(json.dumps({k: report[k] for k in report if k not in ("sources", "graph")}, default=str))
        return code
    except (OSError, ValueError) as e:
        print(f"Configuration/setup error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        print("Interrupted; published snapshots remain.", file=sys.stderr)
        return 130


if __name__ == "__main__":
    raise SystemExit(main())
