"""Command line: run, plan or check a job over stored pages.

    python -m weftline run JOB.json --pages PAGES.parquet --output OUT --format jsonl
    python -m weftline plan JOB.json
    python -m weftline validate JOB.json
"""

from __future__ import annotations

import argparse
import json
import sys

from weftline.plans import job


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 if all went well."""
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "plan", "validate"):
        s = sub.add_parser(name)
        s.add_argument("job")
        if name == "run":
            s.add_argument("--pages", required=True, help="Parquet table of url, status_code, body")
            s.add_argument("--output", required=True)
            s.add_argument("--format")
    a = p.parse_args(argv)
    try:
        config = job.load(a.job)
    except job.ConfigError as e:
        print(json.dumps({"ok": False, "issues": [{"path": x, "message": m} for x, m in e.issues]}, indent=2))
        return 1
    if a.command == "validate":
        print(json.dumps({"ok": True}))
        return 0
    from pyspark.sql import SparkSession

    from weftline.plans import engine
    from weftline.sinks import export

    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if a.command == "plan":
        print(json.dumps({"ok": True, "plan": engine.explain(spark, config)}, indent=2))
        return 0
    result = engine.run(spark, config, spark.read.parquet(a.pages))
    print(json.dumps({"ok": True, "export": export.export(result.records, a.output, a.format, {"job": config["id"]})}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
