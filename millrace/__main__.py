"""Command line: list or run queries, validate records, inspect a run's outputs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from millrace.operators import evaluation, records
from millrace.plans import registry
from millrace.session import session
from millrace.sources import files

RECORD = "id string, messages array<struct<role:string,content:string>>, metadata struct<mode:string,domain:string,structure:string,difficulty:string,data_interface:string,answer_style:string>"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the core queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="Parquet table to write; else rows are shown")
    check = sub.add_parser("validate", help="check JSON lines of chat records")
    check.add_argument("path")
    look = sub.add_parser("inspect", help="rows of each JSON-lines output of a run")
    look.add_argument("folder")
    look.add_argument("outputs", nargs="+")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = session()
    if a.command == "run":
        if a.query not in registry.QUERIES:
            print(f"no query {a.query}", file=sys.stderr)
            return 2
        df = registry.QUERIES[a.query](spark, a.folder)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=80)
        return 0
    if a.command == "inspect":
        evaluation.inspect_run({n: spark.read.text(f"{a.folder}/{n}") for n in a.outputs if files.exists(spark, f"{a.folder}/{n}")}).show(truncate=False)
        return 0
    rows = files.read_jsonl(spark, a.path, RECORD, strict=True)
    issues = rows.select(records.sft_issues(F.col("messages"), F.col("metadata")).alias("issues"))
    total = issues.agg(F.count("*").alias("rows"), F.count_if(F.size("issues") > 0).alias("rows_with_issues")).first()
    print(f"rows {total.rows}, with issues {total.rows_with_issues}")
    records.issue_counts(issues).orderBy(F.desc("n"), "issue").show(truncate=False)
    return 1 if total.rows_with_issues else 0


if __name__ == "__main__":
    sys.exit(main())
