"""Command line: ``python -m saltmarsh check|redact|compare PATH ...`` (or by spark-submit)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from saltmarsh.operators import compare
from saltmarsh.operators.policy import parse_policy
from saltmarsh.operators.scan import ScanConfig, explode_findings, redact, scan
from saltmarsh.sources.files import exit_code, read_files, write_report, write_text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="saltmarsh")
    out.add_argument("mode", choices=("check", "redact", "compare"))
    out.add_argument("path", help="files to read: a path or glob")
    out.add_argument("--out", help="folder to write the report or the sanitized text to")
    out.add_argument("--profile", default="full", choices=("full", "common"))
    out.add_argument("--pii", action="append", default=[], help="selector, such as pii:us or pii:family:global:email")
    out.add_argument("--ruleset", help="file of a ruleset")
    out.add_argument("--action-policy", help="file of an action policy")
    out.add_argument("--compare-action-policy", action="append", default=[], help="up to three more policies")
    return out


def _text(path: str | None) -> str:
    if not path:
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(args: list[str]) -> int:
    options = parser().parse_args(args)
    spark = SparkSession.builder.appName("saltmarsh").getOrCreate()
    config = ScanConfig(profile=options.profile, pii=tuple(options.pii), ruleset=_text(options.ruleset))
    policy = parse_policy(_text(options.action_policy)) if options.action_policy else None
    files = read_files(spark, options.path)
    found = scan(files, config=config, policy=policy)
    found = found.withColumn("error", F.coalesce("error", F.when(F.col("read_error").isNotNull(), F.struct(F.col("read_error").alias("code"), F.col("read_error").alias("message")))))
    if options.mode == "compare":
        others = {f"candidate-{k + 1}": parse_policy(_text(p)) for k, p in enumerate(options.compare_action_policy)}
        compared = compare.compare_policies(explode_findings(found, "path"), {"base": policy} | others)
        for row in compare.action_counts(compared).orderBy("policy", "action").collect():
            print(row.policy, row.action, row.n)
        return 0
    if options.mode == "redact" and options.out:
        write_text(redact(found), options.out)
    elif options.out:
        write_report(found, options.out, "path")
    return exit_code(found)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
