"""python -m citeproof audit PATH | verify TEXT"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from citeproof.app import audit_path, verify_text
from citeproof.operators import report as P
from citeproof.operators.cache import Table
from citeproof.sources.connectors import Connection


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **net) -> int:
    """0; 1 if a citation is in danger; 2 if nothing could be read."""
    parser = argparse.ArgumentParser(prog="citeproof")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("audit", help="audit a manuscript, a folder of them, or an arXiv target")
    one.add_argument("path")
    one.add_argument("--output", "-o", help="folder for the reports")
    one.add_argument("--html", action="store_true", help="HTML instead of Markdown")
    one.add_argument("--refs-dir", "-r", help="folder of reference papers")
    two = commands.add_parser("verify", help="verify a title, a citation or a DOI")
    two.add_argument("text")
    for each in (one, two):
        each.add_argument("--email", "-e", help="mailbox for the providers")
        each.add_argument("--cache", help="folder of the cache table")
        each.add_argument("--retractions", help="table of retractions")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("citeproof").getOrCreate()
    net = Connection(mailto=given.email, cache=Table(spark, given.cache) if given.cache else None, **net)
    if given.command == "verify":
        row = verify_text(spark, given.text, net, given.retractions).first()
        for name, value in row.asDict().items():
            print(f"{name}: {value}")
        return 1 if row.is_retracted else 0
    done = audit_path(spark, given.path, given.refs_dir, net, given.retractions)
    for row in done.errors.orderBy("doc_id", "status").toLocalIterator():
        print(f"[{row.status}] {row.doc_id}: {row.error}", file=sys.stderr)
    for row in P.terminal(done.results).toLocalIterator():
        print(" | ".join(str(x) for x in row))
    total = done.summary.selectExpr("count(*) as files", "coalesce(sum(total), 0) as n", "coalesce(sum(passed), 0) as passed", "coalesce(sum(warning), 0) as warning", "coalesce(sum(danger), 0) as danger").first()
    print(f"{total.n} citations in {total.files} manuscripts: {total.passed} passed, {total.warning} warnings, {total.danger} in danger")
    if given.output and total.n:
        done.write(given.output, ".html" if given.html else ".md")
    return 2 if not total.files else 1 if total.danger else 0


if __name__ == "__main__":
    sys.exit(main())
