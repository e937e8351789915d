"""Command line: ``python -m stratalog report CORPUS`` and ``python -m stratalog explain CORPUS RUN_ID``.

Exit codes: 0 done, 2 wrong usage or no such run, 3 unreadable input.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalog")
    verbs = top.add_subparsers(dest="verb", required=True)
    r = verbs.add_parser("report", help="rank the causes of failures")
    r.add_argument("corpus")
    r.add_argument("--top", type=int, default=10)
    r.add_argument("--since", type=int, metavar="DAYS")
    r.add_argument("--json", type=Path, help="write JSON to this file (- for standard output)")
    r.add_argument("--html", type=Path)
    r.add_argument("--spans", action="store_true")
    r.add_argument("--similarity", type=float, default=0.88)
    x = verbs.add_parser("explain", help="show what explains one run's failure")
    x.add_argument("corpus")
    x.add_argument("run_id")
    x.add_argument("--attempt", type=int)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from stratalog.plans import render, report
    from stratalog.sources import FileCorpus, manifest

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        runs = FileCorpus(args.corpus).runs(spark)
    except manifest.IngestError as error:
        print(f"error: {error}", file=sys.stderr)
        return 3
    if args.verb == "explain":
        rows = report.explain(runs, args.run_id, args.attempt).orderBy("attempt").collect()
        if not rows:
            print(f"error: no run {args.run_id} in {args.corpus}", file=sys.stderr)
            return 2
        for r in rows:
            tokens = "\n".join(f"  {d}" for d in r.discriminators) or "  (nothing but the text itself)"
            print(f"run {r.run_id}#{r.attempt}\nrule {r.span.rule}\nlines {r.span.start_line}-{r.span.end_line}\nsummary {r.span.summary}")
            print(f"fingerprint {r.digest}\ndiscriminators\n{tokens}\nextracted\n" + "\n".join(f"  {x}" for x in r.span.lines))
            print("normalised\n" + "\n".join(f"  {x}" for x in r.normalised.split("\n")))
        return 0
    if args.since is not None:
        runs = manifest.since(runs, args.since)
    found = report.analyse(runs, args.similarity)
    if args.json:
        if str(args.json) == "-":
            sys.stdout.writelines(render.json_pieces(found))
        else:
            with args.json.open("w", encoding="utf-8") as f:
                f.writelines(render.json_pieces(found))
    if args.html:
        args.html.write_text(render.as_html(found), encoding="utf-8")
    if not args.json or str(args.json) != "-":
        print(render.as_text(found, args.top, args.spans), end="")
    return 0
