"""Command line: ``python -m pairwright.cli query NAME FOLDER``, ``list``, ``score``, ``merge``, ``audit``."""

from __future__ import annotations

import argparse

from .session import local


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pairwright")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--to", help="a folder for Parquet; else rows are shown")
    s = sub.add_parser("score")
    s.add_argument("outputs")
    s.add_argument("manifest")
    s.add_argument("to")
    s.add_argument("--profile", default="light")
    m = sub.add_parser("merge")
    m.add_argument("to")
    m.add_argument("logs", nargs="+")
    a = sub.add_parser("audit")
    a.add_argument("csv")
    args = p.parse_args(argv)
    from . import catalog
    from .operators import gates, latest, scoring
    from .sources import files

    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = local()
    log = "system_id string, record_id string, seq long, status string, output_text string, error string, prompt_version string, latency_seconds double"
    if args.command == "query":
        df = catalog.queries()[args.name](spark, args.folder)
        df.write.mode("overwrite").parquet(args.to) if args.to else df.show(50, False)
    elif args.command == "score":
        manifest = files.read_jsonl(spark, args.manifest, "record_id string, source_id string, source string, reference string", missing_ok=False)
        scored = scoring.score_rows(files.read_jsonl(spark, args.outputs, log, missing_ok=False), manifest, args.profile, counts=True).persist()
        files.write_all_or_none({f"{args.to}/systems": scoring.score_systems(scored), f"{args.to}/sources": scoring.score_systems(scored, by=["source_id", "system_id"])})
    elif args.command == "merge":
        files.write_jsonl(latest.merge_logs([files.read_jsonl(spark, x, log, missing_ok=False) for x in args.logs], ["system_id", "record_id"], "seq"), args.to)
    else:
        gates.enforce(gates.release_audit(spark.read.option("header", True).csv(args.csv)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
