"""Command line: scan, plan, review, apply and status over one working folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reelhouse")
    parser.add_argument("--workdir", default="reelhouse_work")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("sources", nargs="+")
    scan.add_argument("--without-metadata", action="store_true", help="scan although exiftool isn't there to read metadata")
    commands.add_parser("plan")
    commands.add_parser("review")
    apply = commands.add_parser("apply")
    apply.add_argument("--out", required=True)
    apply.add_argument("--decisions")
    apply.add_argument("--dry-run", action="store_true")
    commands.add_parser("status")
    return parser


def listed(rows: DataFrame) -> None:
    """Print all rows, of which no more than a partition's are held at a time."""
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> None:
    from .plans.library import Library
    from .sources.files import exiftool_available

    args = arguments().parse_args(argv)
    if args.command == "scan" and not args.without_metadata and not exiftool_available():
        raise SystemExit("exiftool isn't on the PATH: install it, or scan --without-metadata")
    spark = SparkSession.builder.appName("reelhouse").getOrCreate()
    library = Library(spark, args.workdir)
    if args.command == "scan":
        library.scan(args.sources).groupBy("status").count().show()
    elif args.command == "plan":
        library.plan().groupBy("role").count().show()
    elif args.command == "review":
        rows = library.review()
        print("nothing waits for review" if rows is None else f"{rows.count()} files written to decisions.csv")
    elif args.command == "apply" and args.dry_run:
        listed(library.routed(args.out, args.decisions).select("action", "source_path", "dest_path"))
    elif args.command == "apply":
        library.apply(args.out, args.decisions).show()
    else:
        listed(library.status())


if __name__ == "__main__":
    main()
