"""Command line: describe, validate, to-json, to-tables, to-markdown."""

from __future__ import annotations

import argparse
import json
import sys
import warnings

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import describe as describing
from .discover import open_dataset
from .operators import json_export, keys, relations


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit codes: 0 fine, 1 not valid, 2 it could not be judged."""
    parser = argparse.ArgumentParser(prog="tabweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("describe", ()), ("validate", ()), ("to-json", ("minimal", "output")), ("to-tables", ("database", "force")), ("to-markdown", ())):
        p = commands.add_parser(name)
        p.add_argument("url")
        p.add_argument("--metadata")
        for option in more:
            if option == "database":
                p.add_argument("database")
            elif option == "output":
                p.add_argument("--output", help="a file, written by tasks, instead of standard output")
            else:
                p.add_argument(f"--{option}", action="store_true")
    args = parser.parse_args(argv)
    session = lambda: spark or SparkSession.builder.appName("tabweave").getOrCreate()
    try:
        if args.command == "describe":
            print(json.dumps(describing.describe(session(), args.url), indent=2, ensure_ascii=False))
            return 0
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            group = open_dataset(args.url, args.metadata)
        if args.command == "to-markdown":
            print(describing.to_markdown(group))
        elif args.command == "to-json" and args.output:
            json_export.write_json(session(), group, args.output, args.minimal)
        elif args.command == "to-json":
            print(json.dumps(json_export.to_json(session(), group, args.minimal), indent=2, ensure_ascii=False))
        elif args.command == "to-tables":
            for p in relations.write_tables(session(), group, args.database, force=args.force):
                print(p.name)
        else:
            found = 0
            for v in keys.validate(session(), group).toLocalIterator():
                print(f"{v.url}:{v.sourcenum}: {v.kind}: {v.columns}: {v.message}")
                found += 1
            for w in seen:
                print(w.message)
            return int(bool(found or seen))
    except (ValueError, OSError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
