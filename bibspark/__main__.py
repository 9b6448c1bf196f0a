"""Commands: build an index, keep it fresh, ask it.

    python -m bibspark build dump.xml.gz --root /data/index [--limit N] [--force]
    python -m bibspark merge dump.xml.gz --root /data/index
    python -m bibspark work --root /data/index --url "https://host/{date}.xml.gz" [--zone Europe/Berlin] [--rounds 1]
    python -m bibspark search --root /data/index --q "sparse maps" [--author lo] [--sort year_desc] [--rules rules.json] [--links links.json]
    python -m bibspark status --root /data/index

Every option can be set in the environment as BIBSPARK_ROOT, BIBSPARK_URL and so on. Answers are JSON lines.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path
from zoneinfo import ZoneInfo

from bibspark import refresh
from bibspark.engine import Engine
from bibspark.functions.records import STANDARD
from bibspark.rules import load_links, load_rules
from bibspark.runtime import ship

OPTIONS = {"root": None, "state": None, "url": None, "zone": "UTC", "limit": None, "rounds": None, "q": "", "author": "", "venue": "", "category": "", "sort": "relevance", "rules": None, "links": None}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="bibspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("command", choices=["build", "merge", "work", "search", "status"])
    out.add_argument("archive", nargs="?")
    out.add_argument("--force", action="store_true")
    for name, default in OPTIONS.items():
        out.add_argument(f"--{name}", default=os.environ.get(f"BIBSPARK_{name.upper()}", default))
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("bibspark").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    if not args.root or args.command in ("build", "merge") and not args.archive or args.command == "work" and not args.url:
        print("error: an option is missing: root, the archive of build and merge, or the url of work", file=sys.stderr)
        return 2
    root = Path(args.root)
    state = Path(args.state or root / "state.json")
    tell = lambda row: print(json.dumps(row, default=str), file=out)
    if args.command == "status":
        tell(refresh.status(root, state))
        return 0
    spark = spark or session()
    ship(spark)
    try:
        if args.command == "build":
            tell({"version": refresh.build_archive(spark, Path(args.archive), root, args.limit and int(args.limit), args.force).name} | refresh.read_metadata(root))
        elif args.command == "merge":
            tell({"added": refresh.merge(spark, refresh.read_archive(spark, args.archive), root)})
        elif args.command == "work":
            refresh.Rounds(spark, root, state, args.url, ZoneInfo(args.zone)).work(rounds=args.rounds and int(args.rounds))
        else:
            rules = load_rules(args.rules) if args.rules else STANDARD
            engine = Engine.open(spark, root, load_links(spark, args.links) if args.links else None, rules)
            page = engine.search(q=args.q, author=args.author, venue=args.venue, category=args.category, sort=args.sort, limit=args.limit and int(args.limit))
            for row in page.hits.drop("score").collect():  # a page
                tell(row.asDict())
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
