"""Command line: ``python -m tessera QUERY TABLES OUTPUT [MASTER]`` runs one registered query and writes CSV with a header."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera.plans import catalog
from tessera.sources import files

USAGE = "usage: python -m tessera QUERY TABLES OUTPUT [MASTER]"


def main(args: list[str]) -> int:
    known = catalog.queries()
    if len(args) not in (3, 4):
        print(USAGE, file=sys.stderr)
        return 2
    name, tables, output = args[:3]
    if name not in known:
        print(f"unknown query {name}; known: {' '.join(sorted(known))}", file=sys.stderr)
        return 2
    builder = SparkSession.builder.appName(f"tessera {name}")
    spark = (builder.master(args[3]) if len(args) == 4 else builder).getOrCreate()
    found = known[name](spark, tables)
    print(files.explain_text(found), file=sys.stderr)
    files.write_csv(found, output, header=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
