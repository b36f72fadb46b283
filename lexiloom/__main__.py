"""Command line: python -m lexiloom list | sql NAME | check DATA | run NAME DATA [--to PATH] [--format parquet|json|csv] [--rows N]"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom", description="Corpus analytics on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    sub.add_parser("sql", help="the SQL that must give the same rows").add_argument("name")
    sub.add_parser("check", help="what is wrong with the tables of a folder").add_argument("data")
    run = sub.add_parser("run", help="one query over the tables of a folder")
    run.add_argument("name")
    run.add_argument("data")
    run.add_argument("--to", help="where the result is written; it is shown if this is not given")
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    run.add_argument("--rows", type=int, default=20, help="rows that are shown")
    return p


def main(arguments: list[str] | None = None) -> int:
    from lexiloom import catalog

    given = parser().parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if given.command in ("sql", "run") and given.name not in catalog.QUERIES:
        print(f"no query is named {given.name}", file=sys.stderr)
        return 2
    if given.command == "sql":
        print(catalog.ORACLE.get(given.name, "SQL has no form of it"))
        return 0

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    if given.command == "check":
        from lexiloom.operators.provenance import COLUMNS, faults

        keys = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "events": "event_id"}
        wrong = {name: faults(spark.read.parquet(f"{given.data}/{name}.parquet"), columns, keys.get(name)) for name, columns in COLUMNS.items()}
        print("\n".join(f"{name}: {'; '.join(x) or 'good'}" for name, x in wrong.items()))
        return int(any(wrong.values()))

    from lexiloom.sources.markup import write_results

    df = catalog.QUERIES[given.name](spark, given.data)
    if given.to:
        write_results(df, given.to, given.format)
    else:
        df.show(given.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
