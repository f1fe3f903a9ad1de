"""``python -m siftmill QUERY --tables FOLDER [--out FOLDER]``: run a query of the catalogue."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siftmill.plans import catalogue


def main() -> None:
    parser = argparse.ArgumentParser(prog="siftmill", description=__doc__)
    parser.add_argument("query", choices=sorted(catalogue.QUERIES))
    parser.add_argument("--tables", required=True, help="folder of Parquet tables")
    parser.add_argument("--out", help="folder to write to; else the first rows are shown")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("siftmill").getOrCreate()
    found = catalogue.QUERIES[args.query](spark, args.tables)
    if args.out:
        found.write.mode("overwrite").parquet(args.out)
    else:
        found.show(20, truncate=80)


if __name__ == "__main__":
    main()
