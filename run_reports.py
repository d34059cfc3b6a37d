"""spark-submit run_reports.py --orders PATH --out PATH [--format parquet|csv]

Reads raw order lines, builds the star schema under OUT/staged and writes every table and
report under OUT. Session settings come from spark-submit.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from weekgrain.plans.pack import write_all
from weekgrain.plans.warehouse import Warehouse
from weekgrain.sources.readers import read_order_lines


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--orders", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    given = args.parse_args()
    spark = SparkSession.builder.appName("weekgrain").getOrCreate()
    lines = read_order_lines(spark, given.orders, given.format)
    write_all(Warehouse(spark, lines, f"{given.out}/staged"), given.out)


if __name__ == "__main__":
    main()
