"""python -m tidemark --data FOLDER [--out FOLDER] [--limit ORDERS] [--top N]"""

from __future__ import annotations

import argparse
import sys

from .plans import pipeline
from .schema import Settings
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description="Findings in a folder of sales tables, with evidence.")
    p.add_argument("--data", required=True, help="folder of .csv or .parquet tables")
    p.add_argument("--out", default="reports", help="folder for the report")
    p.add_argument("--limit", type=int, default=0, help="orders to sample; 0 takes all")
    p.add_argument("--top", type=int, default=10, help="findings to show")
    p.add_argument("--cores", default="8", help="cores of the local session")
    args = p.parse_args(argv)
    spark = local_session(args.cores)
    for label, path in pipeline.to_report(spark, args.data, args.out, Settings(row_limit=args.limit, top_findings=args.top)).items():
        print(f"{label}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
