"""Command line: the three jobs of the source application.

    python -m tallyspark register  <register file>               <out dir>
    python -m tallyspark portal    <portal file> [--received]    <out dir>
    python -m tallyspark compare   <register file> <portal file> <out dir>

On a cluster: ``spark-submit --py-files tallyspark.zip tallyspark/__main__.py compare …``.

Input format follows the extension (csv / xlsx / parquet). Each result
table is written as parquet under ``<out dir>/<table>``; the stats or
summary table is printed (a handful of rows).
"""

from __future__ import annotations

import argparse

from tallyspark.session import get_session
from tallyspark.plans import jobs
from tallyspark.plans.layout import REGISTER_DEFAULTS, REGISTER_REQUIRED
from tallyspark.sources import read_ledger
from tallyspark.sources.delimited import read_flexible


def _read_register(spark, path):
    if path.lower().endswith((".csv", ".txt")):
        return read_flexible(spark, path, set(REGISTER_REQUIRED) | set(REGISTER_DEFAULTS)
                             | {"DATA_REG_FATTURA", "FAT_REG_FATTURA"})
    return read_ledger(spark, path)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tallyspark")
    sub = ap.add_subparsers(dest="job", required=True)
    r = sub.add_parser("register")
    r.add_argument("path")
    r.add_argument("out")
    p = sub.add_parser("portal")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--received", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("register")
    c.add_argument("portal")
    c.add_argument("out")
    args = ap.parse_args(argv)
    spark = get_session()
    if args.job == "register":
        res = jobs.register_report(_read_register(spark, args.path), materialize=True)
        show = "stats"
    elif args.job == "portal":
        raw = read_ledger(spark, args.path)
        res = (jobs.portal_received_report(raw, args.path) if args.received else jobs.portal_paid_report(raw))
        show = "stats"
    else:
        res = jobs.compare_ledgers(read_ledger(spark, args.register), read_ledger(spark, args.portal),
                                   args.register, args.portal, materialize=True)
        show = "summary"
    jobs.write_report(res, args.out, check=jobs.comparison_invariants if args.job == "compare" else None)
    spark.read.parquet(f"{args.out.rstrip('/')}/{show}").show(truncate=False)


if __name__ == "__main__":
    main()
