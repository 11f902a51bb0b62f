"""Command line: the three runs of the survey scripts.

    python -m souk analyse  --survey data.csv --out out/analysed [--location all] [--date 2008] [--method v7]
    python -m souk validate --data data.csv --log log.csv --deletions del.csv --tool tool.csv --out out/checks
    python -m souk compare  --a out/run_a --b out/run_b --out out/compare

Inputs ending in ``.csv`` are read with the survey CSV rules (NA markers,
header normalisation; ``validate`` keeps slashes in names, as sheets do); anything
else is read as Parquet. Uses the active
Spark session (``spark-submit``) or a local one.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .plans.analysis import analyse, write_analysis
from .plans.comparison import compare_runs
from .plans.validation import validate, write_validation
from .sources.io import read_survey_csv, write_table


def _read(spark: SparkSession, path: str, header: str = "csv", index: str | None = None) -> DataFrame:
    return read_survey_csv(spark, path, header=header, index=index) if path.lower().endswith(".csv") else spark.read.parquet(path)


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from .session import local_session
    return local_session()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="souk")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("analyse", help="indicator sheets from a survey table")
    a.add_argument("--survey", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--location", default="all")
    a.add_argument("--date", default="2008")
    a.add_argument("--method", default="v7", choices=("v7", "v6"))
    a.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    v = sub.add_parser("validate", help="cleaning-log, deletion, issue and falsification checks")
    for name in ("data", "log", "deletions", "tool", "out"):
        v.add_argument(f"--{name}", required=True)
    v.add_argument("--question", default="question")
    v.add_argument("--old-value", default="old_value")
    v.add_argument("--new-value", default="new_value")
    v.add_argument("--owner", default="enumerator_org")
    v.add_argument("--enumerator", default="enumerator")
    v.add_argument("--admin", default="call_location")
    v.add_argument("--uuid", default="uuid")
    v.add_argument("--index", default="index")
    v.add_argument("--uuid-log", default="uuid")
    v.add_argument("--uuid-deletions", default="uuid")
    v.add_argument("--order", nargs="*", help="columns that order a data table without an index column (Parquet input)")
    v.add_argument("--one-enumerator")
    v.add_argument("--issues", default="drop_logged", choices=("drop_logged", "keep_logged"))
    v.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    c = sub.add_parser("compare", help="cell-by-cell comparison of two analysed bundles")
    c.add_argument("--a", required=True)
    c.add_argument("--b", required=True)
    c.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = _session()
    if args.cmd == "analyse":
        sheets = analyse(_read(spark, args.survey), args.location, args.date, args.method)
        write_analysis(sheets, args.out, fmt=args.format)
    elif args.cmd == "validate":
        # sheet headers keep the slash of question/option names
        data = _read(spark, args.data, "sheet")
        if args.data.lower().endswith(".csv") and not {args.index, f"X_{args.index}", f"_{args.index}"} & set(data.columns):
            data = _read(spark, args.data, "sheet", args.index)
        log, deletions, tool = (_read(spark, path, "sheet") for path in (args.log, args.deletions, args.tool))
        outs = validate(data, log, deletions, tool, question=args.question, old_value=args.old_value,
                        new_value=args.new_value, owner=args.owner, enumerator=args.enumerator,
                        admin=args.admin, uuid=args.uuid, index=args.index, uuid_log=args.uuid_log,
                        uuid_del=args.uuid_deletions, order=args.order, issues_mode=args.issues,
                        one_enumerator=args.one_enumerator)
        write_validation(outs, args.out, run_date=dt.date.today(), fmt=args.format)
    else:
        write_table(compare_runs(spark, args.a, args.b), args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
