"""Command line: one subcommand for each stage of the medallion run."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from .operators import reconcile
from .operators.checks import CheckFailed
from .operators.store import TableStore
from .plans import medallion
from .session import build_session
from .sources import files, synth


def load_dotenv(path: str = ".env") -> dict[str, str]:
    """``KEY=value`` lines of a file; comments and blank lines are skipped, quotes around a value dropped."""
    out = {}
    if os.path.exists(path):
        with open(path) as lines:
            for line in lines:
                line = line.strip()
                if line and not line.startswith("#") and "=" in line:
                    key, value = line.removeprefix("export ").split("=", 1)
                    out[key.strip()] = value.strip().strip("'\"")
    return out


def setting(name: str, default: str, dotenv: dict[str, str]) -> str:
    """The shell's variable, else the file's, else the default."""
    return os.environ.get(name) or dotenv.get(name) or default


def parser(dotenv: dict[str, str]) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="shelfmark", description=__doc__)
    out.add_argument("--root", default=setting("SHELFMARK_ROOT", "lake", dotenv), help="folder of the tables")
    out.add_argument("--raw", default=setting("SHELFMARK_RAW", "raw", dotenv), help="folder of the source files")
    out.add_argument("--as-of", default=f"{dt.datetime.now(dt.timezone.utc):%Y-%m-%d %H:%M:%S}", help="the run's clock, UTC")
    sub = out.add_subparsers(dest="stage", required=True)
    generate = sub.add_parser("generate", help="write synthetic CSV files")
    generate.add_argument("sales", type=int, nargs="?", default=10_000)
    extract = sub.add_parser("extract", help="CSV files to dated Parquet parts and manifests")
    extract.add_argument("--csv", default="csv")
    extract.add_argument("--date", type=dt.date.fromisoformat, default=dt.datetime.now(dt.timezone.utc).date())
    extract.add_argument("--rows-per-file", type=int, default=500_000)
    extract.add_argument("--compression", default="snappy", choices=["snappy", "zstd", "gzip", "none"])
    extract.add_argument("--overwrite", action="store_true")
    load = sub.add_parser("upload", help="copy parts to the landing folder")
    load.add_argument("--to", required=True)
    load.add_argument("--date")
    load.add_argument("--file")
    load.add_argument("--manifests", action="store_true")
    load.add_argument("--overwrite", action="store_true")
    bronze = sub.add_parser("bronze", help="load new files")
    bronze.add_argument("--table", action="append", choices=medallion.ENTITIES)
    silver = sub.add_parser("silver", help="validate and split")
    silver.add_argument("--dry-run", action="store_true")
    for name in ("gold", "aggregates", "reconcile", "run"):
        sub.add_parser(name)
    return out


def extract(spark, csv: str, raw: str, date: dt.date, **options) -> dict:
    """All five source tables of the CSV folder as parts; a missing file is skipped."""
    from .plans.schemas import RETAIL_RAW, SOURCE

    tables = {}
    for name in ("stores", "products", "customers"):
        tables[name] = files.read_csv_if_there(spark, csv, [f"{name}.csv", f"samples/{name}.csv"], SOURCE[name])
    raw_sales = files.read_csv_if_there(spark, csv, ["retail_raw.csv", "samples/retail_raw.csv"], RETAIL_RAW)
    if raw_sales is not None:
        tables["invoices"], tables["invoice_items"] = synth.headers_and_lines(raw_sales)
    manifests = [files.write_parts(df, raw, name, date, **options) for name, df in tables.items() if df is not None]
    return files.write_run_manifest(spark, raw, date, manifests)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: a check failed; 2: something that is needed is missing."""
    args = parser(load_dotenv()).parse_args(argv)
    spark = build_session()
    store = TableStore(spark, args.root)
    try:
        if args.stage == "generate":
            synth.generate(spark, args.raw, args.sales)
        elif args.stage == "extract":
            print(extract(spark, args.csv, args.raw, args.date, rows_per_file=args.rows_per_file, compression=args.compression, overwrite=args.overwrite))
        elif args.stage == "upload":
            print(files.upload(spark, args.raw, args.to, date=args.date, file_name=args.file, manifests=args.manifests, overwrite=args.overwrite))
        elif args.stage == "bronze":
            print(medallion.load_bronze(spark, store, args.raw, args.as_of, args.table))
        elif args.stage == "silver" and args.dry_run:
            for name, df in medallion.dry_run(store).items():
                print(name)
                df.show(50, False)
        elif args.stage == "silver":
            medallion.load_silver(store, args.as_of).show(50, False)
        elif args.stage == "gold":
            medallion.load_dimensions(store, args.as_of)
            medallion.load_facts(store)
            medallion.load_quality_mart(store)
        elif args.stage == "aggregates":
            medallion.load_aggregates(store, args.as_of)
        else:
            report = medallion.run(spark, args.root, args.raw, args.as_of) if args.stage == "run" else reconcile.report(medallion.reconcile_gold(store))
            report.show(200, False)
            if not report.where("not passed").isEmpty():
                return 1
    except CheckFailed as e:
        print(e, file=sys.stderr)
        return 1
    except (LookupError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
