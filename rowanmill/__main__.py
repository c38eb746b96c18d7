"""Command line over a folder of tables: import a sheet, sweep duplicates, export leads, print the dashboard.

Tables are the folders ``businesses`` and ``leads``; a job merges the rows that it has changed as the next version,
so that a failed job leaves the old one as it was.
"""

from __future__ import annotations

import argparse
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import dashboard, export, leads, resolve
from .sources import sheets, sinks
from .sources.tables import Table, changed, cut


def tables(spark: SparkSession, folder: str) -> tuple[Table, Table]:
    """The businesses and the leads."""
    return Table(spark, f"{folder}/businesses", schema.BUSINESS), Table(spark, f"{folder}/leads", schema.LEAD)


def import_sheet(spark: SparkSession, folder: str, path: str, assigned_to: str | None, dry_run: bool) -> dict[str, int]:
    """created, merged and skipped rows; a dry run counts and writes nothing."""
    fields = sheets.sheet_fields(sheets.read_sheet(spark, path))
    rows = sheets.typed_rows(fields, assigned_to).withColumn("sequence", F.monotonically_increasing_id()).persist()
    businesses, stored = tables(spark, folder)
    old = businesses.read()
    found, new = leads.import_rows(old, rows, uuid.uuid4().hex if not dry_run else "dry")
    found = found.persist()
    counts = leads.import_counts(rows, found).first().asDict()
    if not dry_run:
        kept = stored.read()
        businesses.merge(changed(old, found.select(*old.columns)))
        stored.merge(changed(kept, leads.merged_leads(kept, new, datetime.now(timezone.utc).replace(tzinfo=None))))
    for df in (rows, found):
        df.unpersist()
    return counts


def sweep(spark: SparkSession, folder: str) -> int:
    """Flag duplicates among stored businesses; the number newly flagged."""
    businesses, _ = tables(spark, folder)
    old = businesses.read()
    done = cut(resolve.resolve(old, sweep=True).select(*old.columns))
    businesses.merge(changed(old, done))
    return done.where("is_duplicate").count() - old.where("is_duplicate").count()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rowanmill")
    parser.add_argument("--tables", default="tables")
    jobs = parser.add_subparsers(dest="job", required=True)
    job = jobs.add_parser("import")
    job.add_argument("sheet")
    job.add_argument("--assigned-to")
    job.add_argument("--dry-run", action="store_true")
    job.add_argument("--backfill-duplicates", action="store_true")
    job = jobs.add_parser("export")
    job.add_argument("out", nargs="?")
    job.add_argument("--city")
    job.add_argument("--only-unsynced", action="store_true")
    job = jobs.add_parser("dashboard")
    job.add_argument("--week", type=int)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("rowanmill").getOrCreate()
    now = datetime.now(timezone.utc)
    if args.job == "import":
        print(import_sheet(spark, args.tables, args.sheet, args.assigned_to, args.dry_run))
        if args.backfill_duplicates and not args.dry_run:
            print({"flagged": sweep(spark, args.tables)})
        return
    businesses, stored = (t.read() for t in tables(spark, args.tables))
    if args.job == "export":
        rows = export.joined(stored, businesses).where(export.lead_filter(city=args.city, unsynced=args.only_unsynced))
        out = args.out or sinks.export_name(args.city)
        sheet = export.sheet_row(export.export_order(rows))
        print(sinks.audited(spark, f"{args.tables}/sync_runs", uuid.uuid4().hex, "command", lambda: sinks.write_named_csv(sheet, out), out))
    else:
        week = args.week or now.isocalendar().week
        for row in dashboard.layout(dashboard.attributed(stored, businesses), week, f"{now:%Y-%m-%d %H:%M}").collect():  # as many rows as the dimensions have
            print(",".join(row["cells"]))


if __name__ == "__main__":
    main()
