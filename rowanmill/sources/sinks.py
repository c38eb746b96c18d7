"""Writing sheets: CSV with the dialect of the exports, one named file, JSON, and the weekly jobs with their audit."""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
import shutil
import textwrap
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, export
from ..schema import SYNC_RUN
from .tables import cut

#: Bytes that a copying task holds.
COPIED = 1 << 20


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of part files: header, CRLF, quotes where needed and doubled inside."""
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="", lineSep="\r\n").csv(path)


def _line(values: list) -> str:
    out = io.StringIO()
    csv.writer(out).writerow(values)
    return out.getvalue()


def _as_lines(df: DataFrame, made: Callable[[pa.RecordBatch], list[str]]) -> DataFrame:
    """One string ``value`` a row, in the order and the partitions of ``df``; times are those of the session's zone."""
    kinds = [kind for _, kind in df.dtypes]
    numbered = df.toDF(*[f"_{k}" for k in range(len(kinds))])  # names may hold dots or come twice
    naive = numbered.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in zip(numbered.columns, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(made(batch), pa.string())], names=["value"])

    return naive.mapInArrow(run, "value string")


def _csv_rows(batch: pa.RecordBatch) -> list[str]:
    return [_line(["" if v is None else v for v in row]).removesuffix("\r\n") for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]


def _json_rows(batch: pa.RecordBatch, names: list[str]) -> list[str]:
    rows = zip(*[c.to_pylist(maps_as_pydicts="strict") for c in batch.columns], strict=True)
    return [textwrap.indent(json.dumps(dict(zip(names, row, strict=True)), indent=2, ensure_ascii=False, default=str), "  ") for row in rows]


def _put(batches: Iterator[pa.RecordBatch], draft: str) -> Iterator[pa.RecordBatch]:
    """Copy parts to their places in ``draft``; a task that runs twice writes the same bytes to the same place."""
    for batch in batches:
        for row in batch.to_pylist():
            with open(row["name"], "rb") as part, open(draft, "r+b") as whole:
                whole.seek(row["at"])
                shutil.copyfileobj(part, whole, COPIED)
        yield batch.select(["at"])


def write_one_file(lines: DataFrame, path: str, head: bytes, between: str, tail: bytes | None = None) -> int:
    """One file of ``head`` and the lines (``value``) in their order, each with ``between`` behind it; returns their number.

    Tasks write parts in order, the sums of the parts' sizes say where each begins, and tasks copy them there, so no
    row comes to the driver.  With ``tail`` that stands in place of what would follow the last line.  The file is put
    in place when it is whole; no rows and no ``head`` make none.  ``path`` lies in a folder that driver and executors
    share as a file system; where parts are missing or short, this fails and an older file stays.
    """
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    parts, draft, seen = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}.draft", Observation()
    try:
        counted = lines.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
        counted.write.option("lineSep", between).text(f"file://{parts}")
        rows, gap = seen.get["rows"], len(between.encode())
        names = sorted((n for n in os.listdir(parts) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
        sizes = [os.path.getsize(os.path.join(parts, n)) for n in names]
        if sum(sizes) != seen.get["bytes"] + rows * gap:
            raise OSError(f"{parts} doesn't hold all rows; is it a folder that driver and executors share?")
        if not rows and not head:
            return 0
        with open(draft, "wb") as whole:
            whole.write(head)
            whole.truncate(len(head) + sum(sizes))
        places = [(os.path.join(parts, n), at) for n, size, at in zip(names, sizes, accumulate(sizes, initial=len(head)), strict=False) if size]  # one a part
        if places:
            placed = lines.sparkSession.createDataFrame(places, "name string, at long").repartition(len(places), "at")
            placed.mapInArrow(partial(_put, draft=draft), "at long").agg(F.count("*")).collect()
        if tail is not None:
            with open(draft, "r+b") as whole:
                whole.truncate(len(head) + sum(sizes) - (gap if rows else 0))
                whole.seek(0, os.SEEK_END)
                whole.write(tail)
        os.replace(draft, path)
        return rows
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if os.path.exists(draft):
            os.remove(draft)


def write_named_csv(df: DataFrame, path: str) -> int:
    """One file with a byte-order mark, as spreadsheet programs expect; returns its rows without the header."""
    return write_one_file(_as_lines(df, _csv_rows), path, codecs.BOM_UTF8 + _line(df.columns).encode(), "\r\n")


def write_json_array(df: DataFrame, path: str) -> int:
    """All rows as one indented JSON array in a named file, non-ASCII kept."""
    if df.isEmpty():
        return write_one_file(df.select(F.lit("").alias("value")), path, b"[]", "\n")
    return write_one_file(_as_lines(df, partial(_json_rows, names=df.columns)), path, b"[\n", ",\n", b"\n]")


def write_found_csv(df: DataFrame, path: str) -> int:
    """Results of a search as one CSV file without a byte-order mark; nothing is written when there are none."""
    if df.isEmpty():
        return 0
    return write_one_file(_as_lines(df, _csv_rows), path, _line(df.columns).encode(), "\r\n")


def export_name(city: str | None = None, at: datetime | None = None) -> str:
    """The name of a download, by city and minute."""
    at = at or datetime.now(timezone.utc)
    return f"leads{f'_{city.lower()}' if city else ''}_{at:%Y%m%d_%H%M}.csv"


def audited(spark: SparkSession, audit_path: str, run_id: str, triggered_by: str, job: Callable[[], int], worksheet: str | None = None) -> int:
    """Run an export between two rows of the audit: "running" before it starts, then how it ended; a failure is recorded and raised again.

    The audit is a log that is only added to; a job that is killed leaves its first row, and ``latest_runs`` shows it as running.
    """
    now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    started = now()

    def record(status: str, rows: int, error: str | None, finished: datetime | None) -> None:
        row = (run_id, "csv", status, triggered_by, worksheet, rows, 0, 0, error, started, finished)
        spark.createDataFrame([row], SYNC_RUN).coalesce(1).write.mode("append").parquet(audit_path)

    record("running", 0, None, None)
    try:
        rows = job()
    except Exception as e:
        record("failed", 0, f"{type(e).__name__}: {e}", now())
        raise
    record("success", rows, None, now())
    return rows


def latest_runs(events: DataFrame) -> DataFrame:
    """One row a run, as its last event has it; a run without an end is still running, or its job has died."""
    at = F.struct(F.col("finished_at").isNotNull(), F.col("finished_at"))
    return events.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*[F.col(c) for c in events.columns]), at).alias("_run")).select("_run.*")


def week_file(kind: str, week: int, city: str | None = None) -> str:
    """The name of a week's file; a rerun of the week overwrites it."""
    part = f"_{city.lower().replace(' ', '_')}" if city else ""
    return f"{kind}_week{week:02d}{part}.csv"


def export_leads(leads: DataFrame, businesses: DataFrame, folder: str, audit_path: str, week: int, triggered_by: str, city: str | None = None, unsynced: bool = False) -> tuple[DataFrame, dict]:
    """Write a week's file of leads: all leads with ``exported_at`` set on those written, and a summary.

    The week names the file and filters nothing.  Where writing fails the audit says so and no lead is stamped.
    """
    at, name = datetime.now(timezone.utc).replace(tzinfo=None), week_file("leads", week, city)
    path, held = os.path.join(folder, name), []

    def write() -> int:
        # evaluated once: what is stamped is what is in the file
        held.append(cut(export.joined(leads, businesses).where(export.lead_filter(city=city, unsynced=unsynced))))
        return write_named_csv(export.sheet_row(export.export_order(held[0])), path)

    written = audited(leads.sparkSession, audit_path, uuid.uuid4().hex, triggered_by, write, name)
    done = held[0].select(F.col("id").alias("_done")).distinct()
    stamped = leads.join(done, F.col("id") == F.col("_done"), "left")
    stamped = stamped.withColumn("exported_at", F.when(F.col("_done").isNotNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("exported_at"))).drop("_done")
    return stamped, {"status": "success", "file": path, "rows_written": written, "week_number": week}


def export_dashboard(leads: DataFrame, businesses: DataFrame, folder: str, audit_path: str, week: int, triggered_by: str) -> dict:
    """Write a week's dashboard; rows_written counts the rows of its layout."""
    name, at = week_file("dashboard", week), datetime.now(timezone.utc)
    path, rows = os.path.join(folder, name), dashboard.attributed(leads, businesses)
    head = dashboard.headline(rows, week).first()

    def write() -> int:
        os.makedirs(folder, exist_ok=True)
        lines = [r["cells"] for r in dashboard.layout(rows, week, f"{at:%Y-%m-%d %H:%M}").collect()]  # as many as the dimensions have
        with open(path, "w", encoding="utf-8-sig", newline="") as f:
            f.writelines(map(_line, lines))
        return len(lines)

    written = audited(leads.sparkSession, audit_path, uuid.uuid4().hex, triggered_by, write, name)
    return {"status": "success", "file": path, "rows_written": written, "week_number": week, "total_leads_this_week": head["total_leads_this_week"], "percent_of_target": head["percent_of_target"]}


def weekly_export(leads: DataFrame, businesses: DataFrame, folder: str, audit_path: str, week: int, triggered_by: str) -> tuple[DataFrame, dict]:
    """Both files of a week: the stamped leads and both summaries."""
    stamped, told = export_leads(leads, businesses, folder, audit_path, week, triggered_by)
    return stamped, {"leads": told, "dashboard": export_dashboard(leads, businesses, folder, audit_path, week, triggered_by)}
