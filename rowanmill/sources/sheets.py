"""Reading spreadsheets as text, and turning their rows into business and lead columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, places
from ..schema import DISCOVERY, PRIORITIES

# Headers of the sheets and of the discovery export, and the field that each fills.
HEADERS = {
    "lead id": "lead_ref", "business name": "name", "business type": "business_type", "country": "country", "city": "city", "address": "address",
    "phone number": "phone", "phone": "phone", "email": "email", "website available": "website_available", "website url": "website", "website": "website",
    "owner/manager name": "owner_manager_name", "owner manager name": "owner_manager_name", "social media links": "social_media_links",
    "order method": "order_method", "delivery system": "delivery_system", "automation status": "automation_status", "google rating": "rating",
    "rating": "rating", "reviews count": "reviews_count", "lead priority": "priority", "priority": "priority", "notes": "notes",
    "call status": "call_status", "follow-up date": "follow_up_date", "follow up date": "follow_up_date", "week number": "week_number",
    "assigned to": "assigned_to", "intern": "assigned_to", "category": "business_type", "google_rating": "rating", "reviews_count": "reviews_count",
    "maps_url": "maps_url", "place_id": "place_id", "source": "source_bot",
}
TEXT_FIELDS = ("name", "business_type", "country", "city", "address", "email", "website", "owner_manager_name", "assigned_to", "maps_url", "place_id")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text under ``c0, c1, ...`` with the headers in column order as the frame's ``headers``.

    Names are positional because headers may repeat.  Empty cells are empty texts, so blank rows still count.  A CSV
    file of more than one split is read by as many tasks (``split_records``), in its order.
    """
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in ("xlsx", "xlsm"):
        return _read_excel(spark, path)
    if kind != "csv":
        raise ValueError(f"not a sheet that can be read: {path}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(fs):
        raise FileNotFoundError(path)
    options = {"multiLine": True, "escape": '"', "enforceSchema": True, "emptyValue": "", "nullValue": "\0", "inferSchema": False}
    first = spark.read.options(**options, header=False).csv(path).limit(1).collect()
    headers = [(h or "").removeprefix("﻿") for h in first[0]] if first else []
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    if not headers:
        return _named(spark.createDataFrame([], "c0 string"), headers)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    line = spark.read.option("lineSep", "\n").text(path).first()[0]
    if system.getFileStatus(fs).getLen() > split and "\r" not in line.removesuffix("\r"):  # lines that end in \r alone are left to one task
        frame = split_records(spark, path, "\r\n" if line.endswith("\r") else "\n").select(F.from_csv("record", schema, {k: str(v) for k, v in options.items() if k != "enforceSchema"}).alias("r")).select("r.*")
    else:
        frame = spark.read.options(**options, header=True).schema(schema).csv(path)
    return _named(frame.na.fill(""), headers)


def _open_after(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of the line, if one is (``inside``) at its start: a quote opens a cell at its beginning only, and closes it unless doubled."""

    def step(state: Column, cell: Column) -> Column:
        quoted = state | cell.startswith('"')
        rest = F.when(state, cell).otherwise(F.substring(cell, 2, 1 << 30))
        return quoted & ~F.replace(rest, F.lit('""'), F.lit("")).contains('"')

    return F.when(line.contains('"'), F.aggregate(F.split(line, ",", -1), F.lit(inside), step)).otherwise(F.lit(inside))


def split_records(spark: SparkSession, path: str, line_end: str) -> DataFrame:
    """record: the records of a CSV file after the first, which may hold line breaks in quoted cells, in order and without empty lines.

    Whether a line starts within a quoted cell depends on all that stands before it.  But a line is a function of
    that one bit: it keeps it, flips it or sets it.  So a split tells what it makes of either state, one row a
    split; a running composition of these rows gives the state at each split's start, and with it every line's.
    The lines of a split are one window, as large as a split may be.  A quote that is never closed makes one record of
    all that follows, as for any reader.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at")).withColumnRenamed("file_block_start", "block")
    clear, inside = _open_after(F.col("value"), False), _open_after(F.col("value"), True)
    lines = lines.withColumns({"_clear": clear, "_inside": inside})
    lines = lines.withColumns({"_flips": (F.col("_clear") & ~F.col("_inside")).cast("long"), "_sets": F.when(F.col("_clear") == F.col("_inside"), F.col("_clear"))})
    order = Window.partitionBy("block").orderBy("_at")
    lines = lines.withColumns({"n": F.row_number().over(order), "_f": F.sum("_flips").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # what was set last, less the flips until then: with the flips since, it is the state after a line
    base = F.last(F.when(F.col("_sets").isNotNull(), F.col("_sets").cast("long") + F.col("_f")), ignorenulls=True)
    lines = lines.withColumn("_base", base.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumns({c: F.lag(s).over(order) for c, s in (("_f0", "_f"), ("_base0", "_base"))})

    ends = lines.groupBy("block").agg(F.max_by("_f", "n").alias("f"), F.max_by("_base", "n").alias("base"))
    # the same composition over splits, one small row each
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("flips", F.sum("f").over(upto)).withColumn("fixed", F.col("base") + F.col("flips") - F.col("f"))
    state = F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.sum("f").over(before), F.lit(0))
    starts = ends.select(F.col("block").alias("_b"), (state % 2).alias("_given"))

    told = lines.join(starts, F.col("block") == F.col("_b"))
    told = told.withColumn("_starts", (F.coalesce("_base0", "_given") + F.coalesce("_f0", F.lit(0))) % 2 == 0)
    told = told.withColumn("_own", F.last(F.when(F.col("_starts"), F.struct("block", "n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a split's first lines may belong to a record of a split before
    last = told.groupBy("block").agg(F.max(F.when(F.col("_starts"), F.struct("block", "n"))).alias("o"))
    last = last.select(F.col("block").alias("_b2"), F.max("o").over(before).alias("_carried"))
    whole = told.join(last, F.col("block") == F.col("_b2")).groupBy(F.coalesce("_own", "_carried").alias("start"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]), "\n")
    records = whole.agg(text.alias("record"))
    if line_end == "\r\n":
        records = records.withColumn("record", F.replace(F.regexp_replace("record", r"\r\z", ""), F.lit("\r\n"), F.lit("\n")))  # as one task reads them
    records = records.where(F.col("record") != "")
    head = records.agg(F.min("start").alias("_head"))
    return records.join(F.broadcast(head), F.col("start") > F.col("_head")).orderBy("start").select("record")  # head is one row


def _named(frame: DataFrame, headers: list[str]) -> DataFrame:
    return frame.select([F.col(f"c{i}").alias(f"c{i}", metadata={"header": h}) for i, h in enumerate(headers)] or [F.col("c0")])


def _read_excel(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading .xlsx needs openpyxl") from e
    rows = [["" if v is None else str(v) for v in r] for r in openpyxl.load_workbook(path, read_only=True, data_only=True).active.iter_rows(values_only=True)]
    headers = rows[0] if rows else []
    schema = ", ".join(f"c{i} string" for i in range(len(headers))) or "c0 string"
    return _named(spark.createDataFrame(rows[1:], schema), headers)


def sheet_fields(sheet: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed by the table of headers, unknown ones dropped but for ``keep``; of several headers for a field the last counts."""
    named: dict[str, Column] = {c: F.col(c) for c in keep}
    for f in sheet.schema:
        header = f.metadata.get("header", f.name)
        if (field := HEADERS.get(header.strip().lower())) is not None:
            named[field] = F.col(f"`{f.name}`").alias(field)
    return sheet.select(*named.values())


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def business_columns(fields: DataFrame, assigned_to: str | None = None) -> dict[str, Column]:
    """Typed business columns of sheet fields; an owner given for the import goes before that of a row."""
    get = lambda n: _field(fields, n)
    out = {n: cells.clean(get(n)) for n in TEXT_FIELDS}
    out |= {"phone": cells.to_phone(get("phone")), "rating": cells.to_double(get("rating")), "reviews_count": cells.to_int(get("reviews_count")), **cells.social_links(get("social_media_links"))}
    if assigned_to:
        out["assigned_to"] = F.lit(assigned_to)
    out["source_bot"] = F.coalesce(cells.clean(get("source_bot")), F.lit("manual_import"))
    return out


def lead_columns(fields: DataFrame) -> dict[str, Column]:
    get = lambda n: _field(fields, n)
    order, automation = cells.clean(get("order_method")), cells.clean(get("automation_status"))
    return {
        "order_method": cells.order_method(order), "order_method_detail": order, "delivery_system": cells.clean(get("delivery_system")),
        "automation_status": cells.automation_status(automation), "automation_status_detail": automation, "priority": cells.to_enum(get("priority"), PRIORITIES, "medium"),
        "notes": cells.clean(get("notes")), "call_status": cells.call_status(get("call_status")), "follow_up_date": cells.to_date(get("follow_up_date")), "week_number": cells.to_week(get("week_number")),
    }


def typed_rows(fields: DataFrame, assigned_to: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Business and lead columns side by side, after those of ``keep``."""
    return fields.select(*keep, *[c.alias(n) for n, c in (business_columns(fields, assigned_to) | lead_columns(fields)).items()])


def read_discovery(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Records of a map search, as JSON (one array or lines) or CSV."""
    reader = spark.read.schema(DISCOVERY)
    return reader.option("multiLine", True).json(path) if kind == "json" else reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def discovered(records: DataFrame, assigned_to: str | None = None) -> DataFrame:
    """Business columns of scraped records; an address says city and country first, what the record has stands where it doesn't."""
    text = lambda c: F.nullif(cells.strip(F.col(c)), F.lit(""))
    out = {n: text(n) for n in ("name", "address", "phone", "website", "maps_url", "place_id")}
    city, country, address = text("city"), text("country"), out["address"]
    out["city"] = F.when(address.isNotNull(), places.address_city(address, F.coalesce(city, F.lit("")))).otherwise(city)
    out["country"] = F.when(address.isNotNull(), places.address_country(address, country)).otherwise(country)
    out |= {"business_type": text("category"), "rating": F.col("google_rating"), "reviews_count": F.col("reviews_count"), "source_bot": F.coalesce(text("source"), F.lit("google_maps_bot"))}
    out["assigned_to"] = F.lit(assigned_to or None).cast("string")
    return records.select(*[c for c in records.columns if c == "sequence"], *[c.alias(n) for n, c in out.items()])


def first_seen(records: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first record of each key, in order."""
    packed = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(key.alias("_key")).agg(F.min_by(packed, order).alias("r")).select("r.*")
