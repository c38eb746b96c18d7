"""Lead rows: get-or-create, updates, classification, and the import of typed sheet rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import strip, truthy
from ..functions.web import unfenced
from ..schema import interns
from ..sources import sheets
from . import resolve
from .dashboard import city_owners

FALLBACK = {"order_method": "Unknown", "delivery_system": "Unknown", "automation_status": "Unknown", "lead_priority": "Low", "notes": "Gemini unavailable"}  # fixed values of a missing answer
LEAD_DEFAULTS = {"order_method": "unknown", "priority": "medium", "automation_status": "not_started", "call_status": "not_contacted"}

LEAD_FIELDS = ("order_method", "order_method_detail", "delivery_system", "automation_status", "automation_status_detail", "priority", "notes", "call_status", "follow_up_date", "week_number")


def row_id(*parts: Column) -> Column:
    """An id that a rerun gives again."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256).substr(1, 32)


def missing_leads(businesses: DataFrame, leads: DataFrame) -> DataFrame:
    """A default lead for every business that has none."""
    bare = businesses.select("id").join(leads.select("business_id"), F.col("id") == F.col("business_id"), "left_anti")
    return bare.select(row_id(F.lit("lead"), "id").alias("id"), F.col("id").alias("business_id"), *[F.lit(v).alias(k) for k, v in LEAD_DEFAULTS.items()])


def update(leads: DataFrame, patches: DataFrame) -> DataFrame:
    """Overwrite only what a patch has: a map from field to text, keyed by lead id; an absent field is left alone, a null one is cleared."""
    p = patches.select(F.col("id").alias("_id"), "fields")
    rows = leads.join(p, F.col("id") == F.col("_id"), "left")
    kinds = dict(leads.dtypes)
    value = lambda c: F.when(F.coalesce(F.map_contains_key("fields", c), F.lit(False)), F.try_element_at("fields", F.lit(c)).try_cast(kinds[c])).otherwise(F.col(c))
    return rows.select("id", *[value(c).alias(c) for c in leads.columns if c != "id"])


def answers(replies: DataFrame) -> DataFrame:
    """id and the classified fields of a model's ``replies`` (id, reply): JSON objects, fenced or not, with a text for every field.

    Any other reply is no answer, so that ``classify`` gives the fallback.  Of several answers for a lead one counts, the least.
    """
    told = replies.select("id", F.try_parse_json(unfenced(F.col("reply"))).alias("v"))
    part = {k: F.try_variant_get("v", f"$.{k}", "variant") for k in FALLBACK}
    texts = told.select("id", *[F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).alias(k) for k, v in part.items()]).na.drop(subset=list(FALLBACK))
    return texts.groupBy("id").agg(F.min(F.struct(*FALLBACK)).alias("a")).select("id", "a.*")


def classify(leads: DataFrame, answers: DataFrame) -> DataFrame:
    """Overwrite the classified fields; where there is no answer the fixed fallback stands."""
    a = answers.select(F.col("id").alias("_id"), *[F.col(k).alias(f"a_{k}") for k in FALLBACK])
    rows = leads.join(a, F.col("id") == F.col("_id"), "left")
    got = {k: F.when(F.col("_id").isNull(), v).otherwise(F.col(f"a_{k}")) for k, v in FALLBACK.items()}
    out = {"order_method_detail": got["order_method"], "delivery_system": got["delivery_system"], "automation_status_detail": got["automation_status"], "priority": F.lower(got["lead_priority"]), "notes": got["notes"]}
    return rows.withColumns(out).select(*leads.columns)


def import_rows(existing: DataFrame, typed: DataFrame, batch: str, at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Businesses and leads after an import of typed rows with a ``sequence``, the order of the sheet.

    Rows without a name are skipped.  Stored businesses come before all rows, rows in order of their sequence.
    Businesses fill blanks, the first value stays; of a business's rows the last one's lead fields count, nulls
    included.  Stored businesses keep their date; new ones get the time of the import.
    """
    now = at or datetime.now(timezone.utc).replace(tzinfo=None)
    named = typed.where(truthy(strip(F.col("name")))).withColumn("id", row_id(F.lit(batch), F.col("sequence").cast("string")))
    incoming = named.select("sequence", *[c for c in existing.columns if c in named.columns and c != "created_at"]).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    for f in existing.schema:
        if f.name not in incoming.columns:
            incoming = incoming.withColumn(f.name, (F.lit(False) if f.name == "is_duplicate" else F.lit(None)).cast(f.dataType))
    folded = resolve.arrived(existing, incoming, "sequence")
    owner = folded.where("created").select(F.col("id").alias("_i"), F.coalesce(F.when(F.col("is_duplicate"), F.col("duplicate_of_id")), F.col("id")).alias("business_id"))
    last = Window.partitionBy("business_id").orderBy(F.desc("sequence"))
    leads = named.join(owner, F.col("id") == F.col("_i")).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    leads = leads.select(row_id(F.lit("lead"), "business_id").alias("id"), "business_id", *[c for c in LEAD_FIELDS if c in named.columns])
    return folded.where(~(F.col("created") & F.col("is_duplicate"))), leads


def import_frame(existing: DataFrame, sheet: DataFrame, batch: str, assigned_to: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import a frame whose columns are headers of a sheet: businesses, leads and the created, merged and skipped rows.

    Rows that are null in every column are dropped first and not counted; blank texts are rows, which are skipped.
    The order of rows is that of a column ``sequence`` where the frame has one, else that of its partitions.
    """
    number = F.col("sequence") if "sequence" in sheet.columns else F.monotonically_increasing_id()
    cells = [c for c in sheet.columns if c != "sequence"]
    rows = sheet.na.drop("all", subset=cells).withColumn("sequence", number)
    typed = sheets.typed_rows(sheets.sheet_fields(rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cells], "sequence"), keep=("sequence",)), assigned_to, keep=("sequence",))
    businesses, leads = import_rows(existing, typed, batch)
    return businesses, leads, import_counts(typed, businesses)


def import_counts(typed: DataFrame, businesses: DataFrame) -> DataFrame:
    """One row with created, merged and skipped rows of an import; ``businesses`` is what import_rows has made of ``typed``."""
    rows = typed.agg(F.count("*").alias("rows"), F.count_if(truthy(strip(F.col("name")))).alias("named"))
    made = businesses.agg(F.count_if("created").alias("created"))
    both = rows.withColumn("_k", F.lit(1)).join(made.withColumn("_k", F.lit(1)), "_k")
    return both.select("created", (F.col("named") - F.col("created")).alias("merged"), (F.col("rows") - F.col("named")).alias("skipped"))


def merged_leads(stored: DataFrame, new: DataFrame, at: datetime) -> DataFrame:
    """Stored leads with the imported ones: of a lead that is there already its id, number and dates stay and the imported fields replace what it had."""
    fresh = new.select(F.col("id").alias("_id"), F.col("business_id").alias("_b"), *[F.col(c).alias(f"_{c}") for c in LEAD_FIELDS if c in new.columns])
    rows = stored.withColumn("_old", F.lit(True)).join(fresh, F.col("business_id") == F.col("_b"), "full")
    kinds, known = dict(stored.dtypes), F.col("_b").isNotNull()
    values = {"id": F.coalesce("id", "_id"), "business_id": F.coalesce("business_id", "_b"), "created_at": F.when(F.col("_old"), F.col("created_at")).otherwise(F.lit(at).cast("timestamp_ntz"))}
    values |= {c: F.when(known, F.col(f"_{c}")).otherwise(F.col(c)) for c in LEAD_FIELDS if c in new.columns}
    return rows.select(*[values.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in stored.columns])


def ingest(existing: DataFrame, stored: DataFrame, records: DataFrame, batch: str, at: datetime, week: int, assigned_to: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Businesses, leads and counts after scraped records (columns of schema.DISCOVERY, in order of ``sequence``).

    A record without a name is skipped; others fill blanks of the business that they repeat or add one, owned by
    ``assigned_to`` or else the intern of its city.  The lead of every business that is seen is made if there is
    none, in ``week``, and its status starts again: queued, or skipped without a website.
    """
    typed = sheets.discovered(records, assigned_to)
    owners = F.broadcast(city_owners(interns(records.sparkSession)))  # a constant of 16 rows
    typed = typed.join(owners, F.lower(strip(F.col("city"))) == F.col("owned_city"), "left").withColumn("assigned_to", F.coalesce("assigned_to", "owner")).drop("owned_city", "owner")
    businesses, touched = import_rows(existing, typed, batch, at)
    site = businesses.select(F.col("id").alias("_s"), truthy(strip(F.col("website"))).alias("has_site"))
    status = touched.select("id", "business_id").join(site, F.col("business_id") == F.col("_s"))
    status = status.select(
        "id", "business_id", F.when(F.col("has_site"), "in_progress").otherwise("completed").alias("automation_status"),
        F.when(F.col("has_site"), "Queued").otherwise("Skipped (No Website)").alias("automation_status_detail"),
    )
    fresh = F.col("created_at") == F.lit(at).cast("timestamp_ntz")
    leads = merged_leads(stored, status, at)
    defaults = {c: F.coalesce(c, F.lit(v)) for c, v in LEAD_DEFAULTS.items()} | {"week_number": F.when(fresh & F.col("week_number").isNull(), week).otherwise(F.col("week_number"))}
    return businesses, leads.withColumns({c: v for c, v in defaults.items() if c in leads.columns}).select(*leads.columns), import_counts(typed, businesses)
