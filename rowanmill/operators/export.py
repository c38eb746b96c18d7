"""Filtered and ordered lead lists and the 22-column sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import strip, truthy
from ..sources.tables import cut

# The sheet's header row.
SHEET_COLUMNS = (
    "Lead ID", "Business Name", "Business Type", "Country", "City", "Address", "Phone Number", "Email", "Website Available", "Website URL",
    "Owner/Manager Name", "Social Media Links", "Order Method", "Delivery System", "Automation Status", "Google Rating", "Reviews Count",
    "Lead Priority", "Notes", "Call Status", "Follow-up Date", "Week Number",
)
BLANK = "Not Available"


def in_city(city: str) -> Column:
    """The whole city, without regard to case."""
    return F.col("city").ilike(city)


def lookup(df: DataFrame, **keys: str) -> DataFrame:
    """The rows with the given values, such as one id; filters that reach the scan."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in keys.items()]))


def lead_filter(city: str | None = None, country: str | None = None, priority: str | None = None, week: int | None = None, duplicates: bool = False, unsynced: bool = False) -> Column:
    """The conditions that are asked for, joined by and; city and country match anywhere, without regard to case."""
    asked = []
    if not duplicates:
        asked.append(~F.col("is_duplicate"))
    if city:
        asked.append(F.col("city").ilike(f"%{city}%"))
    if country:
        asked.append(F.col("country").ilike(f"%{country}%"))
    if priority:
        asked.append(F.col("priority") == priority)
    if week is not None:
        asked.append(F.col("week_number") == week)
    if unsynced:
        asked.append(F.col("exported_at").isNull())
    return reduce(lambda a, b: a & b, asked, F.lit(True))


def joined(leads: DataFrame, businesses: DataFrame, how: str = "inner") -> DataFrame:
    """Leads with their businesses; of columns that both have, the lead's stay."""
    mine = set(leads.columns)
    other = businesses.select(F.col("id").alias("_bid"), *[c for c in businesses.columns if c not in mine])
    return leads.join(other, F.col("business_id") == F.col("_bid"), how).drop("_bid")


BUSINESS_OUT = (
    "id", "name", "business_type", "country", "city", "address", "phone", "website", "website_available", "email", "rating", "reviews_count", "owner_manager_name", "contact_page_url",
    "facebook_url", "instagram_url", "whatsapp_number", "linkedin_url", "place_id", "maps_url", "source_bot", "assigned_to", "is_duplicate", "created_at",
)


def nested(leads: DataFrame, businesses: DataFrame) -> DataFrame:
    """Leads with their business as a struct, null where there is none."""
    made = businesses.withColumn("website_available", F.coalesce(strip(F.col("website")) != "", F.lit(False))) if "website_available" not in businesses.columns else businesses
    inner = made.select(F.col("id").alias("_bid"), F.struct(*[c for c in BUSINESS_OUT if c in made.columns]).alias("business"))
    return leads.join(inner, F.col("business_id") == F.col("_bid"), "left").drop("_bid")


def iso_week(day: Column) -> Column:
    """The ISO week of a date; weeks have no year."""
    return F.weekofyear(day)


def backfilled(businesses: DataFrame) -> DataFrame:
    """Businesses of an older table: a null flag is no duplicate, and the website's flag follows the website."""
    return businesses.withColumns({"is_duplicate": F.coalesce("is_duplicate", F.lit(False)), "website_available": F.coalesce(F.trim("website") != "", F.lit(False))})


def page(df: DataFrame, skip: int = 0, limit: int = 50, by: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first, undated rows before them; ties by key, so pages don't overlap."""
    return df.orderBy(F.desc_nulls_first(by), key).offset(skip).limit(limit)


def seek(df: DataFrame, after: tuple | None = None, limit: int = 50, by: str = "created_at", key: str = "id") -> DataFrame:
    """The page that follows the row ``after`` (its ``by`` and ``key``; None: the first page) in the order of ``page``.

    What lies before is filtered by values, which reaches the scan, and not counted off, so late pages cost no more than early ones.
    """
    if after is not None:
        at, ident = after
        same = F.col(key) > F.lit(ident)
        if at is None:
            df = df.where((F.col(by).isNull() & same) | F.col(by).isNotNull())
        else:
            df = df.where((F.col(by) < F.lit(at)) | ((F.col(by) == F.lit(at)) & same))
    return df.orderBy(F.desc_nulls_first(by), key).limit(limit)


def cursor(rows: DataFrame, by: str = "created_at", key: str = "id") -> tuple | None:
    """Where the page after ``rows`` (a page) starts."""
    last = rows.orderBy(F.asc_nulls_last(by), F.desc(key)).select(by, key).first()
    return tuple(last) if last else None


def export_order(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(F.asc_nulls_last("created_at"), key)


def number_leads(leads: DataFrame, start: int = 0) -> DataFrame:
    """lead_ref by age, undated leads first, from ``start`` + 1 on.

    Leads are dealt to ranges of age and id, and each is written with its range before anything counts: ranges are
    drawn from samples, so two evaluations need not agree.  Numbers within a range are then offset by the counts
    of the ranges before, so the one window without partitions sees a row a range and not the leads.
    """
    order = [F.col("created_at").asc_nulls_first(), F.col("id").asc()]
    spread = cut(leads.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return spread.withColumn("_rank", rank).join(starts, F.col("_range") == F.col("_r")).withColumn("lead_ref", (F.col("_before") + F.col("_rank") + start).cast("int")).drop("_range", "_rank", "_r", "_before")


def next_ref(leads: DataFrame) -> DataFrame:
    return leads.agg(F.greatest(F.coalesce(F.max("lead_ref"), F.lit(0)), F.lit(1)).alias("next_ref"))


def cell(x: Column, blank: str = BLANK) -> Column:
    """A text cell; blank texts read as ``blank``."""
    return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(blank))


def number_cell(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def double_cell(x: Column) -> Column:
    """A number as Python prints it: no exponent below 1e16."""
    plain = F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(F.regexp_replace(F.rtrim(x.cast("decimal(38,4)").cast("string"), F.lit("0")), r"\.$", ".0"))
    return F.coalesce(plain, F.lit(""))


def enum_cell(x: Column) -> Column:
    return F.coalesce(F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit(BLANK))


def social_cell(facebook: Column, instagram: Column, linkedin: Column, whatsapp: Column) -> Column:
    links = F.array(facebook, instagram, linkedin, F.when(truthy(whatsapp), F.concat(F.lit("wa.me/"), whatsapp)))
    shown = F.array_join(F.transform(F.filter(links, lambda x: strip(x) != ""), strip), " | ")
    return F.when(shown == "", "N/A").otherwise(shown)


def sheet_row(rows: DataFrame) -> DataFrame:
    """22 text columns of leads joined with their businesses; a missing business gives blanks."""
    c = F.col
    values = (
        number_cell(c("lead_ref")), cell(c("name")), cell(c("business_type")), cell(c("country")), cell(c("city")), cell(c("address")), cell(c("phone")),
        cell(c("email")), F.when(F.coalesce(strip(c("website")) != "", F.lit(False)), "Yes").otherwise("No"), cell(c("website"), "N/A"), cell(c("owner_manager_name")),
        social_cell(c("facebook_url"), c("instagram_url"), c("linkedin_url"), c("whatsapp_number")),
        F.when(truthy(c("order_method_detail")), cell(c("order_method_detail"))).otherwise(enum_cell(c("order_method"))), cell(c("delivery_system"), "Unknown"),
        F.when(truthy(c("automation_status_detail")), cell(c("automation_status_detail"))).otherwise(enum_cell(c("automation_status"))),
        double_cell(c("rating")), number_cell(c("reviews_count")), enum_cell(c("priority")), cell(c("notes"), ""), enum_cell(c("call_status")),
        F.coalesce(F.date_format("follow_up_date", "yyyy-MM-dd"), F.lit("N/A")), number_cell(c("week_number")),
    )
    return rows.select(*[v.alias(n) for v, n in zip(values, SHEET_COLUMNS, strict=True)])
