"""Tables, enum domains and dimensions of the business records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUSINESS = (
    "id string, name string, city string, country string, business_type string, address string, phone string, website string, email string, "
    "contact_page_url string, facebook_url string, instagram_url string, whatsapp_number string, linkedin_url string, owner_manager_name string, "
    "assigned_to string, place_id string, maps_url string, source_bot string, rating double, reviews_count int, is_duplicate boolean, "
    "duplicate_of_id string, created_at timestamp_ntz"
)
LEAD = (
    "id string, business_id string, lead_ref int, order_method string, order_method_detail string, delivery_system string, automation_status string, "
    "automation_status_detail string, priority string, notes string, call_status string, follow_up_date date, week_number int, exported_at timestamp_ntz, created_at timestamp_ntz"
)
DISCOVERY = (
    "name string, category string, address string, city string, country string, phone string, website string, google_rating double, reviews_count int, "
    "maps_url string, place_id string, source string"
)
SYNC_RUN = (
    "id string, target string, status string, triggered_by string, worksheet string, rows_written int, rows_updated int, rows_skipped int, error string, "
    "started_at timestamp_ntz, finished_at timestamp_ntz"
)
ORDER_METHODS = ("online", "phone", "in_person", "unknown")
PRIORITIES = ("high", "medium", "low")
AUTOMATION = ("not_started", "in_progress", "completed")
CALL_STATUSES = ("not_contacted", "contacted", "interested", "not_interested", "no_answer", "callback_scheduled")

# The team's dimensions.
WEEKLY_TARGET = 100
INTERNS = (
    ("Inza", ("London", "Dammam"), "United Kingdom"),
    ("Abdul Basit", ("Manchester", "Leeds"), "United Kingdom"),
    ("Fajar", ("Birmingham", "Liverpool"), "United Kingdom"),
    ("Haifa", ("Bristol", "Dubai"), "United Kingdom"),
    ("Fatima", ("Abu Dhabi", "Sharjah"), "United Arab Emirates"),
    ("Usman", ("Islamabad", "Rawalpindi"), "Pakistan"),
    ("Aiza", ("Lahore", "Faisalabad"), "Pakistan"),
    ("Kristina", ("Karachi", "Riyadh"), "Pakistan"),
)
COUNTRIES = ("United Kingdom", "United Arab Emirates", "Pakistan", "Saudi Arabia")
BUSINESS_TYPES = (
    "Supermarket", "Mini Mart", "Convenience Store", "Grocery Store", "Departmental Store", "Asian Grocery Store", "Local Retail Chain",
    "Organic Food Store", "Specialty Food Store",
)


def interns(spark: SparkSession) -> DataFrame:
    """One row an intern, in display order, with the cities as an array."""
    return spark.createDataFrame([(i, n, list(c), country) for i, (n, c, country) in enumerate(INTERNS)], "ordinal int, intern string, cities array<string>, country string")


def labels(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    """A tracked dimension in display order."""
    return spark.createDataFrame(list(enumerate(values)), f"ordinal int, {name} string")
