"""Business and lead views over the driver's tables; one SQL text makes the same rows in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(key: str, values: list[str | None]) -> str:
    """A CASE that goes round ``values`` by ``key``."""
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


def text(expression: str) -> str:
    return f"cast({expression} AS varchar(20))"


BIZ = f"""
SELECT {text("c_custkey")} AS id,
  concat('Shop ', {text("c_custkey % 400")}, {pick("c_custkey", [" Supermarket", " Ltd", " Mini Mart", ""])}) AS name,
  CASE WHEN c_custkey % 2 = 0 THEN {pick("(c_custkey // 2)", ["London", "BRISTOL ", "Lahore", "Riyadh", None])} ELSE n_name END AS city,
  CASE WHEN c_custkey % 3 = 0 THEN {pick("(c_custkey // 3)", ["uk", " UAE", "pakistan", "", None, "saudi arabia", "côte d''ivoire"]).replace("''''", "''")} ELSE r_name END AS country,
  {pick("c_custkey", ["Supermarket", "Mini Mart", "Bakery ", None, "Grocery Store", ""])} AS business_type,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('+44 117 ', {text("1000000 + c_custkey % 700")}) END AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE concat('https://www.shop', {text("c_custkey % 300")}, '.co.uk/x') END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN concat('info', {text("c_custkey")}, '@shop.test') END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN concat('pid', {text("c_custkey % 210")}) END AS place_id,
  CASE WHEN c_custkey % 9 = 0 THEN concat('https://facebook.com/', {text("c_custkey")}) END AS facebook_url,
  CASE WHEN c_custkey % 10 = 0 THEN concat('9715', {text("c_custkey")}) END AS whatsapp_number,
  CASE WHEN c_custkey % 6 = 0 THEN 'Haifa' WHEN c_custkey % 6 = 1 THEN '' END AS assigned_to,
  cast(c_custkey % 500 AS int) AS reviews_count, c_custkey % 11 = 0 AS is_duplicate
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""
LEAD = f"""
SELECT {text("o_orderkey")} AS id, {text("o_custkey")} AS business_id, cast(o_orderkey AS int) AS lead_ref,
  {pick("o_orderkey", ["online", "phone", "in_person", "unknown"])} AS order_method,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Walk-in + Delivery' WHEN o_orderkey % 5 = 1 THEN '' END AS order_method_detail,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Third-party Delivery' END AS delivery_system,
  {pick("o_orderkey", ["not_started", "in_progress", "completed"])} AS automation_status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Manual (likely)' END AS automation_status_detail,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN o_orderkey % 8 = 0 THEN ' call, "later" ' END AS notes,
  {pick("o_orderkey", ["not_contacted", "interested", "no_answer", "callback_scheduled"])} AS call_status,
  CASE WHEN o_orderkey % 6 = 0 THEN cast(o_orderdate AS date) END AS follow_up_date,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(weekofyear(o_orderdate) AS int) END AS week_number,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS exported_at, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS created_at
FROM {{orders}}
"""
CELLS = ["", " N/A ", "unkown", "—", "+44 117 952 4240", "4.41317E+11", "0117 952 4240", "120+", "2,409", "1.2.3", "Week 12", "99", "5.0", "-3.5", "2026-08-03", "03/08/2026", "31/12/2025",
         "3 Aug 2026", "2026-13-45", "yes", "High", "Urgent!!", "in progress", "Contacted – Interested", "attempted / no answer", "Follow-up", "Semi-Automated?", "Manual (likely)", "fully automated",
         "Website + Mobile", "WhatsApp", "walk in store", "Wah Yan Hong Ltd", "The Shop & Co", "Café Ünï 24", "042-111-933-933", "+971 50 110 4711", "00971501104711", "https://user:pw@www.Shop.co.uk:80/x?y",
         "localhost", "shop.example/path", "HTTP://WWW.A-B.CO#f", "facebook.com/x | instagram.com/y, wa.me/971501", "linkedin.com/in/z", "12345", "nan"]
DIRTY = f"SELECT o_orderkey AS k, {pick('o_orderkey', CELLS)} AS cell FROM {{orders}}"
TABLES = ("customer", "nation", "region", "orders", "pages", "documents", "events")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in TABLES if f"{{{t}}}" in sql]
    return spark.sql(sql.replace(" // ", " DIV "), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def biz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns that the operators read; those without a stand-in are null."""
    return view(spark, sf_dir, BIZ)


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LEAD)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DIRTY)


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES}) if "{" in sql else sql


WITH = f"WITH biz AS ({duck(BIZ)}), lead AS ({duck(LEAD)}), dirty AS ({duck(DIRTY)})"
