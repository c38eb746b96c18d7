"""The registered queries of the business-record operators and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, keys, places, scoring, web
from ..operators import dashboard, export, leads, pages, resolve
from ..schema import BUSINESS, BUSINESS_TYPES, COUNTRIES, INTERNS, PRIORITIES, interns
from ..sources import sheets, sinks
from ..streaming import ingest
from . import demo

WEEK = 12
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL twin if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{demo.WITH} {sql}" if "biz" in sql or "lead" in sql or "dirty" in sql else sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else quoted([x]) for x in r) + ")" for r in rows)


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.attributed(demo.leads(spark, sf_dir), demo.biz(spark, sf_dir))


COUNTRY_SQL = (
    "CASE WHEN country IS NULL OR country = '' THEN 'Unspecified' "
    + " ".join(f"WHEN lower(trim(country)) IN ({quoted(v)}) THEN '{k}'" for k, v in dashboard.COUNTRY_NAMES.items())
    + " ELSE list_reduce(list_transform(regexp_extract_all(lower(trim(country)), '\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || b) END"
)
OWNER_SQL = f"(SELECT * FROM (VALUES {values([(c.lower(), n) for n, cs, _ in INTERNS for c in cs])}) o(owned, owner))"
ATTRIBUTED_SQL = f""", flat AS (SELECT week_number, {COUNTRY_SQL} AS country,
  trim(CASE WHEN business_type IS NULL OR business_type = '' THEN 'Unspecified' ELSE business_type END) AS business_type,
  coalesce(nullif(assigned_to, ''), owner) AS intern
  FROM lead JOIN biz ON lead.business_id = biz.id LEFT JOIN {OWNER_SQL} o ON lower(trim(city)) = owned WHERE NOT is_duplicate)"""


@query(f"""{ATTRIBUTED_SQL}, c AS (SELECT country, count(*) FILTER (WHERE week_number = {WEEK}) AS w, count(*) AS t FROM flat GROUP BY country)
SELECT coalesce(ordinal, {len(COUNTRIES)}) AS ordinal, coalesce(c.country, d.country) AS country, coalesce(w, 0) AS leads_this_week, coalesce(t, 0) AS total_leads
FROM c FULL JOIN (VALUES {values(enumerate(COUNTRIES))}) d(ordinal, country) ON c.country = d.country""")
def dashboard_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.by_country(attributed(spark, sf_dir), WEEK)


@query(f"""{ATTRIBUTED_SQL}, c AS (SELECT business_type, count(*) AS t FROM flat GROUP BY business_type)
SELECT coalesce(ordinal, {len(BUSINESS_TYPES)}) AS ordinal, coalesce(c.business_type, d.b) AS business_type, coalesce(t, 0) AS total_leads
FROM c FULL JOIN (VALUES {values(enumerate(BUSINESS_TYPES))}) d(ordinal, b) ON c.business_type = d.b""")
def dashboard_by_business_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.by_business_type(attributed(spark, sf_dir))


@query(f"""{ATTRIBUTED_SQL}, c AS (SELECT intern, count(*) AS n FROM flat WHERE week_number = {WEEK} GROUP BY intern)
SELECT ordinal, d.intern, cities, coalesce(n, 0) AS leads_this_week, 13 AS target_per_week, coalesce(n, 0) >= 13 AS on_track, greatest(13 - coalesce(n, 0), 0) AS shortfall
FROM (VALUES {values((i, n, " + ".join(c)) for i, (n, c, _) in enumerate(INTERNS))}) d(ordinal, intern, cities) LEFT JOIN c ON c.intern = d.intern""")
def dashboard_by_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.by_intern(attributed(spark, sf_dir), WEEK)


@query(f"""{ATTRIBUTED_SQL}, t AS (SELECT count(*) FILTER (WHERE week_number = {WEEK}) AS n FROM flat)
SELECT {WEEK} AS week_number, n AS total_leads_this_week, 100 AS weekly_target, round_even(n / 100 * 100, 1) AS percent_of_target, greatest(100 - n, 0) AS leads_still_needed FROM t""")
def dashboard_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.headline(attributed(spark, sf_dir), WEEK)


TABLES_SQL = f"""{ATTRIBUTED_SQL}, n AS (SELECT count(*) FILTER (WHERE week_number = {WEEK}) AS n FROM flat),
bc AS (SELECT coalesce(ordinal, {len(COUNTRIES)}) AS ordinal, coalesce(c.country, d.country) AS name, coalesce(w, 0) AS w, coalesce(t, 0) AS t
 FROM (SELECT country, count(*) FILTER (WHERE week_number = {WEEK}) AS w, count(*) AS t FROM flat GROUP BY country) c FULL JOIN (VALUES {values(enumerate(COUNTRIES))}) d(ordinal, country) ON c.country = d.country),
bi AS (SELECT ordinal, d.intern AS name, cities, coalesce(n, 0) AS n FROM (VALUES {values((i, n, " + ".join(c)) for i, (n, c, _) in enumerate(INTERNS))}) d(ordinal, intern, cities)
 LEFT JOIN (SELECT intern, count(*) AS n FROM flat WHERE week_number = {WEEK} GROUP BY intern) c ON c.intern = d.intern),
bt AS (SELECT coalesce(ordinal, {len(BUSINESS_TYPES)}) AS ordinal, coalesce(c.business_type, d.b) AS name, coalesce(t, 0) AS t
 FROM (SELECT business_type, count(*) AS t FROM flat GROUP BY business_type) c FULL JOIN (VALUES {values(enumerate(BUSINESS_TYPES))}) d(ordinal, b) ON c.business_type = d.b)"""
LINES_SQL = (
    (0, [["Weekly Lead Generation Dashboard"], [f"Week {WEEK} — generated 2024-03-22 06:00 UTC"], [], ["This Week's Total Leads", "Weekly Target", "% of Target Reached", "Leads Still Needed"]]),
    (2, [[], ["Leads by Country (this week)"], ["Country", "Leads This Week", "Total Leads (all time)"]]),
    (4, [[], ["Leads by Intern (this week)"], ["Intern", "Cities", "Leads This Week", "Target/Week", "On Track?"]]),
    (6, [[], ["Leads by Business Type (all time)"], ["Business Type", "Total Leads"]]),
)
FIXED_SQL = " UNION ALL ".join(f"SELECT {s}, {i}, '', [{quoted(line)}]::VARCHAR[]" for s, lines in LINES_SQL for i, line in enumerate(lines))
PERCENT_SQL = "regexp_replace(round_even(n / 100 * 100, 1)::VARCHAR, '\\.0$', '')"


@query(f"""{TABLES_SQL}, l(section, ordinal, name, cells) AS ({FIXED_SQL}
 UNION ALL SELECT 1, 0, '', [n::VARCHAR, '100', {PERCENT_SQL} || '%', greatest(100 - n, 0)::VARCHAR] FROM n UNION ALL SELECT 3, ordinal, name, [name, w::VARCHAR, t::VARCHAR] FROM bc
 UNION ALL SELECT 5, ordinal, name, [name, cities, n::VARCHAR, '13', CASE WHEN n >= 13 THEN 'Yes' ELSE 'No' END] FROM bi UNION ALL SELECT 7, ordinal, name, [name, t::VARCHAR] FROM bt)
SELECT section, ordinal, name, array_to_string(cells, ' ; ') AS cells FROM l""")
def dashboard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.layout(attributed(spark, sf_dir), WEEK, "2024-03-22 06:00").withColumn("cells", F.array_join("cells", " ; "))


@query(f"""{TABLES_SQL} SELECT '{{"week_number":{WEEK},"headline":{{"total_leads_this_week":' || n || ',"weekly_target":100,"percent_of_target":' || round_even(n / 100 * 100, 1) || ',"leads_still_needed":' || greatest(100 - n, 0)
 || '}},"by_country":[' || (SELECT string_agg('{{"country":"' || name || '","leads_this_week":' || w || ',"total_leads":' || t || '}}', ',' ORDER BY ordinal, name) FROM bc)
 || '],"by_intern":[' || (SELECT string_agg('{{"intern":"' || name || '","cities":"' || cities || '","leads_this_week":' || n || ',"target_per_week":13,"on_track":' || (n >= 13) || ',"shortfall":' || greatest(13 - n, 0) || '}}', ',' ORDER BY ordinal) FROM bi)
 || '],"by_business_type":[' || (SELECT string_agg('{{"business_type":"' || name || '","total_leads":' || t || '}}', ',' ORDER BY ordinal, name) FROM bt) || ']}}' AS dashboard FROM n""")
def dashboard_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.as_json(attributed(spark, sf_dir), WEEK)


@query("SELECT *, weekofyear(created_at)::INT AS iso_week FROM (SELECT lead.id, business_id, created_at, city FROM lead JOIN biz ON lead.business_id = biz.id WHERE lower(city) = 'lahore')")
def leads_of_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.joined(demo.leads(spark, sf_dir), demo.biz(spark, sf_dir)).where(export.in_city("LAHORE"))
    return rows.select("id", "business_id", "created_at", "city", export.iso_week(F.col("created_at")).alias("iso_week"))


@query(f"""SELECT v.city, intern, v.country, ordinal, place, count(biz.id) AS businesses FROM (VALUES {values((c, n, country, i, k) for i, (n, cs, country) in enumerate(INTERNS) for k, c in enumerate(cs))}) v(city, intern, country, ordinal, place)
 LEFT JOIN biz ON lower(trim(biz.city)) = lower(v.city) GROUP BY ALL""")
def intern_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interns' cities with the number of businesses in each."""
    held = demo.biz(spark, sf_dir).groupBy(F.lower(F.trim("city")).alias("_city")).agg(F.count("*").alias("n"))
    cities = dashboard.city_list(interns(spark)).join(held, F.lower("city") == F.col("_city"), "left")
    return cities.select("city", "intern", "country", "ordinal", "place", F.coalesce("n", F.lit(0)).alias("businesses"))


@query("SELECT lead.id, lead.business_id, CASE WHEN biz.id IS NOT NULL THEN biz.name || '/' || biz.city || '/' || CASE WHEN trim(website) <> '' THEN 'true' ELSE 'false' END END AS business FROM lead LEFT JOIN biz ON lead.business_id = biz.id")
def leads_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.nested(demo.leads(spark, sf_dir), demo.biz(spark, sf_dir))
    shown = F.concat(F.col("business.name"), F.lit("/"), F.col("business.city"), F.lit("/"), F.col("business.website_available").cast("string"))
    return rows.select("id", "business_id", shown.alias("business"))


FILTER_SQL = "NOT is_duplicate AND city ILIKE '%o%' AND country ILIKE '%a%' AND priority = 'high' AND week_number = 12 AND exported_at IS NULL"


@query(f"SELECT lead.id, biz.id AS business_id, city, priority, week_number FROM lead JOIN biz ON lead.business_id = biz.id WHERE {FILTER_SQL}")
def leads_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.joined(demo.leads(spark, sf_dir), demo.biz(spark, sf_dir))
    return rows.where(export.lead_filter(city="o", country="a", priority="high", week=12, unsynced=True)).select("id", "business_id", "city", "priority", "week_number")


@query("SELECT lead.id, business_id, name, created_at FROM lead JOIN biz ON lead.business_id = biz.id ORDER BY created_at DESC NULLS FIRST, lead.id OFFSET 100 LIMIT 50")
def leads_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.joined(demo.leads(spark, sf_dir), demo.biz(spark, sf_dir))
    return export.page(rows.select("id", "business_id", "name", "created_at"), 100, 50)


SEEK_SQL = "SELECT {0} FROM {1} WHERE {2} ORDER BY {3} DESC NULLS FIRST, id LIMIT 50"


@query(SEEK_SQL.format("id, business_id, created_at", "lead", "created_at < TIMESTAMP '1995-06-17' OR (created_at = TIMESTAMP '1995-06-17' AND id > '5')", "created_at"))
def leads_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of leads after one that is known by its date and id; the filter reaches the scan."""
    return export.seek(demo.leads(spark, sf_dir).select("id", "business_id", "created_at"), (datetime(1995, 6, 17), "5"))


@query(SEEK_SQL.format("id, name, city, reviews_count", "biz", "city ILIKE '%o%' AND (reviews_count < 300 OR (reviews_count = 300 AND id > '3'))", "reviews_count"))
def businesses_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page of the businesses of some cities, those with most reviews first."""
    rows = demo.biz(spark, sf_dir).where(F.col("city").ilike("%o%")).select("id", "name", "city", "reviews_count")
    return export.seek(rows, (300, "3"), by="reviews_count")


@query(SEEK_SQL.format("id, name, place_id", "biz", "place_id IS NOT NULL AND (place_id < 'pid50' OR (place_id = 'pid50' AND id > '2'))", "place_id"))
def discovered_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page of the listings that a map search has named."""
    rows = demo.biz(spark, sf_dir).where("place_id IS NOT NULL").select("id", "name", "place_id")
    return export.seek(rows, ("pid50", "2"), by="place_id")


RUNS_SQL = f"""SELECT {demo.text("o_orderkey")} AS id, 'csv' AS target, CASE WHEN k = 0 THEN 'running' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'success' END AS status, o_orderdate AS started_at,
 CASE WHEN k = 1 THEN o_orderdate END AS finished_at, CASE WHEN k = 1 THEN o_custkey ELSE 0 END AS rows_written FROM {{orders}}, (VALUES (0), (1)) v(k) WHERE k = 0 OR o_orderkey % 7 <> 0"""


@query(f"""WITH e AS ({demo.duck(RUNS_SQL)}) SELECT id, arg_max(status, finished_at IS NOT NULL) AS status, max(rows_written) AS rows_written, min(started_at) AS started_at FROM e GROUP BY id
 ORDER BY started_at DESC NULLS FIRST, id LIMIT 100""")
def latest_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest runs of an audit log of two events a run, one in seven of which has died."""
    runs = sinks.latest_runs(demo.view(spark, sf_dir, RUNS_SQL))
    return export.seek(runs, limit=100, by="started_at").select("id", "status", "rows_written", "started_at")


@query("SELECT id, row_number() OVER (ORDER BY created_at ASC NULLS FIRST, id)::INT AS lead_ref FROM lead")
def lead_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.number_leads(demo.leads(spark, sf_dir).drop("lead_ref")).select("id", "lead_ref")


@query("SELECT greatest(coalesce(max(lead_ref), 0), 1) AS next_ref FROM lead")
def next_lead_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.next_ref(demo.leads(spark, sf_dir))


def _cell(x: str, blank: str = "Not Available") -> str:
    return f"coalesce(nullif(trim({x}), ''), '{blank}')"


def _enum(x: str) -> str:
    return f"list_reduce(list_transform(string_split({x}, '_'), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b)"


@query(f"""SELECT coalesce(lead_ref::VARCHAR, '') AS "Lead ID", {_cell("name")} AS "Business Name", {_cell("business_type")} AS "Business Type", {_cell("country")} AS "Country", {_cell("city")} AS "City",
 'Not Available' AS "Address", {_cell("phone")} AS "Phone Number", {_cell("email")} AS "Email", CASE WHEN trim(website) <> '' THEN 'Yes' ELSE 'No' END AS "Website Available", {_cell("website", "N/A")} AS "Website URL",
 'Not Available' AS "Owner/Manager Name", CASE WHEN facebook_url IS NULL AND whatsapp_number IS NULL THEN 'N/A' ELSE concat_ws(' | ', facebook_url, 'wa.me/' || whatsapp_number) END AS "Social Media Links",
 CASE WHEN order_method_detail <> '' THEN {_cell("order_method_detail")} ELSE {_enum("order_method")} END AS "Order Method", {_cell("delivery_system", "Unknown")} AS "Delivery System",
 CASE WHEN automation_status_detail <> '' THEN {_cell("automation_status_detail")} ELSE {_enum("automation_status")} END AS "Automation Status", '' AS "Google Rating", reviews_count::VARCHAR AS "Reviews Count",
 {_enum("priority")} AS "Lead Priority", {_cell("notes", "")} AS "Notes", {_enum("call_status")} AS "Call Status", coalesce(strftime(follow_up_date, '%Y-%m-%d'), 'N/A') AS "Follow-up Date", coalesce(week_number::VARCHAR, '') AS "Week Number"
 FROM lead JOIN biz ON lead.business_id = biz.id WHERE NOT is_duplicate""")
def sheet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.joined(demo.leads(spark, sf_dir), demo.biz(spark, sf_dir)).where(export.lead_filter())
    absent = {c: F.lit(None).cast("string") for c in ("address", "owner_manager_name", "instagram_url", "linkedin_url")} | {"rating": F.lit(None).cast("double")}
    return export.sheet_row(rows.withColumns(absent))


BLANK_SQL = f"CASE WHEN lower(trim(cell)) NOT IN ({quoted(cells.BLANKS)}) THEN trim(cell) END"
CLEAN_SQL = f", c AS (SELECT k, cell, {BLANK_SQL} AS t FROM dirty)"


@query(f"""{CLEAN_SQL}, n AS (SELECT *, replace(t, ',', '') AS plain, regexp_replace(t, '[^0-9]', '', 'g') AS digits, try_cast(regexp_extract(t, '[0-9]+') AS INT) AS week FROM c)
SELECT k, t AS clean, CASE WHEN regexp_full_match(plain, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(plain AS DOUBLE) END AS number,
 try_cast(trunc(try_cast(regexp_replace(t, '[^0-9.]', '', 'g') AS DOUBLE)) AS INT) AS whole, CASE WHEN week BETWEEN 1 AND 53 THEN week END AS week,
 CASE WHEN NOT regexp_full_match(replace(t, ' ', ''), '[0-9](\\.[0-9]+)?[eE][+-]?[0-9]+') AND length(digits) >= 7 THEN t END AS phone,
 coalesce(lower(t) IN ('yes', 'y', 'true', '1'), false) AS flag FROM n""")
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cell")
    return demo.dirty(spark, sf_dir).select("k", cells.clean(c).alias("clean"), cells.to_double(c).alias("number"), cells.to_int(c).alias("whole"), cells.to_week(c).alias("week"), cells.to_phone(c).alias("phone"), cells.to_bool(c).alias("flag"))


DATES_SQL = ", ".join(f"try_strptime(t, '{f}')::DATE" for f in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%d %b %Y"))


@query(f"{CLEAN_SQL} SELECT k, coalesce({DATES_SQL}) AS day FROM c")
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.dirty(spark, sf_dir).select("k", cells.to_date(F.col("cell")).alias("day"))


def _phrases(table: dict[str, tuple[str, ...]]) -> str:
    return " ".join(f"WHEN p IN ({quoted(v)}) THEN '{k}'" for k, v in table.items())


@query(f"""{CLEAN_SQL}, p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(t), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS p, translate(lower(t), ' -', '__') AS e, lower(t) AS l FROM c)
SELECT k, CASE WHEN e IN ({quoted(PRIORITIES)}) THEN e ELSE 'medium' END AS priority, CASE {_phrases(cells.CALL_PHRASES)} ELSE 'not_contacted' END AS call_status,
 CASE WHEN t IS NULL THEN 'not_started' {_phrases(cells.AUTOMATION_PHRASES)} WHEN contains(p, 'semi') OR contains(p, 'partial') THEN 'in_progress' WHEN contains(p, 'manual') THEN 'not_started'
 WHEN contains(p, 'automat') THEN 'completed' WHEN e IN ('not_started', 'in_progress', 'completed') THEN e ELSE 'not_started' END AS automation_status,
 CASE WHEN regexp_matches(l, 'website|online|mobile|app') THEN 'online' WHEN regexp_matches(l, 'phone|call|whatsapp') THEN 'phone' WHEN regexp_matches(l, 'walk|in-store|in store') THEN 'in_person' ELSE 'unknown' END AS order_method FROM p""")
def clean_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cells.clean(F.col("cell"))
    return demo.dirty(spark, sf_dir).select("k", cells.to_enum(t, PRIORITIES, "medium").alias("priority"), cells.call_status(t).alias("call_status"), cells.automation_status(t).alias("automation_status"), cells.order_method(t).alias("order_method"))


def _last_of(test: str) -> str:
    return f"list_filter(parts, lambda x: {test})[-1]"


FB, IG, LI, WA = ("regexp_matches(lower(x), '%s')" % p for p in ("facebook|fb\\.com", "instagram", "linkedin", "wa\\.me|whatsapp"))


@query(f"""{CLEAN_SQL}, p AS (SELECT k, list_filter(list_transform(regexp_split_to_array(t, '[|,]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c)
SELECT k, {_last_of(FB)} AS facebook_url, {_last_of(f"{IG} AND NOT {FB}")} AS instagram_url, {_last_of(f"{LI} AND NOT {FB} AND NOT {IG}")} AS linkedin_url,
 regexp_extract({_last_of(f"{WA} AND NOT {FB} AND NOT {IG} AND NOT {LI}")}, '[^/]*$') AS whatsapp_number FROM p""")
def clean_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.dirty(spark, sf_dir).select("k", *[c.alias(n) for n, c in cells.social_links(F.col("cell")).items()])


NAME_SQL = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
TELLING_SQL = f"list_filter({NAME_SQL}, lambda w: w NOT IN ({quoted(keys.NOISE_WORDS)}))"
CODES_SQL = " ".join(f"WHEN starts_with(b, '{c}') AND length(b) >= {8 + len(c)} THEN b[{len(c) + 1}:]" for c in keys.COUNTRY_CODES)


def keys_sql(source: str, ident: str, name: str, phone: str, site: str) -> str:
    return f"""k1 AS (SELECT *, {TELLING_SQL.format(name)} AS w1, {NAME_SQL.format(name)} AS w2, regexp_replace({phone}, '[^0-9]', '', 'g') AS d, lower(trim({site})) AS s FROM {source}),
k2 AS (SELECT *, ltrim(d, '0') AS b, regexp_replace(string_split(string_split(regexp_extract(regexp_replace(s, '^.*?://', ''), '^[^/?#]*'), '@')[-1], ':')[1], '^www\\.', '') AS h FROM k1),
k AS (SELECT *, nullif(array_to_string(list_sort(CASE WHEN len(w1) > 0 THEN w1 ELSE w2 END), ' '), '') AS name_key,
 CASE WHEN length(d) >= 7 THEN nullif(ltrim(CASE {CODES_SQL} ELSE b END, '0'), '') END AS phone_key,
 CASE WHEN s NOT IN ({quoted(keys.NO_WEBSITE)}) AND contains(h, '.') THEN h END AS domain_key FROM k2)"""


SHARED_SQL = f"coalesce(regexp_full_match(phone_key, '[0-9]{{2,3}}111[0-9]{{6}}') OR regexp_matches(phone_key, '^({'|'.join(keys.SERVICE_LINES)})'), false)"


@query(f", {keys_sql('dirty', 'k', 'cell', 'cell', 'cell')} SELECT k.k, name_key, phone_key, domain_key, {SHARED_SQL} AS shared_line FROM k")
def cell_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cell")
    return demo.dirty(spark, sf_dir).select("k", keys.name_key(c).alias("name_key"), keys.phone_key(c).alias("phone_key"), keys.domain_key(c).alias("domain_key"), keys.is_shared_line(keys.phone_key(c)).alias("shared_line"))


@query(f", {keys_sql('biz', 'id', 'name', 'phone', 'website')} SELECT id, name_key, phone_key, domain_key, coalesce(trim(website) <> '', false) AS website_available FROM k")
def business_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_keys(demo.biz(spark, sf_dir)).select("id", "name_key", "phone_key", "domain_key", "website_available")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_keys(demo.biz(spark, sf_dir))


PAIR_SQL = "SELECT a.id AS left_id, b.id AS right_id, {0} AS o, '{1}' AS rule FROM live a JOIN live b ON a.id < b.id AND {2}"
VETO_SQL = "(a.place_id IS NULL OR b.place_id IS NULL OR a.place_id = b.place_id)"


@query(f""", {keys_sql('biz', 'id', 'name', 'phone', 'website')}, live AS (SELECT * FROM k WHERE NOT is_duplicate),
pairs AS ({PAIR_SQL.format(0, "place_id", "a.place_id = b.place_id AND a.place_id <> ''")} UNION ALL
 {PAIR_SQL.format(1, "domain", f"a.domain_key = b.domain_key AND a.city IS NOT DISTINCT FROM b.city AND {VETO_SQL}")} UNION ALL
 {PAIR_SQL.format(2, "name", f"a.name_key = b.name_key AND a.city = b.city AND a.city <> '' AND {VETO_SQL}")})
SELECT left_id, right_id, min_by(rule, o) AS rule FROM pairs GROUP BY left_id, right_id""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.exact_pairs(resolve.with_keys(demo.biz(spark, sf_dir).repartition("id")))  # keys are work for all tasks, however few files hold the records


@query()
def phone_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.phone_pairs(keyed(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few hundred businesses a city, with the columns that the fold fills."""
    df = demo.biz(spark, sf_dir)
    return df.withColumns({c: F.lit(None).cast("string") for c in (*resolve.FILLED, "duplicate_of_id") if c not in df.columns} | {"rating": F.lit(None).cast("double"), "created_at": F.timestamp_seconds(F.col("id").cast("long")).cast("timestamp_ntz")})


@query()
def resolved_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(records(spark, sf_dir)).select("id", "name_key", "is_duplicate", "duplicate_of_id", "email", "place_id")


@query()
def swept_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(records(spark, sf_dir), sweep=True).select("id", "name_key", "is_duplicate", "duplicate_of_id")


CHAIN_SQL = f"SELECT {demo.text('c_custkey')} AS id, CASE WHEN c_custkey % 40 <> 0 THEN {demo.text('c_custkey - 1')} END AS duplicate_of_id FROM {{customer}}"


@query(f"""WITH RECURSIVE c AS ({demo.duck(CHAIN_SQL)}), w(id, here) AS (SELECT id, id FROM c UNION ALL SELECT w.id, duplicate_of_id FROM w JOIN c ON w.here = c.id WHERE duplicate_of_id IS NOT NULL)
SELECT w.id, here AS survivor FROM w LEFT JOIN c ON w.here = c.id WHERE c.duplicate_of_id IS NULL""")
def duplicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record at the end of each customer's chain of up to 39 duplicates."""
    return resolve.last_survivors(demo.view(spark, sf_dir, CHAIN_SQL))


IMPORT_SQL = "SELECT o_orderkey AS sequence, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE concat('Number ', cast(o_custkey AS varchar(20))) END AS name, 'https://shop' || cast(o_custkey AS varchar(20)) || '.co' AS website FROM {orders}"


@query(f"""SELECT count(DISTINCT name) FILTER (WHERE trim(name) <> '') AS created, count(*) FILTER (WHERE trim(name) <> '') - count(DISTINCT name) FILTER (WHERE trim(name) <> '') AS merged,
 count(*) FILTER (WHERE trim(name) = '') AS skipped FROM ({demo.duck(IMPORT_SQL)})""")
def import_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a sheet into an empty table; rows of a customer are one business by their website, names without a city don't meet."""
    typed = demo.view(spark, sf_dir, IMPORT_SQL).select("sequence", "name", "website", *[F.lit(None).cast("string").alias(c) for c in ("city", "phone", "place_id")])
    businesses, _ = leads.import_rows(spark.createDataFrame([], BUSINESS), typed, "demo")
    return leads.import_counts(typed, businesses)


FIRST_SQL = "first({0} ORDER BY id) FILTER (WHERE trim({0}) <> '') AS {0}"


@query(f"SELECT city, business_type, {FIRST_SQL.format('email')}, {FIRST_SQL.format('phone')}, {FIRST_SQL.format('facebook_url')} FROM biz GROUP BY city, business_type")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.biz(spark, sf_dir).select("city", "business_type", "id", "email", "phone", "facebook_url")
    return resolve.merge_set(rows, ["city", "business_type"], [F.col("id")]).drop("id")


ANY_SQL = " + ".join(f"(coalesce({c} <> '', false))::INT" for c in ("website", "email", "phone")) + " + (coalesce(nullif(facebook_url, ''), nullif(whatsapp_number, '')) IS NOT NULL)::INT"


@query(f"SELECT id, CASE WHEN {ANY_SQL} >= 3 THEN 'high' WHEN {ANY_SQL} >= 1 THEN 'medium' ELSE 'low' END AS priority FROM biz")
def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return demo.biz(spark, sf_dir).select("id", scoring.priority(c("website"), c("email"), c("phone"), c("facebook_url"), c("whatsapp_number")).alias("priority"))


FLAG_SQL = "array_to_string(list_sort(list_filter([{0}], lambda x: x IS NOT NULL)), ', ')"


def _flags(column: str, table: dict[str, str]) -> str:
    return FLAG_SQL.format(", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN '{n}' END" for n, p in table.items()))


@query(f"""WITH d AS (SELECT page_id, html AS h, {_flags("html", web.TECHNOLOGIES)} AS technologies, {_flags("html", web.PROVIDERS)} AS providers FROM pages),
f AS (SELECT *, regexp_extract(technologies, 'Magento|Shopify|WooCommerce') AS shop, regexp_matches(h, '(?i){web.CART}') AS cart,
 regexp_matches(h, '(?i){web.CHAT}') AND regexp_matches(h, '(?i){web.CHAT_ORDER}') AS chat, regexp_matches(h, '(?i){web.CALL}') AS phone FROM d)
SELECT page_id, technologies, providers, CASE WHEN shop <> '' OR cart OR chat OR providers <> '' THEN 'online' WHEN phone THEN 'phone' ELSE 'in_person' END AS order_method,
 CASE WHEN shop <> '' OR cart THEN 'Online (Add to Cart / ' || CASE WHEN shop <> '' THEN shop ELSE 'E-Commerce' END || ')' WHEN chat THEN 'WhatsApp Ordering' WHEN providers <> '' THEN 'Delivery Apps (' || providers || ')'
 WHEN phone THEN 'Phone Order' ELSE 'Walk-in / In-Person' END AS order_method_detail, CASE WHEN providers <> '' THEN providers WHEN shop <> '' OR cart THEN 'In-house Delivery' ELSE 'None' END AS delivery_system FROM f""")
def page_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.detect(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", F.array_join("technologies", ", ").alias("technologies"), F.array_join("delivery_providers", ", ").alias("providers"), "ordering.*")


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{web.EMAIL}'))), ' ') AS emails FROM documents")
def text_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(web.emails_in(F.col("text")), " ").alias("emails"))


@query()
def text_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(web.phones_in(F.col("text")), "|").alias("phones"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", web.page_title(F.col("html")).alias("title"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(site.alias("site"), F.col("page_id").alias("page_ordinal"), "url", "html")


@query()
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(site_pages(spark, sf_dir))
    return found.select("site", "page_ordinal", "title", "language", "meta_description", "company_name", F.size("internal_links").alias("n_links"), F.size("emails").alias("n_emails"), "contact_form", "owner_manager_name", "favicon")


@query()
def site_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.combine(pages.extract(site_pages(spark, sf_dir)))
    return found.select("site", "website", "website_type", F.array_join("emails", " ").alias("emails"), F.array_join("phones", " ").alias("phones"), F.array_join("technologies", ", ").alias("technologies"), "order_method", "delivery_system", "pages_crawled")


ERRORS = ["net::ERR_NAME_NOT_RESOLVED at x", "Page.goto: Timeout 25000ms", "HTTP 404 not found", "403 Forbidden", "CERTIFICATE_VERIFY_FAILED", "Connection refused", "something quite unexpected and rather long", None]
ERRORS_SQL = f"SELECT o_orderkey AS k, {demo.pick('o_orderkey', ERRORS)} AS error FROM {{orders}}"
KIND_SQL = "CASE WHEN error IS NULL THEN 'ok' " + " ".join(f"WHEN regexp_matches(lower(error), '{'|'.join(marks)}') THEN '{n}'" for n, marks in web.CRAWL_ERRORS) + " ELSE 'Failed (' || error[1:30] || ')' END"


@query(f"WITH e AS ({demo.duck(ERRORS_SQL)}) SELECT {KIND_SQL} AS reason, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM e) * 100, 2) AS percent FROM e GROUP BY 1")
def crawl_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.failure_report(demo.view(spark, sf_dir, ERRORS_SQL))


ADDRESSES = ["6 Baldwin St, Bristol BS1 1SA, UK", "Mall Rd, Lahore, Pakistan", "x, Southampton, United Kingdom", "Main St 12345", "", None, "a, Abu Dhabi 54000, UAE"]
ADDRESS_SQL = f"SELECT o_orderkey AS k, {demo.pick('o_orderkey', ADDRESSES)} AS address FROM {{orders}}"
PARTS_SQL = "list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '')"
CITY_SQL = "trim(regexp_replace(trim(regexp_replace(parts[-2], '(?i)[A-Z0-9]{2,4}\\s?[A-Z0-9]{2,4}', '', 'g')), '\\b[0-9]{5}\\b', '', 'g'))"


@query(f"""WITH a AS ({demo.duck(ADDRESS_SQL)}), p AS (SELECT *, {PARTS_SQL} AS parts FROM a)
SELECT k, CASE WHEN len(parts) >= 2 AND length({CITY_SQL}) > 2 THEN {CITY_SQL} ELSE 'home' END AS city,
 CASE WHEN regexp_matches(lower(parts[-1]), '{'|'.join(places.COUNTRY_MARKS)}') THEN parts[-1] ELSE 'none' END AS country FROM p""")
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("address")
    return demo.view(spark, sf_dir, ADDRESS_SQL).select("k", places.address_city(a, F.lit("home")).alias("city"), places.address_country(a, F.lit("none")).alias("country"))


@query("SELECT dedupe_key, min(id) AS id FROM (SELECT id, CASE WHEN place_id <> '' THEN 'pid:' || place_id ELSE 'na:' || lower(trim(name)) || '|' || lower(trim(coalesce(city, ''))) END AS dedupe_key FROM biz) GROUP BY 1")
def first_seen_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = places.dedupe_key(F.col("place_id"), F.col("name"), F.col("city"))
    rows = demo.biz(spark, sf_dir).select("id", key.alias("dedupe_key"))
    return sheets.first_seen(rows, F.col("dedupe_key"), F.col("id")).select("dedupe_key", "id")


@query("SELECT id, priority, CASE priority WHEN 'high' THEN 'priority-high' WHEN 'medium' THEN 'priority-medium' ELSE 'priority-low' END AS css, coalesce(nullif(order_method_detail, ''), order_method) AS shown FROM lead")
def lead_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.leads(spark, sf_dir).select("id", "priority", scoring.priority_class(F.col("priority")).alias("css"), F.coalesce(F.nullif("order_method_detail", F.lit("")), "order_method").alias("shown"))


REPLY_SQL = f"""SELECT {demo.text("o_orderkey")} AS id, CASE o_orderkey % 5 WHEN 0 THEN 'no answer' WHEN 1 THEN NULL WHEN 2 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 3 THEN replace(body, '"notes": "', '"notes": 1, "x": "') ELSE body END AS reply
FROM (SELECT o_orderkey, concat('{{{{"order_method": "', o_orderstatus, '", "delivery_system": "Own riders", "automation_status": "Manual", "lead_priority": "', substring(o_orderpriority, 3), '", "notes": "order ', {demo.text("o_orderkey")}, '"}}}}') AS body FROM {{orders}}) b"""


@query(f"""SELECT lead.id, coalesce(a.order_method, 'Unknown') AS order_method_detail, coalesce(a.delivery_system, 'Unknown') AS delivery_system, coalesce(a.automation_status, 'Unknown') AS automation_status_detail,
 lower(coalesce(a.lead_priority, 'Low')) AS priority, coalesce(a.notes, 'Gemini unavailable') AS notes
FROM lead LEFT JOIN (SELECT id, {", ".join(f"j ->> '{k}' AS {k}" for k in leads.FALLBACK)}
 FROM (SELECT id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM (SELECT id, regexp_replace(reply, '^```json\n|\n```$', '', 'g') AS t FROM ({demo.duck(REPLY_SQL)})))
 WHERE json_type(j, '$.notes') = 'VARCHAR') a ON lead.id = a.id""")
def classified_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leads after a model's replies, of which some are fenced, some no JSON and some of another shape."""
    done = leads.classify(demo.leads(spark, sf_dir), leads.answers(demo.view(spark, sf_dir, REPLY_SQL)))
    return done.select("id", "order_method_detail", "delivery_system", "automation_status_detail", "priority", "notes")


@query("SELECT bool_or(automation_status = 'in_progress' OR automation_status_detail IN ('Queued', 'Processing')) AS pending FROM lead")
def any_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = (F.col("automation_status") == "in_progress") | F.coalesce(F.col("automation_status_detail").isin("Queued", "Processing"), F.lit(False))
    return demo.leads(spark, sf_dir).agg(F.bool_or(pending).alias("pending"))


@query("SELECT b.id FROM biz b WHERE NOT EXISTS (SELECT 1 FROM lead l WHERE l.business_id = b.id AND l.call_status = 'interested')")
def businesses_without_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, held = demo.biz(spark, sf_dir).select("id"), demo.leads(spark, sf_dir).where("call_status = 'interested'").select("business_id")
    return b.join(held, b["id"] == held["business_id"], "left_anti")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ingest.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


