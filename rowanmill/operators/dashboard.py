"""The weekly dashboard: one pass of conditional counts for each dimension, zero-filled from the tracked values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import strip, title, truthy
from ..schema import BUSINESS_TYPES, COUNTRIES, INTERNS, WEEKLY_TARGET, interns, labels

# Names of countries in the data.
COUNTRY_NAMES = {
    "United Kingdom": ("uk", "united kingdom", "great britain", "england"),
    "United Arab Emirates": ("uae", "united arab emirates"),
    "Pakistan": ("pk", "pakistan"),
    "Saudi Arabia": ("saudi arabia", "ksa"),
    "United States": ("usa", "us", "united states", "united states of america"),
}


def country_name(raw: Column) -> Column:
    """The country's usual name, the text in title case if it isn't known, 'Unspecified' if there is none."""
    text = strip(raw)
    known = F.coalesce(*[F.when(F.lower(text).isin(*names), country) for country, names in COUNTRY_NAMES.items()])
    return F.when(truthy(raw), F.coalesce(known, title(text))).otherwise("Unspecified")


def city_owners(dim: DataFrame) -> DataFrame:
    """One row a city in lower case with the first intern that owns it."""
    cities = dim.select("ordinal", "intern", F.explode("cities").alias("city"))
    return cities.groupBy(F.lower("city").alias("owned_city")).agg(F.min_by("intern", "ordinal").alias("owner"))


def city_list(dim: DataFrame) -> DataFrame:
    """One row a city of the interns, in display order."""
    cities = dim.select("ordinal", "intern", "country", F.posexplode("cities").alias("place", "city"))
    return cities.select("city", "intern", "country", "ordinal", "place").orderBy("ordinal", "place")


def attributed(leads: DataFrame, businesses: DataFrame) -> DataFrame:
    """Leads of businesses that are no duplicates: week_number, country, business_type, intern.

    ``leads`` needs business_id and week_number; the dimension is a constant of 16 rows, so it is broadcast.
    """
    live = businesses.where(~F.col("is_duplicate")).select("id", "country", "business_type", "city", "assigned_to")
    rows = leads.select("business_id", "week_number").join(live, F.col("business_id") == F.col("id"))
    owners = F.broadcast(city_owners(interns(leads.sparkSession)))
    rows = rows.join(owners, F.lower(strip(F.col("city"))) == F.col("owned_city"), "left")
    kind = strip(F.when(truthy(F.col("business_type")), F.col("business_type")).otherwise("Unspecified"))
    return rows.select("week_number", country_name(F.col("country")).alias("country"), kind.alias("business_type"), F.coalesce(F.nullif("assigned_to", F.lit("")), "owner").alias("intern"))


def _this_week(week: int) -> Column:
    return F.count_if(F.coalesce(F.col("week_number") == week, F.lit(False)))


def _tracked_first(counts: DataFrame, tracked: tuple[str, ...], name: str, numbers: list[str]) -> DataFrame:
    """Tracked values in their order, then others by code point; missing counts are 0."""
    dim = F.broadcast(labels(counts.sparkSession, tracked, "tracked"))
    rows = counts.where(F.col(name).isNotNull()).join(dim, F.col(name) == F.col("tracked"), "full")
    filled = [F.coalesce(n, F.lit(0)).alias(n) for n in numbers]
    return rows.select(F.coalesce("ordinal", F.lit(len(tracked))).alias("ordinal"), F.coalesce(name, "tracked").alias(name), *filled).orderBy("ordinal", name)


def by_country(rows: DataFrame, week: int) -> DataFrame:
    counts = rows.groupBy("country").agg(_this_week(week).alias("leads_this_week"), F.count("*").alias("total_leads"))
    return _tracked_first(counts, COUNTRIES, "country", ["leads_this_week", "total_leads"])


def by_business_type(rows: DataFrame) -> DataFrame:
    return _tracked_first(rows.groupBy("business_type").agg(F.count("*").alias("total_leads")), BUSINESS_TYPES, "business_type", ["total_leads"])


def intern_target(team_target: int = WEEKLY_TARGET) -> int:
    """Each intern's share of the goal, rounded up."""
    return math.ceil(team_target / len(INTERNS))


def by_intern(rows: DataFrame, week: int, team_target: int = WEEKLY_TARGET) -> DataFrame:
    """The interns only, each with the week's count; others count in the headline alone."""
    target = intern_target(team_target)
    counts = rows.where(F.col("week_number") == week).groupBy(F.col("intern").alias("who")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    dim = interns(rows.sparkSession).join(counts, F.col("intern") == F.col("who"), "left")
    return dim.select("ordinal", "intern", F.array_join("cities", " + ").alias("cities"), n.alias("leads_this_week"), F.lit(target).alias("target_per_week"), (n >= target).alias("on_track"), F.greatest(target - n, F.lit(0)).alias("shortfall")).orderBy("ordinal")


def _percent(n: Column, team_target: int) -> Column:
    return F.bround(n / team_target * 100, 1) if team_target > 0 else F.lit(0.0)


def headline(rows: DataFrame, week: int, team_target: int = WEEKLY_TARGET) -> DataFrame:
    """One row: the week's total against the target; the percentage is rounded half to even."""
    total = rows.agg(_this_week(week).alias("total_leads_this_week"))
    n = F.col("total_leads_this_week")
    return total.select(F.lit(week).alias("week_number"), n, F.lit(team_target).alias("weekly_target"), _percent(n, team_target).alias("percent_of_target"), F.greatest(team_target - n, F.lit(0)).alias("leads_still_needed"))


# Which of country, business_type and intern a row of ``all_counts`` has, as grouping_id() tells it.
BY_COUNTRY, BY_TYPE, BY_INTERN, IN_ALL = 3, 5, 6, 7


def all_counts(rows: DataFrame, week: int) -> DataFrame:
    """table, name, ordinal, cities, leads_this_week, total_leads of every table of the dashboard in one pass over ``rows``.

    Leads are counted by their three attributes first, so that grouping sets repeat those few counts and not the leads.
    Tracked values are added with counts of 0; others have no ordinal, and untracked interns are left to the sum of all.
    """
    spark, names = rows.sparkSession, ("country", "business_type", "intern")
    cells = rows.groupBy(*names).agg(_this_week(week).alias("w"), F.count("*").alias("t"))
    sets = cells.groupingSets([[F.col(n)] for n in names] + [[]], *names)
    found = sets.agg(F.grouping_id().cast("int").alias("table"), F.sum("w").alias("w"), F.sum("t").alias("t"))
    name = F.when(F.col("table") == BY_COUNTRY, F.col("country")).when(F.col("table") == BY_TYPE, F.col("business_type")).when(F.col("table") == BY_INTERN, F.col("intern")).otherwise("")
    found = found.select("table", name.alias("name"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("cities"), "w", "t")
    tracked = [(BY_COUNTRY, n, i, None, 0, 0) for i, n in enumerate(COUNTRIES)] + [(BY_TYPE, n, i, None, 0, 0) for i, n in enumerate(BUSINESS_TYPES)]
    tracked += [(BY_INTERN, n, i, " + ".join(c), 0, 0) for i, (n, c, _) in enumerate(INTERNS)] + [(IN_ALL, "", 0, None, 0, 0)]
    both = found.unionByName(spark.createDataFrame(tracked, "table int, name string, ordinal int, cities string, w long, t long"))
    sums = both.where(F.col("name").isNotNull()).groupBy("table", "name").agg(F.max("ordinal").alias("ordinal"), F.max("cities").alias("cities"), F.sum("w").alias("leads_this_week"), F.sum("t").alias("total_leads"))
    last = F.when(F.col("table") == BY_COUNTRY, len(COUNTRIES)).when(F.col("table") == BY_TYPE, len(BUSINESS_TYPES))
    return sums.withColumn("ordinal", F.coalesce("ordinal", last)).where(F.col("ordinal").isNotNull())


def layout(rows: DataFrame, week: int, generated: str, team_target: int = WEEKLY_TARGET) -> DataFrame:
    """The dashboard as sheet rows: ordinal and cells, with titles and blank rows between the sections."""
    text = lambda c: F.col(c).cast("string")
    lines = {
        0: (["Weekly Lead Generation Dashboard"], [f"Week {week} — generated {generated} UTC"], [], ["This Week's Total Leads", "Weekly Target", "% of Target Reached", "Leads Still Needed"]),
        2: ([], ["Leads by Country (this week)"], ["Country", "Leads This Week", "Total Leads (all time)"]),
        4: ([], ["Leads by Intern (this week)"], ["Intern", "Cities", "Leads This Week", "Target/Week", "On Track?"]),
        6: ([], ["Leads by Business Type (all time)"], ["Business Type", "Total Leads"]),
    }
    fixed = rows.sparkSession.createDataFrame([(s, i, "", line) for s, part in lines.items() for i, line in enumerate(part)], "section int, ordinal int, name string, cells array<string>")
    n, target = F.col("leads_this_week"), intern_target(team_target)
    percent = F.concat(F.regexp_replace(_percent(n, team_target).cast("string"), r"\.0$", ""), F.lit("%"))
    cells = {
        IN_ALL: (F.lit(1), F.array(text("leads_this_week"), F.lit(str(team_target)), percent, F.greatest(team_target - n, F.lit(0)).cast("string"))),
        BY_COUNTRY: (F.lit(3), F.array("name", text("leads_this_week"), text("total_leads"))),
        BY_INTERN: (F.lit(5), F.array("name", "cities", text("leads_this_week"), F.lit(str(target)), F.when(n >= target, "Yes").otherwise("No"))),
        BY_TYPE: (F.lit(7), F.array("name", text("total_leads"))),
    }
    of = lambda k: F.coalesce(*[F.when(F.col("table") == table, part[k]) for table, part in cells.items()])
    body = all_counts(rows, week).select(of(0).alias("section"), "ordinal", "name", of(1).alias("cells"))
    return fixed.unionByName(body).orderBy("section", "ordinal", "name")


def as_json(rows: DataFrame, week: int, team_target: int = WEEKLY_TARGET) -> DataFrame:
    """The dashboard as one row with a nested JSON text; the lists are as short as the dimensions."""
    n, target = F.col("leads_this_week"), intern_target(team_target)
    shown = {
        "by_country": (BY_COUNTRY, [F.col("name").alias("country"), n, F.col("total_leads")]),
        "by_intern": (BY_INTERN, [F.col("name").alias("intern"), F.col("cities"), n, F.lit(target).alias("target_per_week"), (n >= target).alias("on_track"), F.greatest(target - n, F.lit(0)).alias("shortfall")]),
        "by_business_type": (BY_TYPE, [F.col("name").alias("business_type"), F.col("total_leads")]),
    }

    def listed(table: int, fields: list[Column]) -> Column:
        item = F.struct("ordinal", F.col("name").alias("_k"), F.struct(*fields).alias("v"))
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("table") == table, item))), lambda x: x["v"])

    total = F.max(F.when(F.col("table") == IN_ALL, n))
    head = F.struct(total.alias("total_leads_this_week"), F.lit(team_target).alias("weekly_target"), _percent(total, team_target).alias("percent_of_target"), F.greatest(team_target - total, F.lit(0)).alias("leads_still_needed"))
    whole = all_counts(rows, week).agg(head.alias("headline"), *[listed(*part).alias(name) for name, part in shown.items()])
    return whole.select(F.to_json(F.struct(F.lit(week).alias("week_number"), "headline", *shown)).alias("dashboard"))
