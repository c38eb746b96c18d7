"""Text of map listings: keys, place ids, addresses, ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import strip, truthy

# What marks the last part of an address as a country.
COUNTRY_MARKS = ("uk", "united kingdom", "pakistan", "usa", "united states", "us", "uae")


def dedupe_key(place_id: Column, name: Column, address: Column) -> Column:
    """The place id, or name and address, in a form that can't meet."""
    plain = lambda x: F.lower(strip(F.coalesce(x, F.lit(""))))
    return F.when(truthy(place_id), F.concat(F.lit("pid:"), place_id)).otherwise(F.concat(F.lit("na:"), plain(name), F.lit("|"), plain(address)))


def place_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "!1s([^!]+)", 1), F.lit(""))


def address_city(address: Column, fallback: Column) -> Column:
    """The last part but one without postcodes; the postcode pattern also takes plain words, which is kept as it is."""
    parts = F.filter(F.transform(F.split(address, ","), strip), lambda p: p != "")
    rest = strip(F.regexp_replace(F.get(parts, F.size(parts) - 2), r"(?i)[A-Z0-9]{2,4}\s?[A-Z0-9]{2,4}", ""))
    rest = strip(F.regexp_replace(rest, r"\b\d{5}\b", ""))
    return F.when(truthy(address) & (F.size(parts) >= 2) & (F.length(rest) > 2), rest).otherwise(fallback)


def address_country(address: Column, fallback: Column) -> Column:
    parts = F.filter(F.transform(F.split(address, ","), strip), lambda p: p != "")
    last = F.get(parts, F.size(parts) - 1)
    marked = reduce(lambda a, b: a | b, [F.lower(last).contains(m) for m in COUNTRY_MARKS])
    return F.when(truthy(address) & marked, last).otherwise(fallback)


def rating(text: Column) -> Column:
    return F.replace(strip(text), F.lit(","), F.lit(".")).try_cast("double")


def review_count(label: Column) -> Column:
    return F.regexp_replace(label, r"(?U)\D", "").try_cast("int")


def without_label(text: Column, prefix: str) -> Column:
    return strip(F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text))


def query_text(category: Column, city: Column, country: Column) -> Column:
    """What is searched for, '<category> in <city>, <country>'."""
    return F.concat(category, F.lit(" in "), F.concat_ws(", ", city, F.nullif(country, F.lit(""))))
