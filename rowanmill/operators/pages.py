"""Website pages: extraction, combination by site, and what an enrichment run writes back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import dom, scoring, web
from ..functions.cells import strip, truthy

SHOWN = ("facebook", "instagram", "linkedin", "twitter", "youtube", "tiktok", "whatsapp")


#: Pages, and characters of their markup, that are parsed before their parts are handed on.
PAGES, CHARACTERS = 64, 1 << 20


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in stretches of ``PAGES`` and, beyond a first one, ``CHARACTERS`` at most."""
    begin, held = 0, 0
    for k, size in enumerate(pc.utf8_length(batch.column("html")).to_pylist()):
        if k > begin and (k - begin == PAGES or held + (size or 0) > CHARACTERS):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _told(few: pa.RecordBatch, fields: pa.Schema) -> pa.RecordBatch:
    """``few`` pages with the parts of each; what Python made of them is gone when they are handed on."""
    rows = [dom.raw(source, url) for source, url in zip(few.column("html").to_pylist(), few.column("url").to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([*few.columns, *[pa.array([r[f.name] for r in rows], f.type) for f in fields]], [*few.schema.names, *fields.names])


def _parsed(batches: Iterable[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All pages of ``batches``, a few at a time, each stretch handed on before the next is parsed."""
    for batch in batches:
        for few in _few(batch):
            yield _told(few, fields)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (site, page_ordinal, url, html) with all that is told of each page: one parse in Python, the rules as Columns, and the pattern detectors.

    Python holds the parts of a few pages at a time, whatever the size of Spark's batches.
    """
    schema = f"{', '.join(f'`{n}` {t}' for n, t in pages.dtypes)}, {dom.RAW}"
    fields = to_arrow_schema(T.StructType.fromDDL(dom.RAW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, fields)

    parsed = pages.mapInArrow(run, schema)
    return detect(parsed.select(*[F.col(f"`{c}`") for c in pages.columns], *[v.alias(n) for n, v in dom.contacts().items()]))


def detect(pages: DataFrame) -> DataFrame:
    """Technologies, delivery providers and order method of each page, by built-in functions only."""
    html = F.col("html")
    found = pages.withColumns({"technologies": web.technologies(html), "delivery_providers": web.delivery_providers(html)})
    return found.withColumn("ordering", web.ordering(html, F.col("technologies"), F.col("delivery_providers")))


def combine(pages: DataFrame) -> DataFrame:
    """One row a site from extracted pages: unions of lists, the first page's ordering, the first of all else in page order."""
    at = F.col("page_ordinal")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    first = lambda c, name: F.min_by(c, F.when(c.isNotNull(), at)).alias(name)
    social = [first(F.get(F.col("social_links")[p], F.lit(0)), p) for p in SHOWN]
    rows = pages.groupBy("site").agg(
        *[union(c) for c in ("emails", "phones", "technologies", "delivery_providers")], first(F.col("owner_manager_name"), "owner_manager_name"), first(F.col("contact_page"), "contact_page"),
        F.bool_or("contact_form").alias("contact_form"), *social, F.min_by("ordering", "page_ordinal").alias("ordering"), F.min_by("url", "page_ordinal").alias("website"), F.count("*").cast("int").alias("pages_crawled"),
    )
    alone = web.social_site(web.with_scheme(F.col("site")))
    providers = F.array_join("delivery_providers", ", ")
    name = F.concat(F.upper(F.left(alone, F.lit(1))), F.substring(alone, 2, 100))
    return rows.select(
        "site", F.lit("success").alias("status"), "website", F.when(alone.isNotNull(), "Social Only").otherwise("Website").alias("website_type"), "emails", "phones", "owner_manager_name", "contact_page", "contact_form",
        F.struct(*SHOWN).alias("social_links"), F.when(alone.isNotNull(), F.array_sort(F.array_union("technologies", F.array(F.lit("Social Only"))))).otherwise(F.col("technologies")).alias("technologies"), "delivery_providers",
        F.col("ordering.order_method").alias("order_method"), F.when(alone.isNotNull(), F.concat(F.lit("Social Only ("), name, F.lit(")"))).otherwise(F.col("ordering.order_method_detail")).alias("order_method_detail"),
        F.when(F.size("delivery_providers") > 0, providers).otherwise(F.col("ordering.delivery_system")).alias("delivery_system"), "pages_crawled",
    )


def sub_pages(contact: Column, about: Column, base: Column) -> Column:
    """The pages to fetch next: contact and about page where they are others than the first, two at most, in order of address."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.array(contact, about), lambda u: u.isNotNull() & (u != base)))), 1, 2)


def enrich(businesses: DataFrame, sites: DataFrame, fill_phone: bool = False, name_type: bool = True) -> DataFrame:
    """Businesses with blanks filled from their site, and the lead fields that follow; keys are left as they were.

    The queued form leaves phones alone and notes the website's type, the direct one does the reverse.
    """
    s = sites.select([F.col(c).alias(f"s_{c}") for c in sites.columns])
    rows = businesses.join(s, web.with_scheme(F.col("website")) == web.with_scheme(F.col("s_site")), "left")
    fill = {"email": F.get("s_emails", F.lit(0)), "owner_manager_name": F.col("s_owner_manager_name"), "contact_page_url": F.col("s_contact_page")}
    fill |= {f"{p}_url": F.col(f"s_social_links.{p}") for p in ("facebook", "instagram", "linkedin")} | {"whatsapp_number": F.col("s_social_links.whatsapp")}
    if fill_phone:
        fill["phone"] = F.get("s_phones", F.lit(0))
    rows = rows.withColumns({c: F.when(truthy(F.col(c)), F.col(c)).otherwise(v) for c, v in fill.items()})
    note = lambda label, v: F.when(v != "", F.concat(F.lit(f"{label}: "), v))
    notes = [note("Tech", F.array_join("s_technologies", ", ")), note("Delivery", F.array_join("s_delivery_providers", ", ")), note("Owner/Manager", F.col("s_owner_manager_name"))]
    notes = ([note("Type", F.col("s_website_type"))] if name_type else []) + notes
    done = F.col("s_status") == "success"
    score = scoring.priority(F.col("website"), F.col("email"), F.col("phone"), F.col("facebook_url"), F.col("instagram_url"), F.col("whatsapp_number"))
    lead = {
        "order_method": F.col("s_order_method"), "order_method_detail": F.col("s_order_method_detail"), "delivery_system": F.col("s_delivery_system"), "priority": F.when(done, score),
        "notes": F.when(done, F.nullif(F.concat_ws(" | ", *notes), F.lit(""))), "automation_status": F.when(done, "completed").otherwise("in_progress"), "automation_status_detail": F.when(done, "Completed").otherwise(F.when(truthy(strip(F.col("website"))), "Queued").otherwise("Skipped (No Website)")),
    }
    return rows.withColumns(lead).drop(*s.columns)


def failure_report(runs: DataFrame) -> DataFrame:
    """Runs by reason, with the share of all in percent."""
    reason = F.when(F.col("error").isNull(), "ok").otherwise(web.crawl_error(F.col("error")))
    counts = runs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    total = runs.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", F.bround(F.col("n") / F.col("total") * 100, 2).alias("percent"))
