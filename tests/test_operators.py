import csv
import io
import json
import random
import time
import tracemalloc
from datetime import date, datetime
from functools import reduce

import plain
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowanmill import schema
from rowanmill.functions import dom
from rowanmill.operators import dashboard, export, leads, pages, resolve
from rowanmill.sources import sheets, sinks
from rowanmill.sources.tables import Conflict, Table, changed, cut
from rowanmill.streaming import ingest

AT = datetime(2024, 1, 1)


def businesses(spark, *rows):
    names = [f.split()[0] for f in schema.BUSINESS.split(", ")]
    made = [{"id": str(i), "is_duplicate": False, "created_at": datetime(2024, 1, 1, 0, i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([[r.get(n) for n in names] for r in made], schema.BUSINESS)


def flags(df):
    return {r["id"]: r["duplicate_of_id"] for r in df.collect()}


def test_fold_rules(spark):
    df = businesses(
        spark,
        {"name": "Wah Yan Hong", "city": "Bristol", "phone": "0117 952 4240"},
        {"name": "Wah Yan Hong Supermarket", "city": "Bristol", "website": "https://wyh.com"},
        {"name": "Something Else", "city": "Bristol", "website": "www.wyh.com/x"},
        {"name": "Wah Yan Hong", "city": "Leeds"},
        {"name": "Tesco Express", "city": "Leeds", "phone": "0345 026 7789"},
        {"name": "Tesco Metro Big", "city": "Leeds", "phone": "0345 026 7789"},
        {"name": "A B C", "city": "Leeds", "place_id": "p1"},
        {"name": "A B C", "city": "Leeds", "place_id": "p2"},
        {"name": "Far away", "city": "York", "place_id": "p1"},
    )
    assert flags(resolve.resolve(df)) == {"0": None, "1": "0", "2": "0", "3": None, "4": None, "5": None, "6": None, "7": None, "8": "6"}
    assert flags(resolve.resolve(df, sweep=True)) == flags(resolve.resolve(df))


def test_merge_fills_blanks_only(spark):
    df = businesses(spark, {"name": "Shop One Two", "city": "X", "email": " ", "address": "here"}, {"name": "One Two", "city": "X", "email": "a@b.co", "address": "there", "rating": 4.5})
    kept = resolve.resolve(df).where("id = '0'").first()
    assert (kept["email"], kept["address"], kept["rating"]) == ("a@b.co", "here", 4.5)


def test_fold_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [{"name": f"{rng.choice(['Blue', 'Red', 'Old'])} {rng.choice(['Corner', 'Mill', 'Garden'])} {rng.choice(['Shop', 'Ltd', 'House'])}", "city": rng.choice(["A", "B", None]), "phone": rng.choice([None, "0117 952 4240", "0117 952 4241"]), "place_id": rng.choice([None, None, "x", "y"])} for _ in range(50)]
    df = businesses(spark, *rows)
    assert flags(resolve.resolve(df.repartition(7))) == flags(resolve.resolve(df.coalesce(1)))


def test_upsert_twice_changes_nothing(spark):
    old = businesses(spark, {"name": "Shop One Two", "city": "X"})
    new = businesses(spark, {"id": "n1", "name": "One Two Ltd", "city": "X", "email": "a@b.co"}, {"id": "n2", "name": "Other Thing", "city": "X"})
    once = resolve.upsert(old, new).select(*old.columns)
    twice = resolve.upsert(once, new.withColumn("id", F.concat(F.lit("again"), "id"))).select(*old.columns)
    assert once.count() == 2 and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_import_keeps_first_business_and_last_lead(spark):
    rows = [(1, "Corner Shop One", "Bristol", None, "high"), (2, "Corner One", "Bristol", "a@b.co", None), (3, " ", "Bristol", None, None)]
    typed = spark.createDataFrame(rows, "sequence long, name string, city string, email string, priority string")
    found, new = leads.import_rows(businesses(spark).limit(0), typed, "b1")
    assert [(r["name"], r["email"]) for r in found.collect()] == [("Corner Shop One", "a@b.co")]
    assert [r["priority"] for r in new.collect()] == [None]


def test_partial_update(spark):
    df = spark.createDataFrame([("1", "a", 3), ("2", "b", 4)], "id string, notes string, week_number int")
    patch = spark.createDataFrame([("1", {"week_number": "7", "notes": None})], "id string, fields map<string,string>")
    assert {tuple(r) for r in leads.update(df, patch).collect()} == {("1", None, 7), ("2", "b", 4)}


def test_dashboard_zero_fill_and_order(spark):
    rows = spark.createDataFrame([(12, "Spain", "Bakery", "Haifa"), (11, "Pakistan", "Bakery", None), (None, "Spain", "Supermarket", "Guest")], "week_number int, country string, business_type string, intern string")
    assert [tuple(r)[1:] for r in dashboard.by_country(rows, 12).collect()] == [("United Kingdom", 0, 0), ("United Arab Emirates", 0, 0), ("Pakistan", 0, 1), ("Saudi Arabia", 0, 0), ("Spain", 1, 2)]
    who = dashboard.by_intern(rows, 12).collect()
    assert [r["intern"] for r in who] == [n for n, _, _ in schema.INTERNS] and sum(r["leads_this_week"] for r in who) == 1
    empty = dashboard.headline(rows.limit(0), 12).first()
    assert (empty["total_leads_this_week"], empty["leads_still_needed"], empty["percent_of_target"]) == (0, 100, 0.0)


def test_dashboard_reads_and_joins_once(spark):
    shops = businesses(spark, {"id": "a", "country": "uk", "business_type": "Bakery", "city": "Lahore"}, {"id": "b", "country": "Spain", "assigned_to": "Guest"}, {"id": "c", "is_duplicate": True})
    leads_ = spark.createDataFrame([("a", 12), ("a", None), ("b", 12), ("c", 12)], "business_id string, week_number int")
    rows = dashboard.attributed(leads_, shops)
    for made in (dashboard.layout(rows, 12, "now"), dashboard.as_json(rows, 12)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1 and plan.count("Join LeftOuter") == 1
    told = json.loads(dashboard.as_json(rows, 12).first()["dashboard"])
    assert told["headline"]["total_leads_this_week"] == 2 and sum(r["leads_this_week"] for r in told["by_intern"]) == 1
    assert [tuple(r.values()) for r in told["by_country"]] == [tuple(r)[1:] for r in dashboard.by_country(rows, 12).collect()]
    assert [tuple(r.values()) for r in told["by_business_type"]] == [tuple(r)[1:] for r in dashboard.by_business_type(rows).collect()]
    assert [tuple(r.values()) for r in told["by_intern"]] == [tuple(r)[1:] for r in dashboard.by_intern(rows, 12).collect()]
    none = json.loads(dashboard.as_json(rows.limit(0), 12).first()["dashboard"])
    assert none["headline"]["leads_still_needed"] == 100 and len(none["by_country"]) == len(schema.COUNTRIES)


def test_sheet_row(spark):
    lead = spark.createDataFrame([("l", "b", None, "phone", "", None, "not_started", None, "high", None, "no_answer", date(2026, 8, 3), 30, None, AT)], schema.LEAD)
    shop = businesses(spark, {"id": "b", "name": " A, \"B\" ", "facebook_url": " f ", "whatsapp_number": "9", "rating": 5.0, "website": " "})
    row = export.sheet_row(export.joined(lead, shop, "left")).first()
    assert row["Business Name"] == 'A, "B"' and row["Social Media Links"] == "f | wa.me/9" and row["Google Rating"] == "5.0"
    assert (row["Lead ID"], row["Website Available"], row["Order Method"], row["Call Status"], row["Follow-up Date"]) == ("", "No", "Phone", "No Answer", "2026-08-03")


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([('say "x", y', None), ("é", "b")], "a string, b string").coalesce(1)
    assert sinks.write_named_csv(df, str(tmp_path / "x.csv")) == 2
    assert (tmp_path / "x.csv").read_bytes() == 'a,b\r\n"say ""x"", y",\r\né,b\r\n'.encode("utf-8-sig")
    sheet = sheets.read_sheet(spark, str(tmp_path / "x.csv"))
    assert [f.metadata["header"] for f in sheet.schema] == ["a", "b"] and [tuple(r) for r in sheet.collect()] == [('say "x", y', ""), ("é", "b")]


def test_sheet_reading(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('BUSINESS NAME ,Phone,Phone Number,Other,Priority\r\n"Two\nlines",1,0117 952 4240,z,HIGH\r\n,,,,\r\n', encoding="utf-8-sig")
    fields = sheets.sheet_fields(sheets.read_sheet(spark, str(path)))
    assert fields.columns == ["name", "phone", "priority"] and fields.count() == 2
    typed = sheets.typed_rows(fields).collect()
    assert (typed[0]["name"], typed[0]["phone"], typed[0]["priority"]) == ("Two\nlines", "0117 952 4240", "high") and typed[1]["name"] is None
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        sheets.read_sheet(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("seed,end,split", [(1, "\n", 40), (2, "\r\n", 30), (3, "\n", 200)])
def test_split_sheet_equals_one_task(spark, tmp_path, seed, end, split):
    rng = random.Random(seed)
    cells = ["", "x", "two words", "é", 'in "quotes"', "a,b", f"line{end}break", "\n", '"', '""', "end,\n,", "x" * 90]
    rows = [[rng.choice(cells) for _ in range(3)] for _ in range(60)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if c and (set(c) & set('",\r\n') or rng.random() < 0.2) else c
    made = [",".join(map(quoted, r)) for r in rows]
    made[10:10] = ["", 'stray "quote,b,c', "only one", "1,2,3,4"]
    (tmp_path / "s.csv").write_bytes(end.join(['a,"b', 'c",d', *made, ""]).encode("utf-8-sig"))
    path = str(tmp_path / "s.csv")
    one = [tuple(r) for r in sheets.read_sheet(spark, path).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        sheet = sheets.read_sheet(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = [tuple(r) for r in sheet.collect()]
        placed = sheet.withColumn("at", F.monotonically_increasing_id()).orderBy("at").drop("at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == one and [tuple(r) for r in placed] == one and len(one) > 55
    assert [f.metadata["header"] for f in sheet.schema] == ["a", "b\nc", "d"]


def test_audit(spark, tmp_path):
    with pytest.raises(RuntimeError):
        sinks.audited(spark, str(tmp_path / "runs"), "1", "test", lambda: (_ for _ in ()).throw(RuntimeError("no disk")))
    sinks.audited(spark, str(tmp_path / "runs"), "2", "test", lambda: 5)
    with pytest.raises(KeyboardInterrupt):  # as if the job were killed
        sinks.audited(spark, str(tmp_path / "runs"), "3", "test", lambda: (_ for _ in ()).throw(KeyboardInterrupt()))
    events = spark.read.parquet(str(tmp_path / "runs"))
    assert events.where("status = 'running' AND finished_at IS NULL").count() == 3
    assert {(r["id"], r["status"], r["rows_written"], r["error"]) for r in sinks.latest_runs(events).collect()} == {("1", "failed", 0, "RuntimeError: no disk"), ("2", "success", 5, None), ("3", "running", 0, None)}


PAGE = """<html lang="en"><head><title> My Shop </title><meta name="author" content="Ali Ahmed"><meta name=generator content="WordPress 6"></head><body>
<a href="mailto:Info%40shop.co?x=1">mail</a><a href="tel:+44 117 952 4240">call</a><a href="/contact">Contact</a><a href="https://facebook.com/myshop/">f</a><a href="https://www.facebook.com/sharer/x">s</a>
<form><input name="first_name"><input type=hidden name=t></form><script>var a = "no@script.co"</script><p>write to sales&#64;shop.co or png@x.png. add to cart</p></body></html>"""


def told(spark, *sources, url="https://s.co/"):
    rows = spark.createDataFrame([(i, url, h) for i, h in enumerate(sources)], "page_ordinal int, url string, html string")
    return [r.asDict() for r in pages.extract(rows).orderBy("page_ordinal").collect()]


def test_page(spark):
    page, upper, lower = told(spark, PAGE, "<p>Founder: Ali Ahmed</p>", "<p>founder: Ali Ahmed</p>")
    assert page["emails"] == ["Info@shop.co", "sales@shop.co"] and page["phones"] == ["+44 117 952 4240"]
    assert page["owner_manager_name"] == "Ali Ahmed" and page["contact_page"] == "https://s.co/contact"
    assert page["social_links"] == {"facebook": ["https://facebook.com/myshop"]} and page["form_fields"] == ["First Name"]
    assert page["internal_links"] == ["https://s.co/contact"] and page["title"] == "My Shop" and page["language"] == "en" and page["meta"]["author"] == "Ali Ahmed"
    assert upper["owner_manager_name"] is None and lower["owner_manager_name"] == "Ali Ahmed"


def test_page_parts(spark):
    source = """<head><meta property="og:title" content=" T "><meta name="Description" content="d1"><meta name="description" content=" d2 "><meta name="twitter:card" content="x"><meta http-equiv="content-language" content="ur">
<link rel="shortcut icon" href="/f.ico"><link rel="icon" sizes="192x192" href="big.png"><link rel="canonical" href="https://s.co/a"><script type="application/ld+json">[{"owner": [{"name": "our team"}, {"name": "Sara Khan"}]}]</script></head>
<div itemprop="name"> Corner Shop </div><span itemprop="telephone" content="0117 952 4240"></span><div itemprop="logo"><img src="/logo.png"></div><p>12 High Street, Bristol</p><a href="about-us">Who we are</a>
<a href="https://instagram.com/x">short</a><a href="https://instagram.com/shop/">i</a><a href="https://WWW.facebook.com/profile.php?id=7#top">f</a><a href="//wa.me/4411795?text=1">w</a><a href="mailto:ab%40b.co.uk">m</a><a href="mailto:image@b.co">m</a><a href="mailto:x@y@z.co">m</a>
<form><select name="order-type"></select><input type="SUBMIT" name="go"><textarea placeholder="your message"></textarea></form><form><input name="other"></form><p>© 2024 Corner</p><p>call 2024-01-02 or 192 168 1 10 or 1111111 or Info@B.co and info@b.co</p>"""
    page = told(spark, source)[0]
    assert page["emails"] == ["Info@B.co", "ab@b.co.uk"] and page["phones"] == ["0117 952 4240"] and page["owner_manager_name"] == "Sara Khan" and page["contact_form"]
    assert page["social_links"] == {"facebook": ["https://WWW.facebook.com/profile.php?id=7"], "instagram": ["https://instagram.com/shop"], "whatsapp": ["https://wa.me/4411795"]}
    assert page["form_fields"] == ["Order Type", "Your Message"] and page["about_page"] == "https://s.co/about-us" and page["postal_address"] == "12 High Street, Bristol"
    assert (page["open_graph"], page["twitter"], page["meta_description"], page["language"]) == ({"og:title": "T"}, {"twitter:card": "x"}, "d2", "ur")
    assert (page["company_name"], page["logo"], page["favicon"], page["canonical_url"], page["copyright"]) == ("Corner Shop", "https://s.co/logo.png", "https://s.co/f.ico", None, "© 2024 Corner")
    blank = told(spark, None, "", "<p>", url=None)
    assert all(p["emails"] == p["phones"] == [] and p["social_links"] == {} and p["owner_manager_name"] is None and not p["contact_form"] for p in blank)


def test_pages_are_parsed_a_few_at_a_time():
    """Stretches have few pages and little markup, also of long pages, nulls and a batch that is itself a slice."""
    for sizes in ([10] * 300, [pages.CHARACTERS] * 3 + [None, 5], [pages.CHARACTERS + 1], [], [None] * 70):
        texts = [None if n is None else "x" * n for n in sizes]
        batch = pa.RecordBatch.from_arrays([pa.array(["before", *texts], pa.string()), pa.array(range(len(texts) + 1))], names=["html", "k"]).slice(1)
        parts = [p.to_pylist() for p in pages._few(batch)]
        assert [r for p in parts for r in p] == batch.to_pylist() and all(0 < len(p) <= 64 for p in parts)
        assert all(len(p) == 1 or sum(len(r["html"] or "") for r in p) <= pages.CHARACTERS for p in parts)


def parsing(n: int) -> tuple[int, int, int]:
    """Pages handed on, most that were parsed and not yet handed on, and the most bytes of Python while a batch of ``n`` pages is parsed."""
    batch = pa.RecordBatch.from_pydict({"url": ["https://s.co"] * n, "html": ["<a href=/x>a</a><p>text</p>" * 40] * n})
    fields, raw, parsed, handed, ahead = to_arrow_schema(T.StructType.fromDDL(dom.RAW)), dom.raw, 0, 0, 0

    def counted(*page):
        nonlocal parsed, ahead
        parsed += 1
        ahead = max(ahead, parsed - handed)
        return raw(*page)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(dom, "raw", counted)
        tracemalloc.start()
        for part in pages._parsed([batch], fields):
            handed += part.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    return handed, ahead, peak


def test_memory_of_the_parse_does_not_grow_with_the_batch(spark):
    """A stretch is handed on before the next is parsed, and nothing of it is kept in Python: 15 stretches take what one takes."""
    parsing(64)
    (_, _, one), (handed, ahead, many) = parsing(64), parsing(960)
    assert handed == 960 and ahead <= pages.PAGES and many < 1.3 * one


def test_sites(spark):
    rows = spark.createDataFrame([("s.co", 1, "https://s.co", PAGE), ("s.co", 2, "https://s.co/contact", "<p>zomato a.b@shop.co</p>")], "site string, page_ordinal int, url string, html string")
    sites = pages.combine(pages.extract(rows))
    got = sites.first()
    assert got["emails"] == ["Info@shop.co", "a.b@shop.co", "sales@shop.co"] and got["technologies"] == ["WordPress"]
    assert (got["order_method"], got["order_method_detail"], got["delivery_system"], got["pages_crawled"]) == ("online", "Online (Add to Cart / E-Commerce)", "Zomato", 2)
    done = pages.enrich(businesses(spark, {"name": "x", "website": "s.co"}, {"name": "y"}), sites).orderBy("id").collect()
    assert (done[0]["email"], done[0]["priority"], done[0]["automation_status"]) == ("Info@shop.co", "high", "completed")
    assert done[1]["automation_status_detail"] == "Skipped (No Website)"


def test_stream_equals_batch(spark, tmp_path):
    new = businesses(spark, {"id": "n1", "name": "One Two Ltd", "city": "X", "email": "a@b.co"}, {"id": "n2", "name": "Other Thing", "city": "X"})
    old = businesses(spark, {"name": "Shop One Two", "city": "X"})
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), schema.BUSINESS)
    table = Table(spark, str(tmp_path / "t"), schema.BUSINESS)
    ingest.upsert_stream(spark, stream, old, table, str(tmp_path / "cp")).awaitTermination()
    got = table.read()
    assert table.notes == {"batch": 0} and table.number == 2
    assert sorted(map(str, got.collect())) == sorted(map(str, resolve.upsert(old, new).select(*old.columns).collect()))


def sequential(rows, sweep):
    """The fold over all whole records at once, in order of age."""
    rows = [dict(r) for r in sorted(rows, key=lambda r: (r["created_at"], r["id"]))]
    plain.fold(rows, sweep)
    return {r["id"]: r for r in rows}


def told(r):
    return (r["is_duplicate"], r["duplicate_of_id"], r["name_key"], r["phone_key"], r["domain_key"], *[r[c] for c in resolve.FILLED])


@pytest.mark.parametrize("sweep", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_fold_of_components_equals_one_fold(spark, sweep, seed):
    rng = random.Random(seed)
    words = ["blue", "corner", "shop", "garden", "gardens", "old", "mill", "ltd", "hong", "wah", "bq", "baqer", "bager", "mohebi", "ab", "abc"]
    some = lambda *x: rng.choice([None, *x])
    rows = [
        {"name": some(*[" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(6)]), "city": some("A", "B", "C", ""), "phone": some("0117 952 4240", "0117 952 4241", "0345 026 7789", " ", "12"),
         "website": some("a.co", "www.b.co/x", "N/A", "\u00a0"), "place_id": some("p", "q", "", " ", None), "email": some("x@y.z", " "), "rating": some(4.5), "reviews_count": some(3, 4), "is_duplicate": rng.random() < 0.1}
        for _ in range(60)
    ]
    df = businesses(spark, *rows)
    want = sequential([r.asDict() for r in df.collect()], sweep)
    got = {r["id"]: r for r in resolve.resolve(df, sweep).collect()}
    assert got.keys() == want.keys() and {i: told(r) for i, r in got.items()} == {i: told(want[i]) for i in got}
    assert all(r["website_available"] == bool(r["website"] and r["website"].strip()) for r in got.values())


@pytest.mark.parametrize("sweep", [False, True])
@pytest.mark.parametrize("seed", range(40))
def test_survivors_by_key_decide_as_whole_records_do(sweep, seed):
    """One component after the other, with many small keys, against the fold over whole records."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, *x])
    names = ["blue mill", "blue mills", "blu mill", "red mill", "red mills", "old corner", "old corners", "corner"]
    rows = [
        {c: None for c in resolve.FILLED} | {"id": f"{i:03}", "created_at": i, "is_duplicate": False, "duplicate_of_id": None, "name": some(*names), "city": some("A", "B", ""), "phone": some("0117 952 4240", "0117 952 4241", "0345 026 7789", " ", "12"),
         "website": some("a.co", "b.co", "n/a", ""), "place_id": some("p", "q", "r", "", " ")}
        for i in range(60)
    ]
    want = {i: r["duplicate_of_id"] for i, r in sequential(rows, sweep).items()}
    similar = {}
    for city in (None, "A", "B", ""):
        for a in names:
            for b in names:
                x, y = plain.name_key(a), plain.name_key(b)
                if x != y and max(plain.similarity(x, y), plain.similarity(y, x)) >= 0.82:
                    similar.setdefault((city, x), []).append(y)
    kept, got = resolve.Survivors(similar, sweep), {}
    for r in rows:
        key = plain.phone_key(r["phone"])
        row = {"id": r["id"], "city": r["city"], "place_id": r["place_id"], "name_key": plain.name_key(r["name"]), "phone_key": None if plain.is_shared_line(key) else key, "domain_key": plain.domain_key(r["website"])}
        got[r["id"]] = kept.take(row | {"has_phone": bool((r["phone"] or "").strip()), "has_domain": bool((r["website"] or "").strip())})
    assert got == want and len(set(got.values())) > 2


def test_chain_of_similar_names_takes_time_with_its_length():
    """100,000 names, each similar to its neighbours only, and 100,000 records of one place and one domain."""
    near = {("X", f"n{i}"): [f"n{j}" for j in (i - 1, i + 1) if 0 <= j < 100_000] for i in range(100_000)}
    kept = resolve.Survivors(near, False)
    kept.ratio = lambda a, b: 1.0
    row = {"city": "X", "place_id": None, "phone_key": None, "domain_key": None, "has_phone": False, "has_domain": False}
    began = time.monotonic()
    got = [kept.take(row | {"id": str(i), "name_key": f"n{i}"}) for i in range(100_000)]
    assert got == [None if i % 2 == 0 else str(i - 1) for i in range(100_000)]
    kept = resolve.Survivors({}, False)
    got = [kept.take(row | {"id": str(i), "name_key": f"m{i}", "place_id": f"p{i}", "domain_key": "chain.co", "has_domain": True}) for i in range(100_000)]
    assert set(got) == {None} and time.monotonic() - began < 30


def test_exact_pairs_come_once_and_are_not_shuffled(spark, monkeypatch):
    """Pairs that several rules find come under the first; records of a key are dealt to parts and none is lost."""
    monkeypatch.setattr(resolve, "_copies", lambda n: F.when(n > 3, 8).otherwise(1), raising=False)
    rng = random.Random(6)
    some = lambda *x: rng.choice([None, *x])
    rows = [{"name": some("blue mill", "red mill", "mill"), "city": some("A", "B", ""), "website": some("a.co", "b.co"), "place_id": some("p", "q", ""), "is_duplicate": rng.random() < 0.1} for _ in range(60)]
    keyed = resolve.with_keys(businesses(spark, *rows))
    live = [r for r in keyed.collect() if not r["is_duplicate"]]
    want = []
    for a in live:
        for b in live:
            apart = a["place_id"] and b["place_id"] and a["place_id"] != b["place_id"]
            same = lambda k, a=a, b=b: a[k] and a[k] == b[k]
            rule = "place_id" if same("place_id") else None if apart or a["city"] != b["city"] else "domain" if same("domain_key") else "name" if same("name_key") and a["city"] else None
            if a["id"] < b["id"] and rule:
                want.append((a["id"], b["id"], rule))
    pairs = resolve.exact_pairs(keyed)
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len({w[2] for w in want}) == 3
    assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_records_meet_packs_of_their_key(spark, monkeypatch):
    """Keys are made once, a row of the join stands for a pack, many pairs of little input are work for several tasks; packs lose no pair and add none."""
    monkeypatch.setattr(resolve, "PACK", 5, raising=False)
    rng = random.Random(8)
    some = lambda *x: rng.choice([None, *x])
    rows = [{"id": str(i), "name": some("blue mill", "red mill", "mill"), "city": some("A", "A", "=", ""), "website": some("a.co", "b.co"), "place_id": some("p", "q", "", None, None), "is_duplicate": rng.random() < 0.1} for i in range(240)]
    keyed = resolve.with_keys(reduce(DataFrame.unionByName, [businesses(spark, *rows[k : k + 60]) for k in range(0, 240, 60)]))
    live = [r for r in keyed.collect() if not r["is_duplicate"]]
    want = []
    for a in live:
        for b in live:
            same = lambda k, a=a, b=b: a[k] and a[k] == b[k]
            apart = a["place_id"] and b["place_id"] or a["city"] != b["city"]
            rule = "place_id" if same("place_id") else None if apart else "domain" if same("domain_key") else "name" if same("name_key") and a["city"] else None
            if a["id"] < b["id"] and rule:
                want.append((a["id"], b["id"], rule))
    pairs = resolve.exact_pairs(keyed)
    assert sorted(map(tuple, pairs.collect())) == sorted(want) and len({w[2] for w in want}) == 3
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.index("Generate explode(others") < plan.index("Join")
    for rule in ("place_id", "domain", "name"):  # two places, each dealt to eight parts
        assert pairs.where(F.col("rule") == rule).select(F.spark_partition_id()).distinct().count() > 4


def test_phone_pairs_join_records_last(spark, monkeypatch):
    """Names are compared before records meet, so no pairs of records are shuffled; none is lost."""
    monkeypatch.setattr(resolve, "_copies", lambda n: F.when(n > 2, 8).otherwise(1), raising=False)
    rng = random.Random(7)
    some = lambda *x: rng.choice([None, *x])
    rows = [{"name": some("blue mill", "blue mills", "red mill", "zq"), "city": some("A", "B"), "phone": some("0117 952 4240", "0117 952 4241", "0345 026 7789")} for _ in range(60)]
    keyed = resolve.with_keys(businesses(spark, *rows))
    live = [r for r in keyed.collect() if r["phone_key"] and not plain.is_shared_line(r["phone_key"])]
    scored = [(a["id"], b["id"], plain.similarity(b["name_key"], a["name_key"])) for a in live for b in live if a["id"] < b["id"] and (a["phone_key"], a["city"]) == (b["phone_key"], b["city"])]
    pairs = resolve.phone_pairs(keyed)
    assert sorted(map(tuple, pairs.collect())) == sorted(x for x in scored if x[2] >= 0.45) and len(scored) > len([x for x in scored if x[2] >= 0.45]) > 5
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "left_id" in joins[0] and "right_id" in joins[0]


def test_keys_are_made_once_for_all_steps(spark):
    """What decides on duplicates reads keys that are there, and no text of a record."""
    keyed = resolve.with_keys(businesses(spark, {"name": "One Two", "city": "X", "phone": "0345 026 7789"}, {"name": "Ten Six", "city": "X", "phone": "0345 026 7789"}, {"name": "Two One Ltd", "city": "X"}))
    decided = resolve.decisions(keyed, False, ("created_at",))
    plan = decided._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and "rlike" not in plan
    assert [tuple(r) for r in decided.collect()] == [("2", "0")]


def test_records_of_one_name_are_linked_once_and_decided_once(spark):
    """Links grow with the different names and keys, and what reads the decisions makes none anew."""
    rows = [{"name": f"Name {i % 3}", "city": "X", "website": f"s{i % 2}.co"} for i in range(60)]
    live = resolve.with_nodes(resolve.with_keys(businesses(spark, *rows)), False)
    close = spark.createDataFrame([], "city string, n1 string, n2 string")
    assert live.select("node").distinct().count() == 3 and resolve.possible_links(live, close).count() <= 3
    done = resolve.resolve(businesses(spark, *rows))
    assert "MapInArrow" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert flags(done) == {str(i): "0" if i else None for i in range(60)}


@pytest.mark.parametrize("sweep", [False, True])
def test_a_place_in_two_cities_lends_its_phones(spark, sweep):
    """A survivor has the phone of a record of its place in another city, and a later record of its own city meets it there."""
    rows = [{"name": "blue mill", "city": "A", "place_id": "p"}, {"name": "red hall", "city": "B", "place_id": "p", "phone": "0117 952 4240"}, {"name": "blue milton", "city": "A", "phone": "0117 952 4240"}]
    df = businesses(spark, *rows)
    want = {i: r["duplicate_of_id"] for i, r in sequential([r.asDict() for r in df.collect()], sweep).items()}
    assert flags(resolve.resolve(df, sweep)) == want == {"0": None, "1": "0", "2": "0"}


@pytest.mark.parametrize("sweep", [False, True])
def test_equal_keys_are_not_matched_anew(monkeypatch, sweep):
    """Of many records with few different keys some are matched only, and all are decided as if each were."""
    rng = random.Random(5)
    some = lambda *x: rng.choice([None, *x])
    rows = []
    for i in range(4000):
        phone, domain = some("1"), some("a.co")
        rows.append({"block": i // 2000, "similar_to": None, "id": f"{i:04}", "city": rng.choice("AB"), "place_id": some("p", " "), "name_key": rng.choice(["blue mill", "red mill", "corner"]) if i % 50 else None, "phone_key": phone, "domain_key": domain, "has_phone": bool(phone) or rng.random() < 0.5, "has_domain": bool(domain)})
    want = []
    for block in (0, 1):
        kept = resolve.Survivors({}, sweep)
        want += [(r["id"], found) for r in rows if r["block"] == block and (found := kept.take(dict(r))) is not None]
    matched, real = [], resolve.Survivors.match
    monkeypatch.setattr(resolve.Survivors, "match", lambda self, new: matched.append(new) or real(self, new))
    kinds = pa.schema([(c, pa.int64() if c == "block" else pa.bool_() if c.startswith("has_") else pa.string()) for c in rows[0]])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 700], kinds) for k in range(0, 4000, 700)]
    got = [(r["id"], r["survivor"]) for b in resolve._decide(iter(batches), sweep) for r in b.to_pylist()]
    assert got == want and len(matched) < 3000


def test_names_without_a_city_are_not_compared_by_an_import(spark, monkeypatch):
    """In the order of arrival such names match nothing; a sweep compares them."""
    seen, real = [], resolve.name_pairs
    monkeypatch.setattr(resolve, "name_pairs", lambda names: seen.append(names.count()) or real(names))
    rows = [(i, f"Number {i // 2}", "" if i % 4 < 2 else None, f"shop{i // 2}.co") for i in range(60)]
    typed = spark.createDataFrame(rows, "sequence long, name string, city string, website string")
    found, _ = leads.import_rows(businesses(spark).limit(0), typed, "b1")
    assert tuple(leads.import_counts(typed, found).first()) == (30, 30, 0) and seen == [0]
    swept = resolve.resolve(businesses(spark, {"name": "Number 12345"}, {"name": "Number 12346"}), sweep=True)
    assert flags(swept) == {"0": None, "1": "0"} and seen[1:] == [2]


def test_similar_names_misses_none(spark):
    rng = random.Random(9)
    names = sorted({" ".join(sorted("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 3)))) for _ in range(250)})
    df = spark.createDataFrame([("X", n) for n in names], "city string, name_key string")
    got = {(r["n1"], r["n2"]) for r in resolve.similar_names(df).collect()}
    from rowanmill.functions.keys import similarity

    assert got == {(a, b) for a in names for b in names if a < b and max(similarity(a, b), similarity(b, a)) >= 0.82}


def test_common_words_bring_no_names_together(spark):
    """Names of one city that share a common word only are not compared, and few pairs reach Python."""
    rng = random.Random(2)
    names = sorted({"corner " + " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(2)) for _ in range(200)})
    names = ["corner", *names, names[3] + " zz", names[5].replace("a", "b", 1)]
    df = spark.createDataFrame([("X", " ".join(sorted(n.split()))) for n in names], "city string, name_key string")
    pairs = cut(resolve.name_pairs(df.distinct()))
    assert pairs.where("NOT contained").count() < 100 and pairs.where("contained").count() < 20  # of 20,000
    from rowanmill.functions.keys import similarity

    keys = sorted({r["name_key"] for r in df.collect()})
    got = {(r["n1"], r["n2"]) for r in resolve.similar_names(df).collect()}
    assert got == {(a, b) for a in keys for b in keys if a < b and max(similarity(a, b), similarity(b, a)) >= 0.82} and got


SHEET = [(1, "Corner Shop One", "Bristol", "0117 952 4240", "High"), (2, "Corner One Ltd", "Bristol", None, "Low"), (3, "Other Place", "Leeds", None, None), (4, None, None, None, None), (5, "  ", "Leeds", "", "")]


def sheet_rows(spark, shift=0):
    return spark.createDataFrame([(s + shift, *r) for s, *r in SHEET], "sequence long, `Business Name` string, CITY string, Phone string, `Lead Priority` string")


@pytest.mark.parametrize("parts", [1, 4])
def test_import_twice_merges(spark, parts):
    """Order of the sheet decides, whatever the partitions and however large the numbers are; dates stay as they were."""
    old = businesses(spark, {"id": "old", "name": "Other Place", "city": "Leeds", "created_at": None})
    first, new, counts = leads.import_frame(old, sheet_rows(spark, 1 << 40).repartition(parts), "b1")
    first = first.persist()
    assert tuple(counts.first()) == (1, 2, 1)  # the row of nulls is no row, the blank one is skipped
    assert {(r["name"], r["phone"], r["id"] == "old") for r in first.collect()} == {("Corner Shop One", "0117 952 4240", False), ("Other Place", None, True)}
    assert {r["created_at"] is None for r in first.where("id = 'old'").collect()} == {True} and first.where("created_at > '2090-01-01'").count() == 0
    assert {r["priority"] for r in new.collect()} == {"low", "medium"} and new.count() == 2
    again, more, counts = leads.import_frame(first.select(*old.columns), sheet_rows(spark).repartition(parts), "b2")
    assert tuple(counts.first()) == (0, 3, 1) and {r["id"] for r in again.collect()} == {r["id"] for r in first.collect()}
    stored = spark.createDataFrame([], schema.LEAD)
    once = leads.merged_leads(stored, new, AT)
    twice = leads.merged_leads(once, more, datetime(2025, 1, 1))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 2


def test_owner_given_for_an_import_goes_first(spark):
    rows = spark.createDataFrame([("A Shop", "Haifa")], "name string, assigned_to string")
    assert sheets.typed_rows(rows, "Usman").first()["assigned_to"] == "Usman" and sheets.typed_rows(rows).first()["assigned_to"] == "Haifa"


def test_ingest_of_scraped_records(spark):
    old = businesses(spark, {"id": "b1", "name": "Corner Shop One", "city": "Bristol", "website": "https://c.co"})
    stored = spark.createDataFrame([("l1", "b1", 7, "phone", None, None, "completed", "Completed", "high", "n", "interested", None, 3, None, AT)], schema.LEAD)
    rows = [(1, "Corner One", "Bristol", None, "p1"), (2, "Fresh & Co", " Dubai ", None, "p2"), (3, " ", "Dubai", None, "p3"), (4, "By Road", None, "1 Mall Rd, Lahore, Pakistan", "p4")]
    records = spark.createDataFrame(rows, "sequence long, name string, city string, address string, place_id string")
    for f in ("category", "country", "phone", "website", "maps_url", "source"):
        records = records.withColumn(f, F.lit(None).cast("string"))
    records = records.withColumns({"google_rating": F.lit(4.5), "reviews_count": F.lit(3)})
    found, new, counts = leads.ingest(old, stored, records.repartition(3), "scrape", datetime(2026, 1, 5), 2)
    assert tuple(counts.first()) == (2, 1, 1)
    by_name = {r["name"]: r for r in found.collect()}
    assert by_name["Corner Shop One"]["place_id"] == "p1" and by_name["Fresh & Co"]["assigned_to"] == "Haifa" and by_name["Fresh & Co"]["source_bot"] == "google_maps_bot"
    assert (by_name["By Road"]["city"], by_name["By Road"]["country"]) == ("", "Pakistan")
    lead = {r["business_id"]: r for r in new.collect()}
    assert len(lead) == 3 and (lead["b1"]["automation_status_detail"], lead["b1"]["week_number"], lead["b1"]["priority"], lead["b1"]["lead_ref"]) == ("Queued", 3, "high", 7)
    other = lead[by_name["Fresh & Co"]["id"]]
    assert (other["automation_status"], other["automation_status_detail"], other["week_number"], other["priority"]) == ("completed", "Skipped (No Website)", 2, "medium")


def week_tables(spark):
    shops = businesses(spark, {"id": "b1", "name": "Wai Yee Hong Café", "city": "Bristol"}, {"id": "b2", "name": "Other", "city": "Abu Dhabi"})
    rows = [(f"l{i}", f"b{i}", i, "phone", None, None, "not_started", None, "high", None, "no_answer", None, 30, None, AT) for i in (1, 2)]
    return spark.createDataFrame(rows, schema.LEAD), shops


def test_weekly_files(spark, tmp_path):
    stored, shops = week_tables(spark)
    folder, audit = str(tmp_path / "out"), str(tmp_path / "runs")
    stamped, told = sinks.weekly_export(stored, shops, folder, audit, 30, "pytest")
    assert told["leads"]["rows_written"] == 2 and told["dashboard"]["total_leads_this_week"] == 2 and stamped.where("exported_at IS NULL").count() == 0
    raw = (tmp_path / "out/leads_week30.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and "Wai Yee Hong Café".encode() in raw and raw.count(b"\r\n") == 3
    text = (tmp_path / "out/dashboard_week30.csv").read_text(encoding="utf-8-sig")
    assert "Weekly Lead Generation Dashboard" in text and "Haifa" in text and text.count("\n") == told["dashboard"]["rows_written"]
    again, told = sinks.export_leads(stamped, shops, folder, audit, 30, "pytest", unsynced=True)
    assert told["rows_written"] == 0
    _, told = sinks.export_leads(stored, shops, folder, audit, 5, "pytest", city="Abu Dhabi")
    assert told["rows_written"] == 1 and sorted(p.name for p in (tmp_path / "out").glob("*.csv")) == ["dashboard_week30.csv", "leads_week05_abu_dhabi.csv", "leads_week30.csv"]
    runs = sinks.latest_runs(spark.read.parquet(audit)).collect()
    assert sorted((r["worksheet"], r["status"], r["triggered_by"]) for r in runs)[0] == ("dashboard_week30.csv", "success", "pytest") and len(runs) == 4


def test_failed_export_is_recorded(spark, tmp_path, monkeypatch):
    stored, shops = week_tables(spark)

    def full(*_):
        raise OSError("disk full")

    monkeypatch.setattr(sinks, "write_named_csv", full)
    with pytest.raises(OSError):
        sinks.export_leads(stored, shops, str(tmp_path), str(tmp_path / "runs"), 30, "pytest")
    run = sinks.latest_runs(spark.read.parquet(str(tmp_path / "runs"))).first()
    assert run["status"] == "failed" and "OSError: disk full" in run["error"] and run["worksheet"] == "leads_week30.csv"


def test_search_results_as_files(spark, tmp_path):
    df = spark.createDataFrame([("é", 1.5), (None, None)], "name string, rating double").coalesce(1)
    assert sinks.write_json_array(df, str(tmp_path / "a.json")) == 2
    import json

    text = (tmp_path / "a.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"name": "é", "rating": 1.5}, {"name": None, "rating": None}] and "é" in text
    assert sinks.write_json_array(df.limit(0), str(tmp_path / "b.json")) == 0 and json.loads((tmp_path / "b.json").read_text()) == []
    assert sinks.write_found_csv(df.limit(0), str(tmp_path / "n.csv")) == 0 and not (tmp_path / "n.csv").exists()
    assert sinks.write_found_csv(df, str(tmp_path / "c.csv")) == 2 and (tmp_path / "c.csv").read_bytes() == "name,rating\r\né,1.5\r\n,\r\n".encode()


def test_numbers_by_age_with_many_leads_of_one_time(spark):
    rows = [(f"{i:04d}", AT if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp_ntz").repartition(7)
    got = {r["id"]: r["lead_ref"] for r in export.number_leads(df, 10).collect()}
    assert got == {i: n + 11 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[0])))}


def test_older_tables_and_lookups(spark):
    df = spark.createDataFrame([("1", None, " "), ("2", True, "a.co"), ("3", False, None)], "id string, is_duplicate boolean, website string")
    assert {tuple(r)[:2] + (r["website_available"],) for r in export.backfilled(df).collect()} == {("1", False, False), ("2", True, True), ("3", False, False)}
    assert export.lookup(df, id="2", website="a.co").count() == 1


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbers_of_wide_leads_over_many_ranges(spark, coalesce):
    """Each lead keeps its row and gets each number once, however ranges are drawn or put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        df = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 7919 % 100_003).cast("timestamp_ntz").alias("created_at"), F.sha2(F.col("id").cast("string"), 512).alias("notes"), F.repeat(F.col("id").cast("string"), 20).alias("more"))
        got = cut(export.number_leads(df.repartition(16)))
        assert got.count() == 200_000 and got.select("id").distinct().count() == 200_000
        assert tuple(got.agg(F.min("lead_ref"), F.max("lead_ref"), F.count_distinct("lead_ref")).first()) == (1, 200_000, 200_000)
        later = got.alias("a").join(got.alias("b"), F.expr("a.lead_ref + 1 = b.lead_ref"))
        assert later.where("a.created_at > b.created_at OR (a.created_at = b.created_at AND a.id >= b.id)").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merge_rewrites_the_buckets_of_its_rows_only(spark, tmp_path):
    kind = "id string, n int"
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("n"))
    table = Table(spark, str(tmp_path / "t"), kind, buckets=32)
    assert table.read().count() == 0
    table.replace(rows)
    before = dict(table.folders)
    new = spark.createDataFrame([("3", 1), ("77", None), ("new", 2)], kind)
    touched = table.merge(new)
    assert len(touched) <= 3 and {b for b in before if table.folders[b] != before[b]} == touched
    assert Table(spark, str(tmp_path / "t"), kind).buckets == 32
    got = {r["id"]: r["n"] for r in Table(spark, str(tmp_path / "t"), kind).read().collect()}
    assert len(got) == 1001 and (got["3"], got["77"], got["new"], got["4"]) == (1, None, 2, 0)
    assert table.merge(new.limit(0)) == set() and table.read().count() == 1001


def test_killed_job_and_second_writer(spark, tmp_path, monkeypatch):
    kind = "id string, n int"
    table = Table(spark, str(tmp_path / "t"), kind, buckets=4)
    table.replace(spark.createDataFrame([("a", 1), ("b", 2)], kind))
    first, second = Table(spark, str(tmp_path / "t"), kind), Table(spark, str(tmp_path / "t"), kind)
    bad = spark.createDataFrame([("a", 5), ("c", 6)], kind).withColumn("n", F.when(F.col("id") == "c", F.raise_error(F.lit("no disk"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="no disk"):
        first.merge(bad)
    assert sorted(map(tuple, Table(spark, str(tmp_path / "t"), kind).read().collect())) == [("a", 1), ("b", 2)]
    first.merge(spark.createDataFrame([("a", 7)], kind))
    with pytest.raises(Conflict):
        second.merge(spark.createDataFrame([("b", 8)], kind))
    assert sorted(map(tuple, Table(spark, str(tmp_path / "t"), kind).read().collect())) == [("a", 7), ("b", 2)]


def test_changed_rows(spark):
    kind = "id string, n int"
    old, new = spark.createDataFrame([("a", None), ("b", 2), ("c", 3)], kind), spark.createDataFrame([("a", None), ("b", 4), ("d", None)], kind)
    assert sorted(map(str, changed(old, new).collect())) == sorted(map(str, new.where("id <> 'a'").collect()))


def test_stamped_leads_are_those_in_the_file(spark, tmp_path):
    """A filter that changes its mind is asked once."""
    stored, shops = week_tables(spark)
    rows = spark.range(300).select(F.concat(F.lit("x"), "id").alias("id"))
    many = rows.crossJoin(F.broadcast(stored.where("id = 'l1'").drop("id"))).select(*stored.columns).where(F.rand() < 0.5)
    stamped, told = sinks.export_leads(many, shops, str(tmp_path), str(tmp_path / "runs"), 30, "pytest")
    assert 0 < told["rows_written"] < 300 and stamped.where("exported_at IS NOT NULL").count() <= told["rows_written"]


def test_seek_pages_cover_all_rows_once(spark):
    rows = [(f"{i:03d}", AT if i % 3 else None if i % 2 else datetime(2025, 1, i % 28 + 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp_ntz").repartition(5)
    seen, after = [], None
    while (page := cut(export.seek(df, after, 7))).count():
        seen += [r["id"] for r in page.orderBy(F.desc_nulls_first("created_at"), "id").collect()]
        after = export.cursor(page)
    assert seen == [r["id"] for r in df.orderBy(F.desc_nulls_first("created_at"), "id").collect()]


def test_download_name():
    assert sinks.export_name("Bristol", datetime(2026, 1, 2, 3, 4)) == "leads_bristol_20260102_0304.csv" and sinks.export_name(at=AT) == "leads_20240101_0000.csv"


def test_classified_and_missing_leads(spark):
    lead = spark.createDataFrame([(i, "b1", None, "phone", "", None, "not_started", None, "high", None, "no_answer", None, 30, None, AT) for i in ("l1", "l2")], schema.LEAD)
    answers = spark.createDataFrame([("l1", "Online", "Own riders", "Manual", "HIGH", "n")], "id string, order_method string, delivery_system string, automation_status string, lead_priority string, notes string")
    got = {r["id"]: (r["order_method_detail"], r["delivery_system"], r["automation_status_detail"], r["priority"], r["notes"]) for r in leads.classify(lead, answers).collect()}
    assert got == {"l1": ("Online", "Own riders", "Manual", "high", "n"), "l2": ("Unknown", "Unknown", "Unknown", "low", "Gemini unavailable")}
    bare = leads.missing_leads(businesses(spark, {"id": "b1", "name": "x"}, {"id": "b2", "name": "y"}), lead).collect()
    assert [(r["business_id"], r["order_method"], r["priority"], r["call_status"]) for r in bare] == [("b2", "unknown", "medium", "not_contacted")]


def test_replies_of_a_model(spark):
    whole = {k: "v" for k in leads.FALLBACK}
    replies = {"a": json.dumps(whole), "b": "```json\n" + json.dumps(whole | {"notes": 'say "x"'}) + "\n```", "c": "sorry", "d": None, "e": json.dumps([whole]), "f": json.dumps(whole | {"notes": None}), "g": json.dumps(whole | {"notes": 5}), "h": ""}
    got = leads.answers(spark.createDataFrame([*replies.items(), ("a", json.dumps(whole | {"notes": "w"}))], "id string, reply string")).collect()
    assert sorted((r["id"], r["notes"]) for r in got) == [("a", "v"), ("b", 'say "x"')]


def test_chains_of_duplicates(spark):
    """A long chain, one that ends at an id that is gone, and a circle."""
    rows = [(str(i), str(i - 1) if i else None) for i in range(100)] + [("x", "gone"), ("y", "x"), ("z", None)]
    kind = "id string, duplicate_of_id string"
    got = {r["id"]: r["survivor"] for r in resolve.last_survivors(spark.createDataFrame(rows, kind)).collect()}
    assert got == {str(i): "0" for i in range(100)} | {"x": "gone", "y": "gone", "z": "z"}
    for circle in (2, 3, 4):
        bad = [(str(i), str((i + 1) % circle)) for i in range(circle)]
        with pytest.raises(ValueError, match="circle"):
            resolve.last_survivors(spark.createDataFrame([*bad, ("t", "0")], kind))


def test_one_file_from_many_parts(spark, tmp_path):
    """Byte for byte what a plain loop over the ordered rows writes, and an older file stays where writing fails."""
    rng = random.Random(6)
    some = lambda: rng.choice([None, "", " ", "a,b", 'say "hi"', "line\nbreak", "cr\r\nlf", "été", "\U0001f600", "x" * 300])
    rows = [(i, some(), some(), rng.choice([None, 1.5, 2.0]), rng.choice([None, AT.date()]), rng.choice([None, AT])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "n long, a string, `b.c` string, d double, day date, at timestamp_ntz").repartition(9)
    ordered = df.repartitionByRange(7, "n").sortWithinPartitions("n")
    assert ordered.rdd.getNumPartitions() > 1
    out = io.StringIO()
    csv.writer(out).writerows([df.columns, *[["" if v is None else v for v in r] for r in sorted(rows)]])
    path = tmp_path / "x.csv"
    assert sinks.write_named_csv(ordered, str(path)) == 2000 and path.read_bytes() == b"\xef\xbb\xbf" + out.getvalue().encode()
    assert sinks.write_found_csv(ordered, str(tmp_path / "y.csv")) == 2000 and (tmp_path / "y.csv").read_bytes() == out.getvalue().encode()
    whole = json.dumps([dict(zip(df.columns, r, strict=True)) for r in sorted(rows)], indent=2, ensure_ascii=False, default=str)
    assert sinks.write_json_array(ordered, str(tmp_path / "z.json")) == 2000 and (tmp_path / "z.json").read_text(encoding="utf-8") == whole
    with pytest.raises(Exception, match="bad row"):
        sinks.write_named_csv(ordered.withColumn("n", F.when(F.col("n") == 1500, F.raise_error(F.lit("bad row"))).otherwise(F.col("n"))), str(path))
    assert path.read_bytes() == b"\xef\xbb\xbf" + out.getvalue().encode() and sorted(p.name for p in tmp_path.iterdir()) == ["x.csv", "y.csv", "z.json"]
    assert sinks.write_named_csv(df.limit(0), str(path)) == 0 and path.read_bytes() == b"\xef\xbb\xbfn,a,b.c,d,day,at\r\n"
