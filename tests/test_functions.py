import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import plain

from rowanmill.functions import cells, dom, keys, places, scoring, web
from rowanmill.operators import dashboard


def values(spark, column, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


NAMES = [("Tesco Superstore", "tesco"), ("Wah Yan Hong Ltd.", "hong wah yan"), ("The Market", "market the"), ("", None), (None, None), ("Café Ünï 24", "24 caf n"), ("  b  A ", "a b")]
PHONES = [("+44 117 952 4240", "1179524240"), ("0117 952 4240", "1179524240"), ("+971 50 110 4711", "501104711"), ("050 110 4711", "501104711"), ("00971501104711", "501104711"), ("+92 300 1234567", "3001234567"),
          ("12345", None), (None, None), ("44123456", "44123456"), ("0000000", None), ("٠١١٧٩٥٢٤٢٤٠", "٠١١٧٩٥٢٤٢٤٠")]
DOMAINS = [("https://www.WaiYeeHong.com/contact?x=1", "waiyeehong.com"), ("shop.co.uk", "shop.co.uk"), ("http://user:pw@a.b:80/x", "a.b"), ("N/A", None), ("localhost", None), (None, None), ("http://my_shop.com", "my_shop.com")]


@pytest.mark.parametrize(("column", "single", "cases"), [(keys.name_key, plain.name_key, NAMES), (keys.phone_key, plain.phone_key, PHONES), (keys.domain_key, plain.domain_key, DOMAINS)])
def test_keys(spark, column, single, cases):
    assert values(spark, column, [a for a, _ in cases]) == [b for _, b in cases] == [single(a) for a, _ in cases]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aB1 .-/@:w+0492é&", max_size=20), min_size=40, max_size=40))
def test_columns_and_plain_keys_agree(spark, texts):
    for column, single in ((keys.name_key, plain.name_key), (keys.phone_key, plain.phone_key), (keys.domain_key, plain.domain_key)):
        assert values(spark, column, texts) == [single(t) for t in texts]


def test_shared_lines(spark):
    cases = {"3450267789": True, "8004321": True, "42111933933": True, "1179524240": False, "3001234567": True, None: False}
    assert values(spark, keys.is_shared_line, list(cases)) == list(cases.values()) == [plain.is_shared_line(k) for k in cases]


def test_similarity():
    assert keys.similarity("wai yee hong", "chinese wai yee hong") == 1.0
    assert keys.similarity("best", "better") < 0.82
    assert keys.similarity("mini", "international mini") < 0.82
    assert keys.similarity(None, "a") == 0.0


def test_similarity_column(spark):
    df = spark.createDataFrame([("hong wah yan", "hong w y"), ("a", None), ("14 askari c", "lalazar save")], "a string, b string")
    got = [r[0] for r in df.select(keys.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [keys.similarity("hong wah yan", "hong w y"), 0.0, keys.similarity("14 askari c", "lalazar save")]


CELLS = [
    (cells.clean, [(" N/A ", None), (" x ", "x"), ("unkown", None), ("—", None), (None, None)]),
    (cells.to_double, [("4.5", 4.5), ("2,409", 2409.0), ("1d", None), ("1_000", None), ("x", None)]),
    (cells.to_int, [("120+", 120), ("2,409", 2409), ("-5", 5), ("1.2.3", None), ("nan", None), ("9" * 300, None)]),
    (cells.to_week, [("30", 30), ("Week 1", 1), ("week1", 1), ("99", None), ("0", None), ("", None)]),
    (cells.to_phone, [("4.41317E+11", None), ("4.4 E+11", None), ("+44 117 952 4240", "+44 117 952 4240"), ("12", None)]),
    (cells.call_status, [("Contacted – Interested", "interested"), ("Attempted – No Answer", "no_answer"), ("?", "not_contacted"), ("gone", "not_contacted"), (None, "not_contacted")]),
    (cells.automation_status, [("Manual (likely)", "not_started"), ("Semi-Automated?", "in_progress"), ("mostly automated", "completed"), (None, "not_started"), ("Completed", "completed")]),
    (cells.order_method, [("Walk-in + Delivery", "in_person"), ("Website + Mobile", "online"), ("WhatsApp", "online"), ("phone call", "phone"), (None, "unknown")]),
    (cells.title, [("côte d'ivoire u.s.a guinea-bissau", "Côte D'Ivoire U.S.A Guinea-Bissau"), ("", "")]),
    (dashboard.country_name, [("uk", "United Kingdom"), (" UAE ", "United Arab Emirates"), ("new zealand", "New Zealand"), ("", "Unspecified"), (None, "Unspecified")]),
    (places.place_id, [("https://m/!1sabc!2x", "abc"), ("none", None)]),
    (lambda x: places.address_city(x, F.lit("home")), [("1 High St, Southampton, UK", "ton"), ("1 Mall Rd, Lahore, Pakistan", "home"), ("one", "home"), (None, "home")]),
    (lambda x: places.address_country(x, F.lit("none")), [("a, b, Russia", "Russia"), ("a, b, Spain", "none")]),
    (places.rating, [("4,5", 4.5), ("x", None)]),
    (web.crawl_error, [("DNS: gaierror", "DNS Failure"), ("read timed out", "Timeout"), ("it broke in a way nobody foresaw", "Failed (it broke in a way nobody fores)")]),
    (web.social_site, [("https://www.facebook.com/x", "facebook.com"), ("https://instagram.com/x", None), ("https://shop.test", None)]),
    (web.valid_phone, [("2024-01-02", False), ("192 168 1 10", False), ("+44 117 952 4240", True), ("1111111", False), ("123456", False)]),
    (web.with_scheme, [("a.b", "https://a.b"), (" http://a.b", "http://a.b")]),
    (web.unfenced, [('```json\n{"a": 1}\n```', '{"a": 1}'), ("{}", "{}")]),
]


@pytest.mark.parametrize(("column", "cases"), CELLS)
def test_cells(spark, column, cases):
    assert values(spark, column, [a for a, _ in cases]) == [b for _, b in cases]


def test_dates(spark):
    cases = {"2026-08-03": "2026-08-03", "03/08/2026": "2026-08-03", "12/31/2025": "2025-12-31", "3 aug 2026": "2026-08-03", "next tuesday": None, "2026-13-45": None}
    assert [str(d) if d else None for d in values(spark, cells.to_date, list(cases))] == list(cases.values())


def test_social_cell(spark):
    df = spark.createDataFrame([("facebook.com/x | instagram.com/y, wa.me/971501 | facebook.com/z",), (None,)], "x string")
    got = df.select(*[c.alias(n) for n, c in cells.social_links(F.col("x")).items()]).collect()
    assert tuple(got[0]) == ("facebook.com/z", "instagram.com/y", None, "971501") and set(got[1]) == {None}


def test_priority(spark):
    df = spark.createDataFrame([("w", "e", "p", None), ("w", "", None, ""), (None, None, None, None), ("w", None, "p", "f")], "w string, e string, p string, f string")
    assert [r[0] for r in df.select(scoring.priority(F.col("w"), F.col("e"), F.col("p"), F.col("f"))).collect()] == ["high", "medium", "low", "high"]


def test_names_of_structured_data(spark):
    blocks = [
        '{"founder": "Ann Lee", "owner": {"name": "Bo Ray"}, "employee": [{"name": "Cy Dee"}, "Not An Object", {"name": null}]}',
        ' [{"ceo": {"name": "Eve Fox"}}, 3, {"author": 5, "director": {"name": ["List Name"]}}] ',
        "{no json", "", "null", '{"name": "Un Owned"}', '{"owner": ""}', '"founder"',
    ]
    df = spark.createDataFrame([(blocks,), ([],), (["{broken"],)], "data array<string>").select(dom.data_names(F.col("data")).alias("n"))
    assert [r["n"] for r in df.collect()] == [["Ann Lee", "Bo Ray", "Cy Dee", "Eve Fox"], [], []]


@pytest.mark.parametrize(
    "markup,items,links,blocks",
    [
        ("<p itemprop=telephone>0117 952 4240<p>12 High Street", ["0117 952 4240"], [], ["0117 952 4240", "12 High Street"]),
        ("<ul><li itemprop=name>A Shop<li>B</ul>C", ["A Shop"], [], []),
        ("<table><tr><td itemprop=address>1 Old Road<td>x<tr><td>y</table>z", ["1 Old Road"], [], []),
        ("<div><a href=/c>Contact</div>Text", [], ["Contact"], []),
        ("<a href=/c>Contact<a name=n>here</a>", [], ["Contact"], []),
        ("<div itemprop=name>A</b> Shop</span> Ltd</div>!", ["A Shop Ltd"], [], ["A Shop Ltd"]),
        ("<span itemprop=name>A<div>B</span>C</div>D</span>E", ["ABCD"], [], ["BC"]),
        ("<dl><dt itemprop=name>A<dd itemprop=telephone>123</dl>4", ["A", "123"], [], []),
        ("<div>7 Long Lane", [], [], ["7 Long Lane"]),
    ],
)
def test_tags_left_open(markup, items, links, blocks):
    page = dom.Page(markup)
    assert ([t for _, _, t in page.items], [t for _, t in page.links], page.blocks) == (items, links, blocks)
    closed = dom.Page(f"<html><body>{markup}</body></html>")
    assert (closed.items, closed.links, closed.blocks, closed.text) == (page.items, page.links, page.blocks, page.text)


def test_form_that_is_left_open():
    page = dom.Page("<div><form><input name=a></div><input name=b><form><input name=c></form>")
    assert [n for _, n in page.inputs] == ["a"] and page.forms == 2
