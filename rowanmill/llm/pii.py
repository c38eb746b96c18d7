"""Personal data: fixed patterns, and more by bootstrapped contextual extraction (operator 8).

Seeds are the e-mail addresses, IP addresses, card and phone numbers that the fixed patterns find, and long
hexadecimal keys, a kind of their own ("secret").  The words around a seed make two lexical patterns: the two
words before it, and the word before with the word after.  Patterns and the values they stand around form a
graph, scored in rounds: a pattern's score for a kind is the share of all its occurrences in the corpus whose
value is known or believed to be of the kind, a value's belief comes from the patterns with high scores around
it.  Patterns of high score with several different known values find the values that the fixed patterns miss:
words of an identifier's shape in the same place.  A number of fewer than nine digits takes in the numbers that
follow it, each after one space, up to 19 digits together ("(017) 555-7713").  All of it is DataFrame
operations on built-in functions; patterns are told apart by 64-bit hashes of their words.

A pattern is open, that is scored at all, if ``support`` different seeds of a kind stand in it.  Its occurrences
are counted in all texts: a bitmap of fixed size, made of the open patterns, filters the pairs of words, these
are counted, and the counts are joined, one row a pattern.

Spans count code points, the end exclusive.  Defined results: a null text is the empty text and has no
spans; repeated rows get the same spans; texts of any length are read whole, only words around a value that
make more than ``CONTEXT_CHARS`` characters give no pattern; of equal scores the later kind is named; a found
span never overlaps a fixed one, but may overlap another found one if the words before both are patterns; an
empty table gives an empty result; columns of the input are kept, only ``fixed`` and ``spans`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, text_of

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
SPAN = "struct<start:bigint,kind:int,end:bigint>"
CONTEXT_CHARS = 80
STEP = 128  # elements that are summed at a time
BITMAP_BITS = 1 << 20
#: Patterns as the contract has them, with possessive loops and starts only where a run begins or the last match ended,
#: which changes no match and keeps long runs linear.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NEEDS = ("@", ".", "", "+")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
SPACE = r"\x20\x09-\x0D"
#: Words that a number in several words begins with, goes on with and may end in.
FIRST, NEXT, OPEN = r"^\(?\+?[0-9()-]*[0-9][0-9()-]*$", r"^\(?[0-9][0-9()-]*[^\p{L}0-9@]*$", r"^[0-9()-]+$"
ALONE, MOST_DIGITS = 9, 19
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Keys that are known without any context: 32 to 64 hexadecimal digits in lower case, some of them letters and some not.
HEX_KEY = r"^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}$"
BEFORE = rf"(?<![^{SPACE}])([^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)[{SPACE}]*$"
LAST_WORD = rf"(?<![^{SPACE}])([^{SPACE}]+)[{SPACE}]*$"
NEXT_WORD = rf"^[{SPACE}]{{1,99}}([^{SPACE}]{{1,79}})(?:[{SPACE}]|$)"
AFTER_CHARS = 200  # what NEXT_WORD may look at


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    one = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")  # the i-th digit from the right
    weighed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(value: Column, kind: int) -> Column:
    n = F.length(digits(value))
    if kind == 1:
        return F.regexp_like(value, F.lit(IP))
    if kind == 2:
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False)
    return n.between(9, 15) if kind == 3 else F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """The sum before each element of an array of longs, ``STEP`` elements at a time, so that long arrays cost little more."""
    none = F.array().cast("array<bigint>")

    def sums(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    zero = F.lit(0).cast("bigint")
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda c: F.slice(v, c * STEP + 1, F.lit(STEP)))
    whole = lambda c: sums(F.transform(c, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero)
    joined = lambda c: F.flatten(F.transform(F.arrays_zip(c.alias("part"), whole(c).alias("base")), lambda z: sums(z["part"], z["base"])))
    return let(sizes, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(none))


def places(text: Column, pattern: str, more: Callable[[Column, Column, Column], list[Column]] | None = None) -> Column:
    """All matches in order: array of value, start, end and what ``more`` makes of the matches, the gaps before them and the number of each."""
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def listed(p: Column) -> Column:
        size = lambda v, i: (F.length(v) + F.length(F.get(p["gaps"], i))).cast("bigint")
        rows = F.arrays_zip(p["values"].alias("value"), running(F.transform(p["values"], size)).alias("at"))

        def row(x: Column, i: Column) -> Column:
            start = x["at"] + F.length(F.get(p["gaps"], i))
            return F.struct(x["value"].alias("value"), start.alias("start"), (start + F.length(x["value"])).alias("end"), *(more(p["values"], p["gaps"], i) if more else []))

        return F.transform(rows, row)

    return let(pair, listed)


def kind_places(text: Column, pattern: str, kind: int) -> Column:
    good = F.filter(places(text, pattern), lambda x: valid(x["value"], kind))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def fixed_places(text: Column) -> Column:
    """The matches of the fixed patterns, by start and then kind: array of start, kind, end, value."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    parts = []
    for kind, pattern in enumerate(PATTERNS):
        asked = F.contains(text, F.lit(NEEDS[kind])) & F.regexp_like(text, F.lit("[0-9]" if kind else "@"))
        parts.append(F.when(asked, kind_places(text, pattern, kind)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def fixed_spans(text: Column) -> Column:
    return F.transform(fixed_places(text), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pattern_of(which: int, first: Column, second: Column) -> Column:
    """The hash of a pattern of two lower-case words; null without both."""
    return F.when((first != "") & (second != ""), F.xxhash64(F.lit(which), first, second))


def around(values: Column, gaps: Column, i: Column) -> list[Column]:
    """The patterns that stand around the i-th word (``before``, ``about``) and the gap before it."""
    text = lambda x: F.coalesce(x, F.lit(""))
    tail = lambda x: F.substring(text(x), -CONTEXT_CHARS, CONTEXT_CHARS)
    lead = F.lower(tail(F.concat(text(F.get(values, i - 2)), tail(F.when(i > 0, F.get(gaps, i - 1))), text(F.get(values, i - 1)), tail(F.get(gaps, i)))))
    rest = F.concat(F.left(text(F.get(gaps, i + 1)), F.lit(AFTER_CHARS)), F.left(text(F.get(values, i + 1)), F.lit(AFTER_CHARS)))
    after = F.lower(F.regexp_extract(F.left(rest, F.lit(AFTER_CHARS)), NEXT_WORD, 1))
    word = lambda k: F.regexp_extract(lead, BEFORE, k)
    return [pattern_of(0, word(1), word(2)).alias("before"), pattern_of(1, F.regexp_extract(lead, LAST_WORD, 1), after).alias("about"), F.get(gaps, i).alias("gap")]


def number_run(run: Column) -> Column:
    """A word's value with the numbers that go on after it; ``run`` is the word and those after it, up to one that is part of a fixed span."""
    first = F.get(run, F.lit(0))
    n = F.length(digits(first["value"]))
    start = F.struct(first["value"].alias("value"), n.alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, y: Column) -> Column:
        more = acc["n"] + F.length(digits(y["value"]))
        on = acc["on"] & (y["gap"] == " ") & F.regexp_like(y["value"], F.lit(NEXT)) & (more <= MOST_DIGITS) & ~y["busy"]
        goes_on = F.struct(F.concat(acc["value"], F.lit(" "), y["value"]).alias("value"), more.alias("n"), F.regexp_like(y["value"], F.lit(OPEN)).alias("on"))
        return F.when(on, goes_on).otherwise(F.struct(acc["value"].alias("value"), acc["n"].alias("n"), F.lit(False).alias("on")))

    joined = F.aggregate(F.slice(run, F.lit(2), F.lit(MOST_DIGITS - 1)), start, step, lambda acc: acc["value"])
    return F.when((n < ALONE) & F.regexp_like(first["value"], F.lit(FIRST)), joined).otherwise(first["value"])


def graph(rows: DataFrame) -> DataFrame:
    """Occurrences of values (``rows``: id, th, text): id, th, start, end, value, kind (null where not known), before, about and copies.

    Values are the fixed spans, the hexadecimal keys, and the other words with digits or an at sign.  What a
    value touches in its text is found by windows over the text's values in order of place.
    """
    text, none = F.col("text"), F.lit(None)
    words = F.transform(places(text, CANDIDATE, around), lambda x: F.struct(x["start"].alias("start"), none.cast("int").alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["about"].alias("about"), x["gap"].alias("gap")))
    seeds = F.transform(fixed_places(text), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"), none.cast("bigint").alias("before"), none.cast("bigint").alias("about"), none.cast("string").alias("gap")))
    found = rows.where(F.regexp_like(text, F.lit("[0-9@]"))).select("id", "th", F.explode(F.concat(seeds, words)).alias("x")).select("id", "th", "x.*")
    found = found.groupBy("id", "th", "start", "kind", "end", "value", "before", "about", "gap").agg(F.count("*").alias("copies"))  # repeated rows
    mine, known = Window.partitionBy("id", "th"), F.col("kind").isNotNull()
    up_to = lambda *order: mine.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    word = F.last(F.when(~known, F.struct("end", "before", "about")), ignorenulls=True).over(up_to("start", known, "kind", "end"))
    place = F.when(known, F.col("start")).otherwise(F.col("end") - 1)
    busy = F.coalesce(F.max(F.when(known, F.col("end"))).over(up_to(place, ~known, "kind", "end")) > F.col("start"), F.lit(False))
    found = found.withColumns({"word": word, "busy": busy})
    about = F.when(F.col("end") <= F.col("word.end"), F.col("word.about"))  # only values of one word, as they are counted
    fixed = found.where(known).select("id", "th", "start", "end", "value", "kind", F.col("word.before").alias("before"), about.alias("about"), "copies")
    ahead = mine.orderBy("start").rowsBetween(0, MOST_DIGITS - 1)
    loose = found.where(~known).withColumn("whole", number_run(F.collect_list(F.struct("value", "gap", "busy")).over(ahead))).where("NOT busy")
    shift = F.length(F.regexp_extract("whole", r"^[^\p{L}0-9]*", 0))
    core = F.regexp_replace(F.regexp_replace("whole", r"^[^\p{L}0-9]+", ""), r"[^\p{L}0-9]+$", "")
    loose = loose.select("id", "th", (F.col("start") + shift).alias("start"), core.alias("core"), "before", F.when(F.col("whole") == F.col("value"), F.col("about")).alias("about"), "copies")
    kind = F.when(F.regexp_like("core", F.lit(HEX_KEY)), SECRET).cast("int")
    loose = loose.where("core <> ''").select("id", "th", "start", (F.col("start") + F.length("core")).alias("end"), F.col("core").alias("value"), kind.alias("kind"), "before", "about", "copies")
    return fixed.unionByName(loose)


def shaped(value: Column, kind: Column) -> Column:
    """Whether a value may be of a kind that the fixed pattern has missed."""
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit(r"\p{L}")) & (F.length(value) >= 12)
    return F.when(kind == 0, F.contains(value, F.lit("@")) & (F.length(value) >= 6)).when(kind == SECRET, mixed).otherwise(F.length(digits(value)) >= 6)


def bitmap_of(open_: DataFrame) -> Callable[[Column], Column]:
    """A test for the patterns of ``open_``, true for some others too; what reaches the driver is BITMAP_BITS bits at most."""
    bit = F.pmod("ctx", F.lit(BITMAP_BITS))
    mask = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(ctx, {BITMAP_BITS}) & 63 AS int))")).alias("mask")
    cells = [0] * (BITMAP_BITS // 64)
    for r in open_.groupBy(F.shiftright(bit, 6).cast("int").alias("cell")).agg(mask).collect():  # BITMAP_BITS / 64 rows at most
        cells[r["cell"]] = r["mask"]
    bits = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")

    def test(ctx: Column) -> Column:
        at = F.pmod(ctx, F.lit(BITMAP_BITS))
        return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def occurrences(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """ctx, total: how often the patterns of ``open_`` stand around a word in ``texts`` (text), whatever the word."""
    held, w = bitmap_of(open_), F.col("w")
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[^{SPACE}]+"), F.lit(0))
    spots = texts.select(words.alias("w")).where(F.size("w") > 2).select("w", F.explode(F.sequence(F.lit(0), 2 * F.size("w") - 5)).alias("j"))
    which, i = F.col("j") % 2, F.shiftright("j", 1)
    pairs = spots.select(F.xxhash64(which, F.get(w, i), F.get(w, i + 1 + which)).alias("ctx"))
    counts = pairs.where(held(F.col("ctx"))).groupBy("ctx").agg(F.count("*").alias("total"))
    return counts.join(open_.select("ctx").distinct(), "ctx")


def patterns(links: DataFrame, texts: DataFrame, support: int, accept: float, rounds: int) -> DataFrame:
    """ctx, kind, score of the patterns that are accepted in the end."""
    edges = links.select("value", "kind", "copies", F.explode(F.array_compact(F.array("before", "about"))).alias("ctx"))
    edges = materialize(edges.groupBy("ctx", "value", "kind").agg(F.sum("copies").alias("n")))
    known = edges.where("kind IS NOT NULL").groupBy("ctx", "kind").agg(F.count("*").alias("values")).where(F.col("values") >= support)
    open_ = materialize(known.select("ctx", "kind"))
    totals = materialize(occurrences(texts, open_))
    seeds = edges.where("kind IS NOT NULL").select("ctx", "kind", "value", "n", F.lit(1.0).alias("belief")).join(open_, ["ctx", "kind"])
    loose = edges.where("kind IS NULL").select("ctx", "value", "n").join(open_, "ctx").where(shaped(F.col("value"), F.col("kind"))).select("ctx", "kind", "value", "n")
    seeds, loose = materialize(seeds), materialize(loose)
    believed = seeds
    for _ in range(rounds):
        score = F.least(F.sum(F.col("n") * F.col("belief")) / F.max("total"), F.lit(1.0))
        scored = believed.join(totals, "ctx").groupBy("ctx", "kind").agg(score.alias("score")).where(F.col("score") >= accept)
        scored = materialize(scored)
        belief = loose.join(scored, ["ctx", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
        believed = seeds.unionByName(loose.join(belief, ["value", "kind"]).select("ctx", "kind", "value", "n", "belief"))
    return scored


def find(docs: DataFrame, support: int = 5, accept: float = 0.6, rounds: int = 3) -> DataFrame:
    """``docs`` with arrays ``fixed`` and ``spans`` (start, kind, end): of the fixed patterns, and all."""
    rows = packed(docs).select("_in", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    links = materialize(graph(rows.select("id", "th", "text")))
    rules = patterns(links, rows, support, accept, rounds)
    loose = links.where("kind IS NULL").select("id", "th", "start", "end", "value", F.explode(F.array_compact(F.array("before", "about"))).alias("ctx"))
    hits = loose.join(rules, "ctx").where(shaped(F.col("value"), F.col("kind"))).select("id", "th", "start", "end", "kind", "score")
    hits = hits.unionByName(links.where(F.col("kind") == SECRET).select("id", "th", "start", "end", "kind", F.lit(1.0).alias("score")))
    hits = hits.groupBy("id", "th", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    hits = materialize(hits.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("found")))
    marked = rows.withColumn("fixed", fixed_spans(F.col("text"))).join(hits, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    none = F.array().cast(f"array<{SPAN}>")
    spans = F.array_sort(F.concat("fixed", F.coalesce("found", none)))
    return marked.select(*[F.col(f"_in.`{c}`").alias(c) for c in docs.columns if c not in ("fixed", "spans")], "fixed", spans.alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first is named."""
    text = text_of()
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in NAMES]), k + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, name(s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).cast("bigint").alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("text")))
