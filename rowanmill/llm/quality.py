"""Quality rules compiled into one Spark projection (operator 6).

A rule is a row of a threshold table: a measure and the range in which a document is kept.  The table is
compiled to one boolean column over measure columns, all of them built-in expressions, so the scan, the
measures and the verdict are one projection without a shuffle.

Defined results: a null text has no words, like an empty one, and fails; documents of any length are
measured whole; repeated rows are judged one by one; an empty table gives an empty result; input columns
with the name of a measure are replaced by it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, packed, text_of

PLACE_BITS = 21
PLACES = (1 << PLACE_BITS) - 1
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was as with be by this are at an from or not have he "
    "der die das und ist von den zu mit ein eine auf im nicht dem des sich als "
    "le la les de des et un une que est en du dans pour qui sur pas au avec "
    "el los las y a del que por con se no su para es al lo como"
).split()


class Rule(NamedTuple):
    """Keep while ``least <= measure <= most``."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production thresholds; base_failed has its own, fixed in measures().
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.4),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and ratios of its texts; what lies between has names that no column of ``docs`` begins with."""
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    text, words = text_of(), F.col(f"{own}words")
    df = docs.withColumn(f"{own}words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    n = F.size(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.array(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    # windows as longs of hash and place, sorted: equal windows are neighbours
    key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(-1 - PLACES)).bitwiseOR(i.cast("long"))
    df = df.withColumn(f"{own}keys", F.array_sort(F.transform(places, key)))
    keys = F.col(f"{own}keys")
    run = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit(PLACES)).cast("int")
    df = df.withColumn(f"{own}found", F.filter(keys, lambda x, k: (run(x) == run(F.get(keys, k - 1))) | (run(x) == run(F.get(keys, k + 1)))))
    found = F.col(f"{own}found")
    mixed = F.exists(F.transform(found, lambda x, k: (run(x) == run(F.get(found, k - 1))) & (window(place(x)) != window(place(F.get(found, k - 1))))), lambda x: x)
    # where two different windows share a hash, or places don't fit, sort the windows themselves
    exact = F.array_sort(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    df = df.withColumn(f"{own}exact", F.when((n > PLACES) | F.coalesce(mixed, F.lit(False)), exact))
    e = F.col(f"{own}exact")
    twice = F.filter(e, lambda x, k: (x["w"] == F.get(e, k - 1)["w"]) | (x["w"] == F.get(e, k + 1)["w"]))
    df = df.withColumn(f"{own}repeated", F.array_sort(F.when(e.isNotNull(), F.transform(twice, lambda x: x["i"])).otherwise(F.transform(found, place))))
    r = F.col(f"{own}repeated")
    covered = F.aggregate(F.transform(r, lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(r, k - 1), F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumns({f"{own}lines": lines, "n_words": n.cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long")})
    df = df.withColumns(
        {
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(f"{own}lines") - F.size(F.array_distinct(f"{own}lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines": F.size(f"{own}lines").cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))).cast("long"),
        }
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "stop_word_ratio": share("n_stop_words", "n_words"),
            "dup_line_ratio": share("n_dup_lines", "n_lines"),
        }
    ).drop(*[f"{own}{c}" for c in ("words", "keys", "found", "exact", "repeated", "lines")])


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean column."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.most)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measures and ``kept``: no base failure and every rule met."""
    return measures(docs).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The row number beside the verdict holds the filter above the projection; pushed below, it would evaluate
    all measures again inside each other.
    """
    judged = judge(packed(docs), rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("_in.*")
