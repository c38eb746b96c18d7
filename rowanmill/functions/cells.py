"""Cleaning of spreadsheet cells: every function takes and gives Columns, so plans stay in code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AUTOMATION

# Cells that mean "nothing", and the phrases of the sheets.
BLANKS = (
    "", "n/a", "na", "n.a", "not available", "none", "null", "nil", "-", "--", "—", "–", "unknown", "unkown", "not found", "notfound",
    "not listed", "not given", "nan", "nat", "#value!", "#n/a", "available", "available on website", "multiple", "tbd", "tbc", "?",
    "to verify", "to be verified", "verify", "pending",
)
CALL_PHRASES = {
    "not_contacted": ("not contacted", "not called", "uncontacted"),
    "contacted": ("contacted", "called"),
    "interested": ("contacted interested", "interested"),
    "not_interested": ("contacted not interested", "not interested"),
    "no_answer": ("no answer", "no response", "attempted no answer", "attempted", "tried no answer"),
    "callback_scheduled": ("callback", "callback scheduled", "call back", "follow up"),
}
AUTOMATION_PHRASES = {
    "not_started": ("manual",),
    "in_progress": ("semi automated", "semiautomated", "partially automated"),
    "completed": ("automated", "fully automated"),
}
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(x: Column) -> Column:
    """Trim every Unicode space, not only the ASCII blank."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def truthy(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def clean(x: Column) -> Column:
    """The trimmed text, or null for a placeholder."""
    text = strip(x.cast("string"))
    return F.when(~F.lower(text).isin(*BLANKS), text)


def to_double(x: Column) -> Column:
    """A number after dropping commas; null for anything else."""
    text = F.replace(clean(x), F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def to_int(x: Column) -> Column:
    """Digits and dots only, cut to a whole number: '120+' is 120, '1.2.3' is null."""
    return F.regexp_replace(clean(x), r"[^0-9.]", "").try_cast("double").try_cast("int")


def to_week(x: Column) -> Column:
    """The first run of digits if it is a week, 1 to 53."""
    number = F.regexp_extract(clean(x), r"(\d+)", 1).try_cast("int")
    return F.when(number.between(1, 53), number)


def to_phone(x: Column) -> Column:
    """The text as it is, or null if it is in scientific notation or has fewer than 7 digits."""
    text = clean(x)
    solid = F.regexp_replace(text, " ", "")
    usable = ~solid.rlike(r"^\d(\.\d+)?[eE][+-]?\d+$") & (F.length(F.regexp_replace(text, r"(?U)\D", "")) >= 7)
    return F.when(usable, text)


def to_bool(x: Column) -> Column:
    return F.coalesce(F.lower(clean(x)).isin("yes", "y", "true", "1"), F.lit(False))


def to_date(x: Column) -> Column:
    """The first format that fits."""
    text = clean(x)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def to_enum(x: Column, domain: tuple[str, ...], default: str) -> Column:
    value = F.translate(F.lower(clean(x)), " -", "__")
    return F.when(value.isin(*domain), value).otherwise(default)


def _phrase(x: Column) -> Column:
    """Lower-case letters with single blanks, so that dashes and slashes don't matter."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z ]", " "), " +", " "))


def _lookup(key: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(key.isin(*known), value) for value, known in phrases.items()])


def call_status(x: Column) -> Column:
    return F.coalesce(_lookup(_phrase(clean(x)), CALL_PHRASES), F.lit("not_contacted"))


def automation_status(detail: Column) -> Column:
    """Exact phrases first, then the telling word; 'semi' is asked before 'automat'."""
    key = _phrase(detail)
    by_word = F.when(key.contains("semi") | key.contains("partial"), "in_progress").when(key.contains("manual"), "not_started").when(key.contains("automat"), "completed")
    return F.when(truthy(detail), F.coalesce(_lookup(key, AUTOMATION_PHRASES), by_word, to_enum(detail, AUTOMATION, "not_started"))).otherwise("not_started")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def order_method(detail: Column) -> Column:
    """'app' is part of 'whatsapp', so WhatsApp orders count as online."""
    text = F.lower(detail)
    found = F.when(_any_of(text, ("website", "online", "mobile", "app")), "online").when(_any_of(text, ("phone", "call", "whatsapp")), "phone")
    return F.coalesce(found.when(_any_of(text, ("walk", "in-store", "in store")), "in_person"), F.lit("unknown"))


def social_links(x: Column) -> dict[str, Column]:
    """A cell of links, parted by bar or comma, dealt to columns by what each contains; the last of a platform wins."""
    parts = F.filter(F.transform(F.split(clean(x), "[|,]"), strip), lambda p: p != "")

    def platform(p: Column) -> Column:
        text = F.lower(p)
        return F.when(_any_of(text, ("facebook", "fb.com")), "facebook_url").when(text.contains("instagram"), "instagram_url").when(text.contains("linkedin"), "linkedin_url").when(_any_of(text, ("wa.me", "whatsapp")), "whatsapp_number")

    def last(name: str) -> Column:
        mine = F.filter(parts, lambda p: F.coalesce(platform(p) == name, F.lit(False)))
        return F.get(mine, F.size(mine) - 1)

    found = {name: last(name) for name in ("facebook_url", "instagram_url", "linkedin_url", "whatsapp_number")}
    found["whatsapp_number"] = F.substring_index(found["whatsapp_number"], "/", -1)
    return found


def title(x: Column) -> Column:
    """Upper case after every character that is no letter, as in 'Côte D'Ivoire', 'U.S.A'."""
    pieces = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
