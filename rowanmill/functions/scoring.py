"""Priority of a business by how it can be reached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import truthy


def priority(website: Column, email: Column, phone: Column, *social: Column) -> Column:
    """One point for each of website, e-mail, phone and any social link: three make it high, one medium."""
    any_social = truthy(F.coalesce(*[F.nullif(s, F.lit("")) for s in social]))
    points = sum((truthy(c).cast("int") for c in (website, email, phone)), any_social.cast("int"))
    return F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def priority_class(priority: Column) -> Column:
    """The dashboard's style of a priority."""
    return F.when(priority == "high", "priority-high").when(priority == "medium", "priority-medium").otherwise("priority-low")
