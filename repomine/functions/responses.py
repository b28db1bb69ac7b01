"""Values out of landed JSON bodies and Link headers, with the defaults for missing or broken ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_or_default(text: Column, default: int = 0) -> Column:
    """Integer part of a JSON number given as text, or the default."""
    return F.coalesce(text.try_cast("decimal(38,6)").try_cast("int"), F.lit(default))


def json_text(body: Column, key: str) -> Column:
    """Text of a field; null when it is missing."""
    return F.get_json_object(body, f"$.{key}")


def json_int(body: Column, key: str, default: int = 0) -> Column:
    return int_or_default(json_text(body, key), default)


def succeeded(status: Column) -> Column:
    return status.between(200, 299)


def has_next(link: Column) -> Column:
    return F.coalesce(F.contains(link, F.lit('rel="next"')), F.lit(False))


def last_page(link: Column) -> Column:
    """Number after the last ``page=``, up to the next ``&`` or else ``>``; 0 when it is no integer."""
    tail = F.substring_index(link, "page=", -1)
    digits = (
        F.when(~F.contains(link, F.lit("page=")), F.lit(None))
        .when(F.contains(tail, F.lit("&")), F.substring_index(tail, "&", 1))
        .when(F.contains(tail, F.lit(">")), F.substring_index(tail, ">", 1))
    )
    # Blanks around the digits would pass the cast, so the text is checked first.
    number = F.when(F.rlike(digits, F.lit(r"^[+-]?[0-9]+\z")), digits.try_cast("int"))
    return F.coalesce(number, F.lit(0))


def commit_count(link: Column, body: Column) -> Column:
    """Commits of a repository from a response that lists one commit per page."""
    paged = F.coalesce(F.contains(link, F.lit('rel="last"')), F.lit(False))
    return (
        F.when(paged, last_page(link))
        .otherwise(F.coalesce(F.json_array_length(body), F.lit(0)))
        .cast("bigint")
    )
