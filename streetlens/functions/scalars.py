"""Scalar rules: prices, places, dates, labels, keys."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from streetlens.constants import COUNTRY_SUFFIXES, PRICE_LEVELS, SEGMENTS, SUNDAY_FIRST_DAYS


def _first_of(*branches: tuple[Column, object], otherwise) -> Column:
    chain = reduce(lambda acc, b: acc.when(b[0], b[1]), branches[1:], F.when(*branches[0]))
    return chain.otherwise(otherwise)


def segment(rating: Column, review_count: Column) -> Column:
    """Performance segment; a comparison with null is false, so nulls end in the last segment."""
    leaders, rising, established, growth, new = SEGMENTS
    return _first_of(
        ((rating >= 4.5) & (review_count >= 50), leaders),
        ((rating >= 4.0) & (review_count < 50), rising),
        ((rating >= 3.5) & (review_count >= 50), established),
        (rating < 4.0, growth),
        otherwise=new,
    )


def price_level(enum: Column) -> Column:
    """``PRICE_LEVEL_*`` to 1..4; unknown gives null."""
    level = F.lit(None).cast("int")
    for name, value in PRICE_LEVELS.items():
        level = F.when(enum == name, value).otherwise(level)
    return level


def price_dollars(level: Column) -> Column:
    """1..4 to ``$``..``$$$$``; null or unknown gives ``$$``."""
    return F.when(level.between(1, 4), F.repeat(F.lit("$"), level)).otherwise("$$")


def price_dollars_import(level: Column) -> Column:
    """Import variant: as many ``$`` as the level; missing or 0 gives one."""
    return F.repeat(F.lit("$"), F.coalesce(F.nullif(level, F.lit(0)), F.lit(1)))


def city_region(query: Column, address: Column) -> Column:
    """``struct<city, region>`` from a city query, the region falling back to the address."""
    parts = F.split(query, ",")
    address_parts = F.split(address, ", ")
    from_address = (
        F.when(F.size(address_parts) >= 3, F.try_element_at(address_parts, F.lit(-2)))
        .when(F.size(address_parts) == 2, F.try_element_at(address_parts, F.lit(-1)))
        .otherwise("International")
    )
    region = F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).otherwise(
        F.coalesce(from_address, F.lit("International"))
    )
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("city"), region.alias("region"))


def city_state(address: Column) -> Column:
    """``struct<city, state>`` from "street, city, state zip, country" or "city, state"."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    n = F.size(parts)

    def first_word(part: Column) -> Column:
        return F.coalesce(F.nullif(F.split_part(part, F.lit(" "), F.lit(1)), F.lit("")), F.lit("Unknown State"))

    missing = F.coalesce(F.length(address) == 0, F.lit(True))
    city = (
        F.when(missing, "Unknown City")
        .when(n >= 3, F.try_element_at(parts, F.lit(-3)))
        .otherwise(F.get(parts, F.lit(0)))
    )
    state = (
        F.when(missing, "Unknown State")
        .when(n >= 2, first_word(F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).otherwise(F.get(parts, F.lit(1)))))
        .otherwise("Unknown State")
    )
    return F.struct(city.alias("city"), state.alias("state"))


def clean_city(query: Column) -> Column:
    """Lower-case, cut one country suffix, keep what stands before the first comma."""
    lowered = F.trim(F.lower(query))
    suffix = "|".join(s.replace(" ", r"\s") for s in COUNTRY_SUFFIXES)
    return F.trim(F.split_part(F.regexp_replace(lowered, f"({suffix})$", ""), F.lit(","), F.lit(1)))


def slug(url: Column, cut_query: bool = True) -> Column:
    """Last path part of a URL."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.split_part(last, F.lit("?"), F.lit(1)) if cut_query else last


def star_rating(text: Column) -> Column:
    """``4.5 star rating`` to 4.5; no match gives null."""
    return F.regexp_extract(text, r"(\d+\.?\d*) star", 1).try_cast("double")


def leading_count(text: Column) -> Column:
    """First integer of a text after removing commas; no match gives 0, null gives null."""
    digits = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("int"), F.lit(0)))


def coordinate(text: Column, name: str) -> Column:
    """``"latitude":-33.9`` in a script text; both signs accepted."""
    return F.regexp_extract(text, rf'"{name}":(-?\d+\.?\d*)', 1).try_cast("double")


def parse_date(text: Column) -> Column:
    """``MM/dd/yyyy`` or ISO-8601 to a timestamp; anything else gives null."""
    us = F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
    )
    return F.coalesce(us, text.try_cast("timestamp"))


def point(longitude: Column, latitude: Column) -> Column:
    """``struct<lon, lat>`` only where both coordinates are present and not 0."""
    usable = F.coalesce((longitude != 0) & (latitude != 0), F.lit(False))
    return F.when(usable, F.struct(longitude.alias("lon"), latitude.alias("lat")))


def stamp(existing: Column, as_of: Column) -> Column:
    return F.coalesce(existing, as_of)


def strip_prefix(source_id: Column, prefix: str = "city_search_") -> Column:
    return F.regexp_replace(source_id, f"^{prefix}", "")


def review_key(*parts: Column) -> Column:
    """Stable review id, equal in every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def period_label(date: Column, period: str = "month") -> Column:
    """``2024-03``, ``2024-03-04/2024-03-10`` (Monday to Sunday) or ``2024-03-07``."""
    if period == "month":
        return F.date_format(date, "yyyy-MM")
    if period == "week":
        monday = F.to_date(F.date_trunc("week", date))
        return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))
    if period == "day":
        return F.date_format(date, "yyyy-MM-dd")
    raise ValueError(f"unknown period {period!r}")


def hour_label(hour: Column) -> Column:
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.when(hour < 12, " AM").otherwise(" PM"))


def hours_text(periods: Column) -> Column:
    """Opening periods to ``Day: open - close`` lines, Sunday = 0; incomplete periods are left out."""
    days = F.array(*[F.lit(d) for d in SUNDAY_FIRST_DAYS])
    usable = F.filter(
        periods,
        lambda p: p["open"].isNotNull() & p["close"].isNotNull() & F.coalesce(p["open"]["day"] < 7, F.lit(True)),
    )
    line = lambda p: F.concat(
        F.get(days, F.coalesce(p["open"]["day"], F.lit(0))), F.lit(": "),
        F.coalesce(p["open"]["time"], F.lit("")), F.lit(" - "), F.coalesce(p["close"]["time"], F.lit("")),
    )
    return F.coalesce(F.transform(usable, line), F.array().cast("array<string>"))


_REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"

_NAMED = ",".join(f"{name}:{code}" for name, code in sorted(name2codepoint.items()))


def _referred(reference: Column) -> Column:
    """The sign that a character reference stands for; null for an unknown one."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    digits = F.regexp_extract(body, "^#[xX]?(.*)$", 1)
    number = F.when(F.lower(F.substring(body, 1, 2)) == "#x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    # one literal: a map written out entry by entry would be planned anew in every column that is unescaped
    named = F.str_to_map(F.lit(_NAMED), F.lit(","), F.lit(":"))
    code = F.when(F.startswith(body, F.lit("#")), number).otherwise(F.try_element_at(named, body).cast("bigint"))
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32"))


def unescape(text: Column) -> Column:
    """Character references (decimal, hexadecimal, and the named ones of HTML 4) to characters, in one pass.

    What a reference gives is not looked at again, so ``&amp;lt;`` is ``&lt;``; an unknown reference stays.
    """
    parts, references = F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    signs = F.transform(references, lambda r: F.coalesce(_referred(r), r))
    pairs = F.zip_with(parts, signs, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pairs, "")).otherwise(text)
