"""Identifiers, hashes, links, bylines, descriptions, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 32 bits.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF
#: URLs in a sitemap file.
SITEMAP_URLS = 49_999


def fnv32(s: Column) -> Column:
    """FNV-1a of the UTF-8 bytes; '' is 0 (no value) and a hash of 0 becomes 1."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(s, F.lit("")), "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    h = F.aggregate(pairs, F.lit(FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK)))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.greatest(h, F.lit(1).cast("long")))


def parse_id(s: Column) -> Column:
    """The number of W123, 123 or an address that ends so; null if there is none."""
    return F.regexp_extract(F.element_at(F.split(s, "/"), -1), r"^W?(\d{1,18})$", 1).try_cast("long")


def topic_number(s: Column) -> Column:
    """The number of T123 or an address that ends so; 0 if there is none or it is over 65535."""
    n = F.regexp_extract(F.element_at(F.split(F.coalesce(s, F.lit("")), "/"), -1), r"^T?(\d{1,9})$", 1).try_cast("long")
    return F.when(n <= 65535, n).otherwise(0).cast("int")


def description(s: Column, limit: int = 300, least: int = 200) -> Column:
    """Texts over ``limit`` bytes are cut at the last space within them, but not before ``least``, and get an ellipsis.

    A character cut within becomes the replacement character.
    """
    raw = F.encode(s, "UTF-8")
    pairs = F.regexp_extract_all(F.hex(F.substring(raw, 1, limit)), F.lit("[0-9A-F]{2}"), F.lit(0))
    from_end = F.array_position(F.reverse(pairs), "20")
    cut = F.greatest(F.when(from_end > 0, F.lit(limit) - from_end).otherwise(0), F.lit(least)).cast("int")
    head = F.make_valid_utf8(F.substring(raw, F.lit(1), cut).cast("string"))
    return F.when(F.octet_length(s) > limit, F.concat(head, F.lit("…"))).otherwise(s)


def link(pdf: Column, url: Column, doi: Column, other: Column) -> Column:
    """The first that is not blank: pdf, page, doi, the catalogue's own page."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(pdf), blank(url), blank(doi), other)


def byline(authors: Column, venue: Column, year: Column) -> Column:
    """Authors, venue and year, those that there are, with middle dots."""
    parts = F.array(F.array_join(authors, ", "), venue, F.when(year != 0, year.cast("string")).otherwise(""))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " · ")


def thousands(n: Column) -> Column:
    """331210 as 331,210."""
    return F.format_number(n, 0)


def sitemap_chunk(row: Column) -> Column:
    """The sitemap file of the row-th page; the first also has the home page."""
    return F.floor(row / SITEMAP_URLS).cast("long")


def ago(seconds: Column) -> Column:
    step = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, step(60, "m")).when(seconds < 86400, step(3600, "h")).otherwise(step(86400, "d"))


def one_decimal(x: Column) -> Column:
    """A number that is not negative with one decimal, rounded as C's printf does: by its exact binary value, a half to the even digit.

    ``format_string`` rounds the shortest decimal notation instead: 1.65, which is a little less in binary, as 1.7.
    """
    whole = F.floor(x)
    part = x - whole  # exact, and so are both terms of its tenfold, as the first has 20 binary places
    high = F.floor(part * 2**20) / 2**20
    digit = F.floor(part * 10)
    over = (high * 10 - (digit + 0.5)) + (part - high) * 10
    tenths = whole * 10 + digit + ((over > 0) | ((over == 0) & (digit % 2 == 1))).cast("long")
    said = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(x < 2**46, said).otherwise(F.format_string("%.1f", x.cast("double")))


def duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 90, F.concat(F.round(seconds).cast("long").cast("string"), F.lit("s")))
        .when(seconds < 5400, F.concat(F.round(seconds / 60).cast("long").cast("string"), F.lit(" min")))
        .when(seconds < 2 * 86400, F.concat(one_decimal(seconds / 3600), F.lit(" h")))
        .otherwise(F.concat(one_decimal(seconds / 86400), F.lit(" days")))
    )


def nice_max(n: Column) -> Column:
    """The least round number (one digit, then zeros) that is no smaller."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(n)))
    return F.when(n > 0, F.ceil(n / power) * power).otherwise(F.lit(1.0)).cast("double")


def unit_hash(*parts: Column) -> Column:
    """A number within (0, 1) that depends on the parts alone: (fnv32 + 0.5) / 2**32."""
    return (fnv32(F.concat_ws("|", *[p.cast("string") for p in parts])) + F.lit(0.5)) / F.lit(4294967296.0)
