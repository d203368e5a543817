"""Numbers, dates, levels and units as they stand in source pages; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column, kind: str = "bigint") -> Column:
    return c.try_cast(kind)


def signed_number(c: Column) -> Column:
    return _int(F.regexp_replace(c, "[^0-9-]", ""))


def unsigned_number(c: Column) -> Column:
    return F.coalesce(_int(F.regexp_replace(c, "[^0-9]", "")), F.lit(0).cast("bigint"))


def units(c: Column) -> Column:
    return _int(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1))


def level(c: Column) -> Column:
    low = F.lower(c)
    out = low
    for name in ("silver", "gold", "platinum", "diamond"):
        out = F.when(low.contains(name), name).otherwise(out)
    return out


def source_date(c: Column) -> Column:
    c = F.replace(c, F.lit("/"), F.lit("-"))
    return F.when(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c))


def friday(c: Column) -> Column:
    """The same day or the Friday before."""
    return F.date_sub(c, (F.dayofweek(c) + 1) % 7)


def first_int(c: Column) -> Column:
    return _int(F.nullif(F.regexp_extract(F.replace(c, F.lit(",")), r"(\d+)", 1), F.lit("")), "int")


def award_level(desc: Column) -> Column:
    """struct(level, units) of a share text, from the part between RIAA and Award (a song called Gold is no gold award)."""
    part = F.lower(F.regexp_extract(desc, r"(?i)RIAA(.*?)Award", 1))
    n = F.coalesce(_int(F.nullif(F.regexp_extract(part, r"(\d+)x platinum", 1), F.lit("")), "int"), F.lit(1))
    kind = F.when(part.contains("diamond"), "diamond").when(part.contains("gold"), "gold").when(part.contains("platinum"), "platinum").otherwise("")
    return F.struct(kind.alias("level"), F.when(kind == "platinum", n).alias("units"))


def any_date(c: Column) -> Column:
    """A date as written out ("January 5, 2024"), in ISO form, or with slashes; null for anything else."""
    return F.coalesce(F.try_to_date(c, "MMMM d, yyyy"), F.try_to_date(c, "MMM d, yyyy"), F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "M/d/yyyy"))


#: Hours that the source adds for the zones it names.
ZONES = {"EDT": -4, "EST": -5, "UTC": 0, "GMT": 0, "BST": 1, "CET": 1, "CEST": 2}


def page_time(hhmm: Column, zone: Column, day: Column) -> Column:
    """The time of a page header on ``day`` with the zone's hours added (the source adds them, where a conversion to UTC would
    subtract); null for other zones."""
    hours = F.coalesce(*[F.when(zone == z, F.lit(h)) for z, h in ZONES.items()])
    minute = _int(F.split_part(hhmm, F.lit(":"), F.lit(1))) * 60 + _int(F.split_part(hhmm, F.lit(":"), F.lit(2))) + hours * 60
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + minute * 60)


def header_meta(heading: Column, day: Column) -> Column:
    """struct(page_time, chart_date) of a chart page's heading."""
    at = F.nullif(F.regexp_extract(heading, r"\|\s*([0-9]{2}:[0-9]{2})\s+([A-Z]{3})", 1), F.lit(""))
    zone = F.regexp_extract(heading, r"\|\s*([0-9]{2}:[0-9]{2})\s+([A-Z]{3})", 2)
    date = F.try_to_date(F.regexp_extract(heading, r"(\d{4}-\d{2}-\d{2})", 1))
    return F.struct(page_time(at, zone, day).alias("page_time"), date.alias("chart_date"))
