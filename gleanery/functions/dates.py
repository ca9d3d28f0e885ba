"""Timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000

# Zone names of mail-style dates (RFC 822) as offsets.
ZONE_OFFSETS = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def parse_date(value: Column) -> Column:
    """ISO 8601, or mail style with or without a weekday; otherwise null.

    The weekday is ignored, as it is redundant and sometimes wrong. Pass a plain
    column: the value is used several times.
    """
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    zone = F.upper(F.regexp_extract(bare, r"\s([A-Za-z]{1,3})$", 1))
    offsets = F.create_map(*[F.lit(part) for pair in ZONE_OFFSETS.items() for part in pair])
    offset = F.element_at(offsets, zone)
    plain = F.regexp_replace(bare, r"\s[A-Za-z]{1,3}$", "")
    zoned = F.when(offset.isNotNull(), F.concat(plain, F.lit(" "), offset)).otherwise(bare)
    looks_iso = bare.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.coalesce(
        F.when(looks_iso, bare.try_cast("timestamp")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy")),
    )


def age_in_days(value: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(value)) / F.lit(float(MICROS_PER_DAY))


def iso_utc(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def label(value: Column) -> Column:
    return F.date_format(value, "MMM d, yyyy, h:mm a")
