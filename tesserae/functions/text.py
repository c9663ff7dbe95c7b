"""Names, identifiers and date sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def lat_lon(x: Column) -> tuple[Column, Column]:
    """Two numbers of a "lat, lon" text; anything else is null."""
    parts = F.split(x, ",")
    two = F.size(parts) == 2
    number = lambda i: F.when(two, F.trim(F.get(parts, F.lit(i))).try_cast("double"))
    return number(0), number(1)


def tile_id(r: Column, c: Column, h: Column, w: Column) -> Column:
    return F.format_string("r%05d_c%05d_h%04d_w%04d", r, c, h, w)


def days(start: Column, end_exclusive: Column) -> Column:
    """Half-open daily sequence; empty where the end isn't after the start."""
    return F.when(end_exclusive > start, F.sequence(start, F.date_sub(end_exclusive, 1))).otherwise(F.array().cast("array<date>"))
