"""Scalar functions of the domain: clocks, seasons, ages, ratios, maps, formats, vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfline.functions.text import clock_seconds


def clock_minutes(clock: Column) -> Column:
    """``mm:ss`` as minutes; parts after the second are ignored, unreadable clocks are null."""
    return clock_seconds(F.regexp_extract(F.trim(clock), r"^(\d+:\d+)", 1)) / 60


def season_year(season: Column) -> Column:
    """First four digits of a season; the compact form ``2223`` means 2022. Without four digits an error is raised."""
    compact = season.rlike(r"^\d{4}$") & (F.substring(season, 3, 2).try_cast("int") == F.substring(season, 1, 2).try_cast("int") + 1)
    text = F.nullif(F.regexp_extract(season, r"(\d{4})", 1), F.lit(""))
    year = F.when(compact, F.substring(season, 1, 2).try_cast("int") + 2000).otherwise(text.cast("int"))
    return F.when(season.isNotNull(), F.coalesce(year, F.raise_error(F.concat(F.lit("no year in season "), season)).cast("int")))


def age_years(birth: Column, as_of: Column) -> Column:
    """Whole years between two dates; born on 29 February, one ages on 1 March."""
    return F.timestamp_diff("YEAR", birth.cast("timestamp_ntz"), as_of.cast("timestamp_ntz")).cast("int")


def looked_up(value: Column, table: Mapping[str, object], what: str) -> Column:
    """Value of a fixed table; null stays null, an unknown label is an error, as a wrong guess would spoil peer groups."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]
    kind = "int" if all(isinstance(v, int) for v in table.values()) else "string"
    return F.when(value.isNotNull(), F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)).cast(kind)))


def foot_of(text: Column) -> Column:
    """left, right or both, whatever case and outer spaces; anything else is null."""
    plain = F.lower(F.trim(text))
    return F.when(plain.isin("left", "right", "both"), plain)


def lenient_date(text: Column) -> Column:
    """ISO date or timestamp; anything else is null."""
    return F.trim(text).try_cast("timestamp").try_cast("date")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator isn't positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percentile_of(rank: Column, count: Column) -> Column:
    """Percentile from 0 to 100, halves to even."""
    return F.greatest(F.least(F.rint(rank / count * 100), F.lit(100.0)), F.lit(0.0)).cast("int")


def formatted(value: Column, format: Column) -> Column:
    """Metric as shown: int, dec1, dec2 or pct; halves go up."""
    to = lambda d: F.floor(value * 10**d + 0.5) / 10**d
    shown = F.when(format == "int", F.floor(value + 0.5).cast("string")).when(format == "pct", F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit(" %")))
    shown = shown.when(format == "dec1", F.format_string("%.1f", to(1))).when(format == "dec2", F.format_string("%.2f", to(2)))
    return F.when(value.isNotNull(), shown)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is null or zero, or their lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def padded(a: Column, size: int) -> Column:
    """Array filled up with zeros to ``size`` entries."""
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def merged_maps(old: Column, new: Column) -> Column:
    """Entries of both maps, the new ones winning; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    before, after = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k)), after)


def millions(value: Column) -> Column:
    """A whole number of euros in millions with one digit, halves up: ``0.3 M€``; null stays null."""
    tenths = F.floor((F.abs(value) + 50_000) / 100_000)
    sign = F.when((value < 0) & (tenths > 0), "-").otherwise("")
    return F.when(value.isNotNull(), F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" M€")))


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves up: ``80 %``; null stays null."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit(" %"))


def french_date(day: Column) -> Column:
    """``dd/mm/yyyy``; null stays null."""
    return F.date_format(day, "dd/MM/yyyy")


def labelled(value: Column, labels: Mapping[str, str]) -> Column:
    """The label of a value; a value without one stays itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[value], value)
