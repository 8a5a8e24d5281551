"""Labels, escaping and number formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """A number rounded to a whole one, halves to even, as text."""
    return F.bround(value, 0).cast("long").cast("string")


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def escape_xml(text: Column) -> Column:
    """Text for XML; the ampersand goes first."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def peak_label(name: Column, elev_ft: Column, prom_ft: Column) -> Column:
    """A peak's name; where it has none, its height and prominence."""
    empty = name.isNull() | name.isin("", "nan", "None")
    return F.when(~empty, name).otherwise(F.concat(whole(elev_ft), F.lit("ft pk (P"), whole(prom_ft), F.lit(")")))


def class_of(frontrow: Column) -> Column:
    """front or behind; a missing flag is behind."""
    return F.when(frontrow, F.lit("front")).otherwise(F.lit("behind"))


def marker_radius(prom_ft: Column) -> Column:
    """Radius of a map marker, 3 to 11."""
    return F.greatest(F.lit(3.0), F.least(F.lit(11.0), 2 + F.sqrt(prom_ft) / 12))
