"""Heights written by hand: the number, the unit it is stated in, and conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a unit. Fixed values.
METRES = {"m": 1.0, "ft": 0.3048, "km": 1000.0, "dm": 0.1, "cm": 0.01}
UNITS = tuple(METRES)

#: Words for a unit, by unit. Fixed values.
WORDS = {
    "km": r"km|kms|kilom[eéè]t\p{L}*",
    "dm": r"dm|d[eéè][cz]im[eéè]t\p{L}*|tenths? of (?:a )?m\p{L}*|x ?0\.1 ?m|zehntelmeter|multiplied by ten",
    "cm": r"cm|[cz]entim[eéè]t\p{L}*",
    "ft": r"ft|feet|foot|fu(?:ß|ss)|pieds?|pies?|imperial",
    "m": r"m|m[eéè]t(?:er|re|ro)\p{L}*|metric|m\.?s\.?n\.?m|mamsl|masl",
}


def _has(text: Column, words: str) -> Column:
    return text.rlike(rf"(?i)(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")


def number_in(text: Column) -> Column:
    """The first number of a text. A comma before exactly three digits parts thousands, unless the text speaks of kilometres; any other is a decimal comma."""
    raw = F.regexp_extract(text, r"([0-9][0-9.,' ’]*[0-9]|[0-9])", 1)
    tight = F.regexp_replace(raw, r"[ '’]", "")
    plain = F.when(~_has(text, WORDS["km"]), F.regexp_replace(tight, r",(?=[0-9]{3}(?![0-9]))", "")).otherwise(tight)
    return F.regexp_replace(plain, ",", ".").try_cast("double")


def stated_unit(text: Column) -> Column:
    """The unit that a written height names; NULL for a bare number."""
    bare = F.regexp_replace(F.lower(text), r"[0-9.,]+", " ")
    return (
        F.when(bare.rlike(r"['′’]"), F.lit("ft"))
        .when(_has(bare, WORDS["km"]), F.lit("km"))
        .when(_has(bare, WORDS["dm"]), F.lit("dm"))
        .when(_has(bare, WORDS["cm"]), F.lit("cm"))
        .when(_has(bare, WORDS["ft"]), F.lit("ft"))
        .when(_has(bare, WORDS["m"]), F.lit("m"))
    )


def unit_of_remark(text: Column) -> Column:
    """The unit that a free remark names for the height; a unit right after a number ("3 m cairn") measures something else, and a negated one is not it."""
    t = F.regexp_replace(F.lower(text), r"(?<![x×.])\b[0-9]+(?:[.,][0-9]+)? ?\p{L}+", " ")
    t = F.regexp_replace(t, r"\b(?:not|nicht|pas|non?|statt|instead of)\b(?: in| en)? \p{L}+", " ")
    return (
        F.when(_has(t, WORDS["dm"]) | F.lower(text).rlike(r"x ?0\.1 ?m"), F.lit("dm"))
        .when(_has(t, WORDS["km"]), F.lit("km"))
        .when(_has(t, WORDS["cm"]), F.lit("cm"))
        .when(_has(t, WORDS["ft"]), F.lit("ft"))
        .when(_has(t, WORDS["m"]), F.lit("m"))
    )


def unit_of_note(note: Column) -> Column:
    """The unit that a source's note gives for heights: that of the first clause that names one and does not speak of prominence alone; `mixed` if it speaks of exceptions."""
    clauses = F.filter(
        F.split(F.lower(note), r"[;,]"),
        lambda c: ~(c.rlike(r"prominence|schart|pro[eé]min|prominencia") & ~c.rlike(r"height|elev|gipfel|hauteur|altitud|altura")),
    )
    units = F.filter(F.transform(clauses, unit_of_remark), lambda u: u.isNotNull())
    return F.when(F.lower(note).rlike(r"\b(?:mixed|a few|some|partly|gemischt|einige|teils|mixte|quelques|mezcla|algun[ao]s)\b"), F.lit("mixed")).otherwise(F.try_element_at(units, F.lit(1)))


def to_metres(value: Column, unit: Column) -> Column:
    """A value of a unit in metres."""
    out = F.lit(None).cast("double")
    for u, k in METRES.items():
        out = F.when(unit == u, value * F.lit(k)).otherwise(out)
    return out
