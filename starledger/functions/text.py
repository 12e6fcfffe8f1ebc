"""Text columns: cell coercion, names, references, JSON details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starledger import specs

# What a float parser takes: plain, scientific, or one of the named non-finite values.
_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NAMED_NUMBER = r"(?i)^[+-]?(nan|inf|infinity)$"

CELL_DECIMAL = "decimal(28,10)"
# Holds 20 digits before the point and 18 after it.
EXACT_DECIMAL = "decimal(38,18)"


def to_number(text: Column) -> Column:
    """Text to double; NULL where it is not a number.  Java's ``1d``/``1f`` spellings are refused."""
    cell = F.trim(text)
    return F.when(cell.rlike(_PLAIN_NUMBER) | cell.rlike(_NAMED_NUMBER), cell.try_cast("double"))


def matched_number(text: Column, pattern: str = specs.NUMBER_PATTERN) -> Column:
    """Text to double where it matches ``pattern``.

    The guard and the cast sit in one CASE: the order of two filters is the optimizer's choice.
    """
    return F.when(text.rlike(pattern), text.try_cast("double"))


def matched_exact(text: Column, pattern: str = specs.NUMBER_PATTERN) -> Column:
    """The same number as a decimal where a decimal holds it, else NULL.

    Numbers with more digits than the decimal has, before the point or after it, are left to
    :func:`matched_number`; none turns into another number.
    """
    exact = text.try_cast(EXACT_DECIMAL)
    return F.when(text.rlike(pattern) & (exact.cast("double") == text.try_cast("double")), exact)


def coerce_cell(kind: str, cell: Column) -> Column:
    """One catalog cell to its column type; blank or unreadable cells become NULL."""
    trimmed = F.nullif(F.trim(cell), F.lit(""))
    if kind == "text":
        return trimmed
    if kind == "num":
        return F.when(trimmed.rlike(_PLAIN_NUMBER), trimmed.try_cast(CELL_DECIMAL))
    if kind == "int":
        return F.when(trimmed.rlike(_PLAIN_NUMBER), trimmed.try_cast("double").try_cast("bigint"))
    if kind == "tic":
        digits = F.regexp_extract(F.upper(trimmed), r"^(?:TIC)?\s*([0-9]+)$", 1)
        return F.nullif(digits, F.lit("")).try_cast("bigint")
    raise ValueError(f"unknown cell kind {kind!r}")


def decimal_text(value: Column) -> Column:
    """A decimal as text without the zeros its scale pads on."""
    text = value.cast("string")
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(F.instr(text, ".") > 0, trimmed).otherwise(text)


def norm_name(name: Column) -> Column:
    """Name key: folded case, every run of punctuation or space one blank, trimmed; NULL gives ''."""
    folded = F.replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    words = F.regexp_replace(folded, r"(?U)[^\p{L}\p{N}_\s]+", " ")
    return F.coalesce(F.trim(F.regexp_replace(words, r"(?U)\s+", " ")), F.lit(""))


def host_of_planet(name: Column) -> Column:
    """Host star name: the planet name without its trailing planet letter."""
    return F.nullif(F.trim(F.regexp_replace(name, r"\s+[a-z]$", "")), F.lit(""))


def canonical_name(planet: Column, toi: Column, koi: Column, ctoi: Column,
                   fallback: Column) -> Column:
    """Planet name, else TOI, else KOI, else CTOI designation, else the fallback."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(planet, blank),
        F.concat(F.lit("TOI "), F.nullif(toi, blank)),
        F.concat(F.lit("KOI "), F.nullif(koi, blank)),
        F.concat(F.lit("CTOI "), F.nullif(ctoi, blank)),
        fallback,
    )


def clean_reference(ref: Column) -> Column:
    """Citation text without its markup; blank becomes NULL, an empty reference stays as it is."""
    stripped = F.nullif(F.trim(F.regexp_replace(ref, "<[^>]+>", "")), F.lit(""))
    return F.when(ref == "", ref).otherwise(stripped)


def sector_number(sequence: Column, mission: Column) -> Column:
    """Observing sector: the sector column, else the digits after the last ``Sector``."""
    tail = F.regexp_replace(F.substring_index(mission, "Sector", -1), "[^0-9]", "")
    return F.coalesce(sequence.try_cast("int"), F.nullif(tail, F.lit("")).try_cast("int"))


def detail_json(**fields: Column) -> Column:
    """A JSON object of the named fields; NULL fields are left out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def solution_type(controversy_flag: Column, soltype: Column) -> Column:
    """Published solution type, overridden where the planet is flagged as disputed."""
    return F.when(controversy_flag == 1, F.lit("CONTROVERSIAL")).otherwise(soltype)
