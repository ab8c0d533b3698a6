"""Strict JSON cells, from text or from a VARIANT.  Column builders.

A cell of the wrong type is null, never converted: the type that the variant
itself names is the gate, and only then is the value taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import MAX_MS, iso, parse_ms

#: What a JSON number is, as the type of a variant, besides decimals
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")
#: Fixed value: what is no text at a string's ends
BLANKS = " \t\n\x0b\f\r"
#: Fixed value: epoch numbers from here on are milliseconds, below seconds
MS_FROM = 1e12


def at(value: Column, path: str) -> Column:
    """The cell at a path, as a variant; null where there is none."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """The type of a cell: STRING, BIGINT, DOUBLE, BOOLEAN, VOID for null, ARRAY<...>, OBJECT<...>."""
    return F.schema_of_variant(value)


def given(value: Column) -> Column:
    """Whether there is a cell that is not null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def number_of(value: Column) -> Column:
    """A finite number, as a double."""
    of = kind(value)
    n = F.when(of.isin(*NUMBERS) | of.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))
    return F.when(F.abs(n) < float("inf"), n)


def string_of(value: Column) -> Column:
    """A string as it is."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def text_of(value: Column) -> Column:
    """A string that is not blank."""
    s = string_of(value)
    return F.when(s.rlike(r"\S"), s)


def counter_of(value: Column) -> Column:
    """A counter of zero or more, fractions cut; null for anything else."""
    n = number_of(value)
    whole = F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint")).otherwise(F.when(n < 9.2e18, n.cast("bigint")))
    return F.when(n >= 0, whole)


def optional_of(value: Column) -> Column:
    """A counter that may be missing or null, which is zero; null for anything else."""
    return F.when(given(value), counter_of(value)).otherwise(F.lit(0).cast("bigint"))


def true_of(value: Column) -> Column:
    """Whether the cell is the boolean true."""
    return F.coalesce((kind(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def epoch_ms(number: Column) -> Column:
    """Milliseconds of a positive epoch number in milliseconds or seconds; null out of range."""
    ms = F.when(number >= MS_FROM, number).otherwise(number * 1000)
    return F.when((number > 0) & (ms <= MAX_MS), ms.cast("bigint"))


def stamp_cells(value: Column) -> tuple[Column, Column]:
    """What a stamp may be: trimmed text, and a number."""
    return F.btrim(string_of(value), F.lit(BLANKS)), number_of(value)


def stamp(text: Column, number: Column) -> Column:
    """ISO text of an ISO string, a numeric string or an epoch number."""
    ms = F.coalesce(parse_ms(text), epoch_ms(F.coalesce(number, text.try_cast("double"))))
    # bound to a lambda variable, as iso names it several times and would have it parsed as often
    return F.get(F.transform(F.array(ms), iso), F.lit(0))


def number_at(json: Column, path: str) -> Column:
    """The number at a path of a JSON text, as a double; null for text, other types, and what is no JSON."""
    return number_of(at(F.try_parse_json(json), path))


def counter_at(json: Column, path: str) -> Column:
    """A counter at a path of a JSON text; null for anything else."""
    return counter_of(at(F.try_parse_json(json), path))
