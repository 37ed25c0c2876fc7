"""Small column helpers for text operators."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ASCII white space characters that word and line rules name.
SPACE = " \t\n\x0b\x0c\r"


def free_name(df: DataFrame, name: str) -> str:
    """A helper column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def without(columns: list[str], names: Iterable[str]) -> list[str]:
    """``columns`` but those that have one of ``names``, whatever the case: Spark does not tell cases apart."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def strip_space(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE))


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in, the rest a translation."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(
        F.translate(value, string.ascii_uppercase, string.ascii_lowercase)
    )
