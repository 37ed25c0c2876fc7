"""Text labels and category bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges and labels of the sales report. Edges are right-closed.
DISCOUNT_RATE_EDGES = [-0.001, 0.0, 0.05, 0.10, 0.15, 0.20, float("inf")]
DISCOUNT_RATE_LABELS = ["0%", "0-5%", "5-10%", "10-15%", "15-20%", ">20%"]
DISCOUNT_AMOUNT_EDGES = [-0.001, 0.0, 5.0, 10.0, 20.0, 50.0, float("inf")]
DISCOUNT_AMOUNT_LABELS = ["0", "0-5", "5-10", "10-20", "20-50", ">50"]
PROFIT_RATIO_EDGES = [float("-inf"), -0.2, 0.0, 0.1, 0.2, float("inf")]
PROFIT_RATIO_LABELS = ["Perdida alta", "Perdida baja", "Margen bajo", "Margen medio", "Margen alto"]
PRICE_BANDS = ["Precio muy bajo", "Precio bajo", "Precio medio", "Precio alto", "Precio muy alto"]
CUSTOMER_BANDS = [
    "Comprador muy bajo", "Comprador bajo", "Comprador medio", "Comprador alto", "Comprador muy alto",
]
MISSING_LABEL = "Sin dato"


def cut(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]``; outside all of them, null."""
    out = F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
    if edges[0] != float("-inf"):
        out = out.when(c <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(c <= F.lit(upper), label) if upper != float("inf") else out.otherwise(label)
    return out


def has_discount(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0.0)) > 0


def short_label(c: Column, max_len: int = 42) -> Column:
    text = c.cast("string")
    short = F.concat(F.substring(text, 1, max_len - 3), F.lit("..."))
    return F.when(text.isNull(), MISSING_LABEL).when(F.length(text) > max_len, short).otherwise(text)


def strip_prefix_title(c: Column, prefix: str) -> Column:
    """Drop every occurrence of the prefix and title-case the rest."""
    return F.initcap(F.replace(c, F.lit(prefix), F.lit("")))


def one_hot(c: Column, categories: Sequence[str], prefix: str) -> dict[str, Column]:
    """One boolean per category; a null value is false in all of them."""
    return {
        f"{prefix}_{value.lower()}": F.coalesce(c == F.lit(value), F.lit(False)) for value in categories
    }


def argmax_label(flags: Sequence[str], prefix: str, empty: str = "Unknown") -> Column:
    """Name of the first true flag column, without its prefix; none true gives ``empty``."""
    out = None
    for name in flags:
        label = strip_prefix_title(F.lit(name), prefix)
        out = F.when(F.col(name), label) if out is None else out.when(F.col(name), label)
    return out.otherwise(empty)


def ordinal_of(c: Column, values: Sequence[str]) -> Column:
    """Position of the value in a fixed order; unknown values come last."""
    out = None
    for position, value in enumerate(values):
        hit = c.cast("string") == F.lit(value)
        out = F.when(hit, position) if out is None else out.when(hit, position)
    return out.otherwise(len(values))


def relabel(c: Column, mapping: dict[str, str]) -> Column:
    """Replace known values, keep the others."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), new) if out is None else out.when(c == F.lit(old), new)
    return out.otherwise(c)
