"""Least squares on every expanding window at the price of one.

Retraining a linear model each month on all earlier months reads the first months again in
every fold. But a least-squares fit needs only the cross products of its columns, and
those of an expanding window are sums over its months. So the tasks add up cross products
per month in one pass, the driver solves one small system per fold, and a second pass scores each
month with the coefficients of its own fold. The fit is the same as refitting each fold: rare
categories are pooled by their count inside the fold's training months.

It fits narrow models: cross products take ``slots ** 2`` cells per month. Wider ones go
through ``walk_forward_models``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadline.operators.cross_products import add_products, category_codes
from leadline.operators.features import Encoding, category_counts
from leadline.operators.split import month_folds

MAX_SLOTS = 512


class _Design:
    """Intercept, one slot per category, centred numbers: batches of rows as slots and numbers."""

    def __init__(self, vocabularies: dict[str, list[str]], numbers: Sequence[str], centre: np.ndarray, scale: np.ndarray):
        self.vocabularies, self.numbers, self.centre, self.scale = vocabularies, list(numbers), centre, scale
        self.groups, at = [], 1
        for values in vocabularies.values():
            self.groups.append(slice(at, at + len(values)))
            at += len(values)
        self.first_number, self.slots = at, at + len(self.numbers)

    def codes(self, batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
        """The slot of each row's category per column, -1 for one that is not in the vocabulary."""
        return [
            category_codes(batch.column(name), pa.array(values, pa.string()), np.arange(group.start, group.stop), -1)
            for name, values, group in zip(names, self.vocabularies.values(), self.groups)
        ]

    def numbers_of(self, batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
        """Centred and scaled numbers, a row each."""
        x = np.empty((batch.num_rows, len(self.numbers)))
        for k, name in enumerate(names):
            x[:, k] = (batch.column(name).to_numpy(zero_copy_only=False) - self.centre[k]) / self.scale[k]
        return x


def _cross_products(rows: DataFrame, month: str, design: _Design) -> pd.DataFrame:
    """Per month, the products of all slots and the target: _m, cell (row * side + column) and v."""
    side, names = design.slots + 1, list(design.vocabularies)
    ranges = [(group.start, group.stop) for group in design.groups]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            codes, y = design.codes(batch, names), batch.column("_y").to_numpy()
            numbers = np.column_stack([design.numbers_of(batch, design.numbers), y])
            months = batch.column("_m").dictionary_encode()
            at = months.indices.to_numpy()
            for k, name in enumerate(months.dictionary.to_pylist()):
                here = np.flatnonzero(at == k) if len(months.dictionary) > 1 else slice(None)
                own = sums.setdefault(name, np.zeros((side, side)))
                ones = np.zeros(len(at), np.int64)[here]  # the intercept is a category that all rows have
                add_products(own, [ones, *[c[here] for c in codes]], [(0, 1), *ranges], numbers[here], design.first_number)
        for name, cells in sums.items():
            full = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(cells.reshape(-1)[full])], names=["_m", "cell", "v"]
            )

    return rows.mapInArrow(add_up, "_m string, cell int, v double").groupBy("_m", "cell").agg(F.sum("v").alias("v")).toPandas()


def _solve(gram: np.ndarray, design: _Design, min_rows: int) -> np.ndarray:
    """Coefficients per slot for one training window, rare and unseen categories sharing one."""
    n, width = gram[0, 0], design.slots
    columns = [np.eye(width)[0]]
    for group in design.groups:
        seen = gram[0, group]
        usual = int(np.argmax(seen)) if len(seen) else -1
        pool = np.zeros(width)
        for i, k in enumerate(seen):
            if k >= min_rows or i == usual:
                columns.append(np.eye(width)[group.start + i])
            else:
                pool[group.start + i] = 1.0
        columns.append(pool)
    columns.extend(np.eye(width)[design.first_number :])
    to_slots = np.array(columns).T
    a = to_slots.T @ gram[:width, :width] @ to_slots / n
    b = to_slots.T @ gram[:width, width] / n
    return to_slots @ np.linalg.lstsq(a, b, rcond=1e-12)[0]


def expanding_least_squares(rows: DataFrame, month: str, target: str, spec: Encoding, keep: Sequence[str] = (), initial: int = 12,
                            name: str = "Linear Regression walk-forward") -> DataFrame:
    """Long predictions of every month after the first ``initial``, each from all months before it.

    Numbers must not be null. Predictions are clipped at 0.
    """
    categorical, numeric = list(spec.categorical), list(spec.numeric)
    counts = category_counts(rows, categorical)
    # Nulls take the most frequent category of the whole table; centring changes no fit.
    vocabularies = {c: sorted(counts[c]) for c in categorical}
    usual = {c: min(counts[c], key=lambda v, k=counts[c]: (-k[v], v)) for c in categorical if counts[c]}
    moments = rows.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(numeric)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(numeric)],
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{i}") for i, c in enumerate(numeric)],
    ).first()
    empty = [c for i, c in enumerate(numeric) if moments[f"n_{i}"]]
    if empty:
        raise ValueError(f"numbers with nulls: {empty}")
    centre = np.array([moments[f"m_{i}"] for i in range(len(numeric))], dtype=float)
    scale = np.array([moments[f"s_{i}"] or 1.0 for i in range(len(numeric))], dtype=float)
    design = _Design(vocabularies, numeric, centre, scale)
    if design.slots > MAX_SLOTS:
        raise ValueError(f"{design.slots} slots; above {MAX_SLOTS} use walk_forward_models")

    text = [F.coalesce(F.col(c).cast("string"), F.lit(usual.get(c))).alias(c) for c in categorical]
    numbers = [F.col(c).cast("double").alias(c) for c in numeric]
    ready = rows.filter(F.col(month).isNotNull() & F.col(target).isNotNull())
    cells = _cross_products(ready.select(F.col(month).alias("_m"), F.col(target).cast("double").alias("_y"), *text, *numbers), month, design)

    side = design.slots + 1
    by_month = {}
    for m, part in cells.groupby("_m"):
        gram = np.zeros(side * side)
        gram[part["cell"]] = part["v"]
        gram = gram.reshape(side, side)
        by_month[m] = gram + gram.T - np.diag(np.diag(gram))
    coefficients, total, months = {}, np.zeros((side, side)), sorted(by_month)
    for fold in month_folds(ready, month, initial):
        while months and months[0] <= fold["train_end"]:
            total = total + by_month[months.pop(0)]
        coefficients[fold["test_start"]] = (fold["fold"], _solve(total, design, spec.min_rows))

    test = ready.filter(F.col(month).isin(list(coefficients)))
    shown = [F.col(c) if isinstance(c, str) else c for c in keep]
    base = test.select(*shown, F.col(month).alias("_m"), F.col(target).cast("double").alias("actual"),
                       F.struct(*text, *numbers).alias("_x"))
    kept = [f for f in base.schema.fields if f.name not in ("_m", "_x", "actual")]
    schema = T.StructType(
        [*kept, T.StructField(month, T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("actual", T.DoubleType()),
         T.StructField("model", T.StringType()), T.StructField("predicted", T.DoubleType())]
    )
    flat = base.select(*[f.name for f in kept], "_m", "actual", *[F.col(f"_x.{c}").alias(f"_x_{c}") for c in categorical + numeric])

    inputs = [f"_x_{c}" for c in categorical + numeric]
    names = sorted(coefficients)
    fold_of = np.array([coefficients[m][0] for m in names], np.int32)
    betas = np.array([coefficients[m][1] for m in names]).reshape(len(names), design.slots)
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = category_codes(batch.column("_m"), pa.array(names, pa.string()), np.arange(len(names)), -1)
            value = betas[at, 0]
            # Categories new to the test month are slots too: they carry the pool's coefficient.
            for code in design.codes(batch, inputs[: len(categorical)]):
                value = value + np.where(code >= 0, betas[at, code], 0.0)
            x = design.numbers_of(batch, inputs[len(categorical) :])
            for k in range(x.shape[1]):
                value = value + x[:, k] * betas[at, design.first_number + k]
            columns = [batch.column(f.name) for f in kept]
            columns += [batch.column("_m"), pa.array(fold_of[at]), batch.column("actual"), pa.array([name] * batch.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.maximum(value, 0.0))], schema=arrow)

    return flat.mapInArrow(score, schema)
