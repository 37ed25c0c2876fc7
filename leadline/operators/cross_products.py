"""Linear, ridge and lasso regression from sums of cross products.

A least-squares fit needs only counts per pair of categories, sums of the numbers per category, and sums of
products of numbers. Each task adds them up in numpy over Arrow batches and one grouped aggregation adds the tasks' sums, so
what is shuffled is as large as the model, not as the table; pairs that never occur are never written. The driver
solves the small system: least norm for linear, a ridge on the diagonal, coordinate descent on the matrix for lasso. One set
of sums serves all three.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.operators.features import INFREQUENT, FittedEncoding

# Cells that a task adds up before it writes them; a wider matrix is written batch by batch.
DENSE_CELLS = 4_000_000
# The matrix has this number of rows and columns at most; wider models need an iterative solver.
MAX_SLOTS = 4096


@dataclass
class Design:
    """Where a fitted encoding's columns go: one slot per category, then one per number."""

    encoding: FittedEncoding
    means: np.ndarray
    scales: np.ndarray

    def __post_init__(self):
        spec = self.encoding.spec
        self.ordinal = spec.kind == "ordinal"
        self.categorical = [] if self.ordinal else list(spec.categorical)
        self.slot = {name: k for k, name in enumerate(self.encoding.slots)}
        self.numbers = self.encoding.slots[len(self.encoding.slots) - len(self.scales) :]

    def place(self, column: str, value: str) -> int | None:
        """The slot of a category; None for one that the encoding leaves at zeros."""
        return self.slot.get(f"{column}={value}", self.slot.get(f"{column}={INFREQUENT}") if self.encoding.spec.unknown_to_pool else None)

    def number(self, k: int) -> Column:
        return (F.col(f"_z{k}") - F.lit(float(self.means[k]))) / F.lit(float(self.scales[k]))


def numeric_inputs(encoding: FittedEncoding) -> list[Column]:
    """The number columns of a coded table, and the codes of its categories if they are ordinal."""
    spec = encoding.spec
    codes = [F.col(f"_o_{c}") for c in spec.categorical] if spec.kind == "ordinal" else []
    return [*codes, *[F.col(f"_m_{c}") for c in spec.numeric]]


def coded(df: DataFrame, encoding: FittedEncoding, keep: list[Column]) -> DataFrame:
    """``keep`` in the struct _kept, categories as _c_<name>, numbers as _z0, _z1, ..."""
    table = encoding.codes(df) if encoding.spec.kind == "ordinal" else encoding.prepare(df)
    categories = [] if encoding.spec.kind == "ordinal" else [F.col(f"_c_{c}") for c in encoding.spec.categorical]
    kept = F.struct(*keep) if keep else F.lit(None)
    return table.select(kept.alias("_kept"), *categories, *[v.alias(f"_z{k}") for k, v in enumerate(numeric_inputs(encoding))])


@dataclass
class Sums:
    """n, mean of the target, and per slot: means, centred cross products (all divided by n)."""

    design: Design
    n: int
    target_mean: float
    slot_means: np.ndarray
    gram: np.ndarray
    with_target: np.ndarray


def category_codes(column: pa.Array, values: pa.Array, slots: np.ndarray, other: int) -> np.ndarray:
    """The slot of each category of a batch; ``other`` for those not in ``values``. -1 is no slot."""
    coded = column.dictionary_encode()
    known = pc.index_in(coded.dictionary, value_set=values).to_numpy(zero_copy_only=False)
    at = np.where(np.isnan(known), -1, known).astype(np.int64)
    of_word = np.where(at >= 0, slots[at] if len(slots) else other, other)
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(codes >= 0, of_word[codes] if len(of_word) else other, other).astype(np.int64)


def add_products(sums: np.ndarray, codes: Sequence[np.ndarray], ranges: Sequence[tuple[int, int]], numbers: np.ndarray, base: int) -> None:
    """Add a batch to the products of all slots, where row slot <= column slot.

    ``codes`` are the category slots of the rows, -1 for none, inside the ascending ``ranges``; ``numbers`` (rows x k)
    have the slots from ``base`` on.
    """
    for i, (one, (low, high)) in enumerate(zip(codes, ranges)):
        rows = np.flatnonzero(one >= 0)
        here = one[rows] - low
        diagonal = np.arange(low, high)
        sums[diagonal, diagonal] += np.bincount(here, minlength=high - low)
        for other, (left, right) in zip(codes[i + 1 :], ranges[i + 1 :]):
            both = other[rows] >= 0
            cell = here[both] * (right - left) + other[rows[both]] - left
            if (high - low) * (right - left) <= 16 * max(len(rows), 1):
                sums[low:high, left:right] += np.bincount(cell, minlength=(high - low) * (right - left)).reshape(high - low, right - left)
            else:
                cell, times = np.unique(cell, return_counts=True)
                sums[low + cell // (right - left), left + cell % (right - left)] += times
        for k in range(numbers.shape[1]):
            sums[low:high, base + k] += np.bincount(here, numbers[rows, k], high - low)
    sums[base:, base:] += np.triu(numbers.T @ numbers)


def _moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample deviations of columns without nulls, added up inside tasks; 0 where there are too few rows."""
    k = len(df.columns)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, origin, one, two = 0, None, np.zeros(k), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                # Around a value of the task, so that a column of equal values has exactly no deviation.
                origin = x[:, 0].copy() if origin is None else origin
                x -= origin[:, None]
                n, one, two = n + batch.num_rows, one + x.sum(axis=1), two + (x * x).sum(axis=1)
        if n:
            cells = [pa.array([a], pa.list_(pa.float64())) for a in (origin + one / n, np.maximum(two - one * one / n, 0.0))]
            yield pa.RecordBatch.from_arrays([pa.array([n]), *cells], names=["n", "mean", "squares"])

    total, mean, squares = 0, np.zeros(k), np.zeros(k)
    for r in df.mapInArrow(add_up, "n long, mean array<double>, squares array<double>").collect():
        both, apart = total + r["n"], np.array(r["mean"]) - mean
        squares += np.array(r["squares"]) + (apart * apart * (total * r["n"] / both) if total else 0.0)
        mean = mean + apart * (r["n"] / both) if total else np.array(r["mean"])
        total = both
    return total, mean, np.sqrt(squares / (total - 1)) if total > 1 else np.zeros(k)


def cross_products(train: DataFrame, target: str, encoding: FittedEncoding) -> Sums:
    """All sums of the rows with a target. ``train`` is read twice."""
    rows = coded(train.filter(F.col(target).isNotNull()), encoding, [F.col(target).cast("double").alias("y")]).withColumn("_y", F.col("_kept.y"))
    m = len(numeric_inputs(encoding))
    n, centres, deviations = _moments(rows.select(*[f"_z{k}" for k in range(m)], "_y"))
    means, target_mean = centres[:m], float(centres[m])
    spread = np.where(deviations[:m] > 0, deviations[:m], 1.0) if encoding.spec.scale else np.ones(m)
    design = Design(encoding, means, spread)
    p = len(encoding.slots)
    base, names = p - m, design.categorical
    vocabularies = {c: _slots_of(design, c) for c in names}
    ranges = [_range_of(design, c) for c in names]
    # The target is one more number, after the last slot; numbers are centred already, so their means are 0.
    centre, scale, width = np.append(means, target_mean), np.append(spread, 1.0), p + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        for batch in batches:
            codes = [category_codes(batch.column(f"_c_{c}"), *vocabularies[c]) for c in names]
            columns = [batch.column(f"_z{k}") for k in range(m)] + [batch.column("_y")]
            numbers = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            add_products(sums, codes, ranges, (numbers - centre) / scale, base)
            if sums.size > DENSE_CELLS:
                yield _cells(sums)
                sums[:] = 0.0
        yield _cells(sums)

    slim = rows.select(*[f"_c_{c}" for c in names], *[f"_z{k}" for k in range(m)], "_y")
    added = slim.mapInArrow(add_up, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros(width * width)
    full[added.column("cell").to_numpy()] = added.column("v").to_numpy()
    full = full.reshape(width, width)
    full = full + full.T - np.diag(np.diag(full))
    count = max(n, 1)
    slot_means = np.append(np.diag(full)[:base], np.zeros(m)) / count
    return Sums(design, n, target_mean, slot_means, full[:p, :p] / count - np.outer(slot_means, slot_means), full[:p, p] / count)


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    flat = sums.reshape(-1)
    full = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(full), pa.array(flat[full])], names=["cell", "v"])


def _range_of(design: Design, column: str) -> tuple[int, int]:
    before = 0
    for c in design.categorical:
        size = len(design.encoding.labels[c]) + design.encoding.spec.unknown_to_pool
        if c == column:
            return before, before + size
        before += size
    raise KeyError(column)


def _slots_of(design: Design, column: str) -> tuple[pa.Array, np.ndarray, int]:
    """Categories of a column, their slots, and the slot of all others (-1: none)."""
    low, high = _range_of(design, column)
    found = [(name[len(column) + 1 :], k) for name, k in design.slot.items() if low <= k < high]
    pool = design.place(column, INFREQUENT) if design.encoding.spec.unknown_to_pool else None
    return pa.array([v for v, _ in found], pa.string()), np.array([k for _, k in found], np.int64), -1 if pool is None else pool


@dataclass
class LinearFit:
    """Coefficients per slot of scaled, centred numbers and of categories; ``penalty`` as in ``solve``."""

    design: Design
    coefficients: np.ndarray
    intercept: float
    family: str
    penalty: float

    def predict(self, df: DataFrame, keep: list[Column], clip: bool = True) -> DataFrame:
        """``keep`` and the column ``predicted``. Coefficients of categories are joined, so Spark broadcasts them by size."""
        return self.scored(df, keep, clip).select("_kept.*", "predicted")

    def scored(self, df: DataFrame, keep: list[Column], clip: bool = True) -> DataFrame:
        """The coded table and ``predicted``."""
        table = coded(df, self.design.encoding, keep)
        return self._joined(table, clip) if self.design.categorical else table.withColumn("predicted", self._score(clip))

    def _numbers(self) -> Column:
        m = len(self.design.scales)
        out = F.lit(float(self.intercept))
        for k, beta in enumerate(self.coefficients[len(self.coefficients) - m :]):
            out = out + F.lit(float(beta)) * self.design.number(k)
        return out

    def _score(self, clip: bool, more: Column | None = None) -> Column:
        value = self._numbers() if more is None else self._numbers() + more
        return F.greatest(value, F.lit(0.0)) if clip else value

    def _joined(self, table: DataFrame, clip: bool) -> DataFrame:
        d, more, shown = self.design, F.lit(0.0), table.columns
        for i, c in enumerate(d.categorical):
            prefix = f"{c}="
            betas = [(name[len(prefix) :], float(self.coefficients[k])) for name, k in d.slot.items() if name.startswith(prefix)]
            pool = dict(betas).get(INFREQUENT, 0.0) if d.encoding.spec.unknown_to_pool else 0.0
            side = SparkSession.active().createDataFrame(betas, f"_c_{c} string, _b{i} double")
            table = table.join(side, f"_c_{c}", "left")
            more = more + F.coalesce(F.col(f"_b{i}"), F.lit(pool))
        return table.select(*shown, self._score(clip, more).alias("predicted"))


def solve(sums: Sums, family: str, penalty: float = 0.0, max_iter: int = 1000, tolerance: float = 1e-10) -> LinearFit:
    """``linear``: least squares, of equal fits the one of least norm. ``ridge``: plus penalty * sum of squares, the
    loss being the sum of squared errors. ``lasso``: half the mean squared error plus penalty * sum of sizes."""
    g, b = sums.gram, sums.with_target
    p = len(b)
    if family == "ridge":
        beta = np.linalg.solve(g + np.eye(p) * (penalty / max(sums.n, 1)), b) if p else b
    elif family == "linear":
        beta = np.linalg.lstsq(g, b, rcond=1e-12)[0] if p else b
    elif family == "lasso":
        beta = _descend(g, b, penalty, max_iter, tolerance)
    else:
        raise ValueError(f"unknown linear family: {family}")
    return LinearFit(sums.design, beta, sums.target_mean - float(sums.slot_means @ beta), family, penalty)


def _descend(g: np.ndarray, b: np.ndarray, penalty: float, max_iter: int, tolerance: float) -> np.ndarray:
    """Lasso by coordinate descent; ``left`` is the moment that the coefficients leave unexplained."""
    beta, left = np.zeros(len(b)), b.copy()
    diagonal = np.diag(g)
    usable = np.flatnonzero(diagonal > 1e-14)
    scale = max(float(np.abs(b).max(initial=0.0)), 1e-300)
    for _ in range(max_iter):
        moved = 0.0
        for j in usable:
            rho = left[j] + diagonal[j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0.0) / diagonal[j]
            if new != beta[j]:
                step = new - beta[j]
                left -= g[:, j] * step
                beta[j] = new
                moved = max(moved, abs(step) * diagonal[j])
        if moved <= tolerance * scale:
            break
    return beta


def optimality_gaps(fit: LinearFit, train: DataFrame, target: str) -> DataFrame:
    """Per slot: feature, rows, and how far the fit is from the optimum there, from a pass over the rows themselves.

    The gap is the mean of slot times residual less what the penalty asks of it: 0 at the optimum. With lasso a
    zero coefficient has a gap only beyond the penalty.
    """
    d, m = fit.design, len(fit.design.scales)
    known = train.filter(F.col(target).isNotNull())
    rows = fit.scored(known, [F.col(target).cast("double").alias("y")], clip=False).withColumn("_e", F.col("_kept.y") - F.col("predicted"))
    # Each row counts once per category and once, with no category, for the numbers. The error has mean 0, so
    # centring the categories changes nothing.
    cells = [F.struct(F.lit(i).alias("i"), F.col(f"_c_{c}").alias("v")) for i, c in enumerate(d.categorical)]
    cells.append(F.struct(F.lit(-1).alias("i"), F.lit("").alias("v")))
    numbers = [d.number(k).alias(f"_n{k}") for k in range(m)]
    single = rows.select(F.explode(F.array(*cells)).alias("_cell"), "_e", *numbers)
    moments = [F.sum(F.when(F.col("_cell.i") == -1, F.col(f"_n{k}") * F.col("_e"))) for k in range(m)]
    sums = single.groupBy("_cell").agg(F.count(F.lit(1)), F.sum("_e"), *moments).collect()
    whole = next((r for r in sums if r[0]["i"] == -1), None)
    n = whole[1] if whole else 0
    found = {name: (n, (whole[3 + k] if whole else 0.0) or 0.0) for k, name in enumerate(d.numbers)} if m else {}
    for r in sums:
        at = d.place(d.categorical[r[0]["i"]], r[0]["v"]) if r[0]["i"] >= 0 else None
        if at is not None:
            name = d.encoding.slots[at]
            old = found.get(name, (0, 0.0))
            found[name] = (old[0] + r[1], old[1] + r[2])
    out = []
    for name, (count, moment) in found.items():
        beta, mean = float(fit.coefficients[d.slot[name]]), moment / max(n, 1)
        if fit.family == "ridge":
            gap = mean - fit.penalty * beta / max(n, 1)
        elif fit.family == "lasso":
            gap = mean - fit.penalty * np.sign(beta) if beta else np.sign(mean) * max(abs(mean) - fit.penalty, 0.0)
        else:
            gap = mean
        out.append((name, count, float(gap)))
    return SparkSession.active().createDataFrame(out, "feature string, rows long, gap double")
