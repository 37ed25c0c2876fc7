"""Extremely randomised trees for squared error, all trees of a group level by level.

A node draws one threshold per feature, evenly between the least and the largest value that its rows have, and is
split by the one that lowers the squared error most. The draw is a hash of (seed, tree, node, feature), so it does not
depend on how rows are spread, and a forest repeats from run to run.

Nodes of more than ``grown_trees.LOCAL_ROWS`` rows take two passes over the rows per level, for all such nodes of all
trees of a group at once: ranges per (tree, node, feature), and then counts and sums left of the drawn thresholds. Tasks
fill their cells in numpy and one grouped aggregation adds them; a pass covers at most ``MAX_CELLS`` cells, and a level
with more takes more passes. Smaller nodes are grown on by the task that gets their rows, so deep levels take no passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.operators import grown_trees
from leadline.operators.grown_trees import KINDS, Columns, GrownTrees, TopTree, grow_small, groups_of, matrix_of, release_shuffles
from leadline.session import stage

MAX_CELLS = 400_000


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    max_depth: int = 20
    min_leaf: int = 1
    seed: int = 42


def drawn(seed: int, tree: int, node: int, feature: int) -> float:
    """The threshold's place in its range, 0 to 1. Nodes are numbered as in a heap: 0, then 2n + 1 and 2n + 2."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}:{feature}".encode()).hexdigest()
    return int(digest[:13], 16) / (1 << 52)


ExtraTrees = GrownTrees


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return matrix_of(batch.columns[:k], batch.num_rows)


def _slots(trees: dict[int, TopTree], part: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Per tree, the slot of each of its nodes in ``part``, or -1."""
    out = {t: np.full(len(trees[t].feature), -1) for t in {t for t, _ in part}}
    for slot, (t, node) in enumerate(part):
        out[t][node] = slot
    return out


def _ranges(rows: DataFrame, trees: dict[int, TopTree], part: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each feature and of the target (last), and (rows, sum of the target), per slot."""
    slot_of, cells = _slots(trees, part), len(part) * (k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(cells, np.inf), np.full(cells, -np.inf)
        n, s = np.zeros(cells, np.int64), np.zeros(cells)
        for batch in batches:
            x = _matrix(batch, k)
            y = batch.column("y").to_numpy()
            values = np.vstack([x, y])
            for t, slots in slot_of.items():
                slot = slots[trees[t].place(x)]
                # Few slots sort fast as short integers.
                order = np.argsort(slot.astype(np.int16) if len(part) < 1 << 15 else slot, kind="stable")
                order = order[np.searchsorted(slot[order], 0) :]
                if not len(order):
                    continue
                present, first = np.unique(slot[order], return_index=True)
                for f in range(k + 1):
                    at, v = present * (k + 1) + f, values[f, order]
                    low[at] = np.fmin(low[at], np.fmin.reduceat(v, first))
                    high[at] = np.fmax(high[at], np.fmax.reduceat(v, first))
                at = present * (k + 1) + k
                n[at] += np.diff(np.append(first, len(order)))
                s[at] += np.add.reduceat(y[order], first)
        full = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (full, low[full], high[full], n[full], s[full])], names=["cell", "low", "high", "n", "s"])

    sums = (
        rows.mapInArrow(run, "cell long, low double, high double, n long, s double").groupBy("cell")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    )
    cell, low, high, n, s = (sums.column(c).to_numpy() for c in ("cell", "low", "high", "n", "s"))
    span = np.full((cells, 2), np.nan)
    span[cell] = np.column_stack([low, high])
    total = np.zeros((cells, 2))
    total[cell] = np.column_stack([n, s])
    return span.reshape(len(part), k + 1, 2), total.reshape(len(part), k + 1, 2)[:, k]


def _left_sums(rows: DataFrame, trees: dict[int, TopTree], part: list[tuple[int, int]], thresholds: np.ndarray) -> np.ndarray:
    """(rows, sum of the target) at or below each threshold: slots x features x 2."""
    k = thresholds.shape[1]
    slot_of, cells = _slots(trees, part), len(part) * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(cells, np.int64), np.zeros(cells)
        for batch in batches:
            x, y = _matrix(batch, k), batch.column("y").to_numpy()
            for t, slots in slot_of.items():
                slot = slots[trees[t].place(x)]
                inside = np.flatnonzero(slot >= 0)
                for f in range(k):
                    left = inside[x[f, inside] <= thresholds[slot[inside], f]]
                    at = slot[left] * k + f
                    n += np.bincount(at, minlength=cells)
                    s += np.bincount(at, y[left], cells)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (full, n[full], s[full])], names=["cell", "n", "s"])

    sums = rows.mapInArrow(run, "cell long, n long, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    out = np.zeros((cells, 2))
    out[sums.column("cell").to_numpy()] = np.column_stack([sums.column("n").to_numpy(), sums.column("s").to_numpy()])
    return out.reshape(len(part), k, 2)


def _split_part(rows: DataFrame, trees: dict[int, TopTree], part: list[tuple[int, int]], k: int, p: ForestParams, depth: int) -> list[tuple[int, int, int]]:
    """Fill in the nodes of ``part`` and split those that can be; the new nodes and their rows."""
    span, total = _ranges(rows, trees, part, k)
    draws = np.array([[drawn(p.seed, t, trees[t].number[node], f) for f in range(k)] for t, node in part]).reshape(len(part), k)
    low, high = span[:, :k, 0], span[:, :k, 1]
    thresholds = low + draws * (high - low)
    n, s = total[:, 0], total[:, 1]
    for (t, node), rows_in, sum_in in zip(part, n, s):
        trees[t].value[node] = float(sum_in / rows_in) if rows_in else 0.0
    if depth >= p.max_depth:
        return []
    left = _left_sums(rows, trees, part, np.where(low < high, thresholds, np.nan))
    chosen, score = _chosen(left[..., 0], left[..., 1], n, s, p)
    new = []
    for slot, (t, node) in enumerate(part):
        if not k or span[slot, k, 0] == span[slot, k, 1]:
            continue  # nothing left to tell apart
        f = int(chosen[slot])
        if np.isfinite(score[slot]):
            children = trees[t].split(node, f, float(thresholds[slot, f]), float(score[slot] - s[slot] ** 2 / n[slot]))
            new += [(t, child, int(size)) for child, size in zip(children, (left[slot, f, 0], n[slot] - left[slot, f, 0]))]
    return new


def _chosen(left_n: np.ndarray, left_s: np.ndarray, n: np.ndarray, s: np.ndarray, p: ForestParams) -> tuple[np.ndarray, np.ndarray]:
    """The best feature per node and its score, -inf if none may split; sums are nodes x features."""
    if not left_n.shape[1]:
        return np.full(len(n), -1), np.full(len(n), -np.inf)
    right_n, right_s = n[:, None] - left_n, s[:, None] - left_s
    least = max(p.min_leaf, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left_s**2 / left_n + right_s**2 / right_n
    score = np.where((left_n >= least) & (right_n >= least), score, -np.inf)
    f = np.argmax(score, axis=1)
    return f, score[np.arange(len(n)), f]


def grow_node(p: ForestParams, tree: int, number: int, depth: int, xs: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> Columns:
    """All nodes below one, level by level; rows are kept in the order of their nodes."""
    k, x = len(xs), [c.astype(float) for c in xs]
    node, numbers, size = np.zeros(len(y), np.int64), [number], 0
    out: dict[str, list[np.ndarray]] = {name: [] for name in KINDS}
    while numbers:
        m = len(numbers)
        first = np.searchsorted(node, np.arange(m))
        n, s = np.bincount(node, minlength=m).astype(float), np.bincount(node, y, m)
        f, score, thresholds = np.full(m, -1), np.full(m, -np.inf), np.zeros((m, k))
        if depth < p.max_depth and k:
            # Nodes whose target is the same everywhere, or too few rows, need no draws.
            open_ = (np.minimum.reduceat(y, first) < np.maximum.reduceat(y, first)) & (n >= 2 * max(p.min_leaf, 1))
            draws = np.zeros((m, k))
            for i in np.flatnonzero(open_):
                draws[i] = [drawn(p.seed, tree, numbers[i], c) for c in range(k)]
            left = np.zeros((m, k, 2))
            for c in range(k):
                low, high = np.fmin.reduceat(x[c], first), np.fmax.reduceat(x[c], first)
                thresholds[:, c] = np.where((low < high) & open_, low + draws[:, c] * (high - low), np.nan)
                is_left = np.flatnonzero(x[c] <= thresholds[node, c])
                left[:, c, 0] = np.bincount(node[is_left], minlength=m)
                left[:, c, 1] = np.bincount(node[is_left], y[is_left], m)
            f, score = _chosen(left[..., 0], left[..., 1], n, s, p)
        split = np.isfinite(score)
        cut, rank = thresholds[np.arange(m), f] if k else np.zeros(m), np.cumsum(split) - 1
        out["feature"].append(np.where(split, f, -1))
        out["cut"].append(np.where(split, cut, 0.0))
        out["left"].append(np.where(split, size + m + 2 * rank, -1))
        out["value"].append(s / np.maximum(n, 1))
        out["gain"].append(np.where(split, score - s * s / np.maximum(n, 1), 0.0))
        size, depth = size + m, depth + 1
        stay = np.flatnonzero(split[node])
        right = np.zeros(len(stay), bool)
        for c in range(k):
            mine = np.flatnonzero(f[node[stay]] == c)
            right[mine] = ~(x[c][stay[mine]] <= cut[node[stay[mine]]])
        child = 2 * rank[node[stay]] + right
        order = np.argsort(child, kind="stable")
        stay, node = stay[order], child[order]
        x, y = [c[stay] for c in x], y[stay]
        numbers = [2 * numbers[i] + side for i in np.flatnonzero(split) for side in (1, 2)]
    return {name: np.concatenate(c) for name, c in out.items()}


def _narrow(rows: DataFrame, k: int) -> tuple[int, list[np.dtype]]:
    """Number of rows, and per feature the narrowest kind that holds all its values."""
    asked = [F.count(F.lit(1))]
    for f in range(k):
        v = F.col(f"x{f}")
        asked += [F.count(v), F.min(v), F.max(v), F.max(v != F.floor(v)), F.max(v != v.cast("float").cast("double"))]
    found = rows.agg(*asked).first()
    kinds = []
    for f in range(k):
        known, low, high, broken, long = found[1 + 5 * f : 6 + 5 * f]
        if known == found[0] and known and not broken and -(1 << 15) <= low and high < 1 << 15:
            kinds.append(np.dtype(np.int8 if -128 <= low and high < 128 else np.int16))
        else:
            kinds.append(np.dtype(np.float64 if long else np.float32))
    return found[0], kinds


def fit_extra_trees(df: DataFrame, features: Sequence[str], target: str, params: ForestParams = ForestParams()) -> GrownTrees:
    """A forest on numeric columns; every tree sees all rows. Rows without a target are left out."""
    features, k, p = list(features), len(features), params
    inputs = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    y = F.col(target).cast("double")
    rows = stage(df.filter(y.isNotNull()).select(*inputs, y.alias("y")))
    n, kinds = _narrow(rows, k)
    model = GrownTrees(features)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        block = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(batches):
            yield block + i, _matrix(batch, k), batch.column("y").to_numpy()

    def grow(tree: int, number: int, depth: int, xs: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> Columns:
        return grow_node(p, tree, number, depth, xs, y, w)

    step = max(MAX_CELLS // (k + 1), 1)
    for group in groups_of(p.trees, n):
        trees, waiting, depth = {t: TopTree() for t in group}, {}, 0
        open_ = [(t, 0) for t in trees] if n > grown_trees.LOCAL_ROWS else []
        if not open_ and n:
            waiting = {(t, 0): 0 for t in trees}
        while open_:
            found = []
            for begin in range(0, len(open_), step):
                part = open_[begin : begin + step]
                found += _split_part(rows, {t: trees[t] for t, _ in part}, part, k, p, depth)
            depth += 1
            open_ = [(t, node) for t, node, size in found if size > grown_trees.LOCAL_ROWS]
            waiting.update({(t, node): depth for t, node, size in found if size <= grown_trees.LOCAL_ROWS})
        grown = grow_small(rows, trees, waiting, kinds, blocks, None, grow, n * len(group)) if waiting else None
        model.add(trees, grown)
        if len(group) < p.trees:
            release_shuffles(rows)
    return model
