"""Random forests, and single trees, for squared error on binned columns.

Columns are cut into bins once, as for boosting. A tree sees each row as often as a Poisson draw of mean 1 says, seeded
by tree and block of rows; a node looks at a hashed draw of features. Nodes of more than ``grown_trees.LOCAL_ROWS`` rows
are split level by level, for all trees of a group in one pass: tasks add up weights and targets per (node, bin) and
the driver sees these cells only. Smaller nodes are grown on by the task that gets their rows, one level of all their
nodes at a time. So a pass never has more cells than rows, and deep trees cost no passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.operators import grown_trees
from leadline.operators.grown_trees import Columns, GrownTrees, TopTree, bins_of, grow_small, groups_of, release_shuffles
from leadline.operators.hist_boosting import BLOCK_ROWS, fit_edges
from leadline.session import stage

EQUAL = 1e-11
# Draws of a Poisson distribution of mean 1, by a 16-bit number.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class RandomForestParams:
    """``subset``: the features a node looks at, "all", "sqrt" or a share. ``min_leaf`` counts draws."""

    trees: int = 100
    max_depth: int = 30
    min_leaf: int = 1
    subset: str = "all"
    bootstrap: bool = True
    max_bins: int = 255
    seed: int = 42

    def looked_at(self, features: int) -> int:
        if self.subset == "all":
            return features
        return max(1, math.ceil(math.sqrt(features) if self.subset == "sqrt" else float(self.subset) * features))


def draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often a tree sees each row of a block."""
    return _POISSON[np.random.default_rng([seed, tree, block]).integers(0, 1 << 16, n, np.uint16)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hash of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def looked_at(p: RandomForestParams, tree: int, numbers: np.ndarray, k: int) -> np.ndarray:
    """Which features each node looks at, nodes x features."""
    m = p.looked_at(k)
    if m >= k:
        return np.ones((len(numbers), k), bool)
    start = _mixed(np.array([p.seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree + 1))
    node = _mixed(start + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(_mixed(node[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)), axis=1)
    out = np.zeros((len(numbers), k), bool)
    np.put_along_axis(out, order[:, :m], True, axis=1)
    return out


def _improve(best: list[np.ndarray], f: int, cell: np.ndarray, width: int, cw: np.ndarray, cs: np.ndarray, n: np.ndarray, s: np.ndarray, least: int) -> None:
    """Take feature ``f`` into each node's best (score, feature, cut); ``cell`` are its full cells (node * width + bin) in order.

    Scores that differ by rounding only count as equal: then the first feature and the lowest cut.
    """
    if not len(cell):
        return
    node = cell // width
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(first, len(node)))
    left_n, left_s = np.cumsum(cw), np.cumsum(cs)
    left_n -= np.repeat(left_n[first] - cw[first], size)
    left_s -= np.repeat(left_s[first] - cs[first], size)
    right_n, right_s = n[node] - left_n, s[node] - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left_s * left_s / left_n + right_s * right_s / right_n
    score[(left_n < least) | (right_n < least)] = -np.inf
    top = np.maximum.reduceat(score, first)
    enough = np.full(len(top), np.inf)
    some = np.isfinite(top)
    enough[some] = top[some] - EQUAL * np.abs(top[some])
    hit = np.flatnonzero(score >= np.repeat(enough, size))
    _, once = np.unique(node[hit], return_index=True)
    at = hit[once]
    known = best[0][node[at]]
    at = at[score[at] > np.where(np.isfinite(known), known + EQUAL * np.abs(np.nan_to_num(known)), -np.inf)]
    best[0][node[at]], best[1][node[at]], best[2][node[at]] = score[at], f, cell[at] - node[at] * width


def _splits(score: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fall in squared error of each node's best split, and whether it is one. ``q`` is the sum of squares."""
    gain = score - s * s / np.maximum(n, 1e-300)
    return gain, np.isfinite(score) & (gain > 1e-10 * q)


def grow_node(p: RandomForestParams, widths: Sequence[int], tree: int, number: int, depth: int, xs: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> Columns:
    """All nodes below one, level by level."""
    k, least = len(xs), max(p.min_leaf, 1)
    x = np.stack(xs) if k else np.zeros((0, len(y)), np.uint8)
    node, numbers, wy = np.zeros(len(y), np.int64), np.array([number], np.uint64), w * y
    out: dict[str, list[np.ndarray]] = {name: [] for name in grown_trees.KINDS}
    size = 0
    while len(numbers):
        m = len(numbers)
        n, s = np.bincount(node, w, m), np.bincount(node, wy, m)
        best = [np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)]
        gain, split = np.zeros(m), np.zeros(m, bool)
        if depth < p.max_depth:
            q = np.bincount(node, wy * y, m)
            able = (n >= 2 * least) & (q - s * s / np.maximum(n, 1e-300) > 1e-12 * q)
            looks = looked_at(p, tree, numbers, k) & able[:, None]
            for f in range(k):
                if looks[:, f].all():
                    key, cw, cs = node * widths[f] + x[f], w, wy
                else:
                    use = np.flatnonzero(looks[node, f])
                    key, cw, cs = node[use] * widths[f] + x[f, use], w[use], wy[use]
                if m * widths[f] <= 4 * len(key):
                    cw, cs = np.bincount(key, cw, m * widths[f]), np.bincount(key, cs, m * widths[f])
                    cell = np.flatnonzero(cw)
                    cw, cs = cw[cell], cs[cell]
                elif len(key):
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    cell, cw, cs = key[first], np.add.reduceat(cw[order], first), np.add.reduceat(cs[order], first)
                else:
                    cell = key
                _improve(best, f, cell, widths[f], cw, cs, n, s, least)
            gain, split = _splits(best[0], n, s, q)
        rank = np.cumsum(split) - 1
        out["feature"].append(np.where(split, best[1], -1))
        out["cut"].append(np.where(split, best[2], 0))
        out["left"].append(np.where(split, size + m + 2 * rank, -1))
        out["value"].append(s / np.maximum(n, 1e-300))
        out["gain"].append(np.where(split, gain, 0.0))
        size, depth = size + m, depth + 1
        stay = split[node]
        if not stay.all():
            x, y, w, wy, node = x[:, stay], y[stay], w[stay], wy[stay], node[stay]
        right = x[best[1][node], np.arange(len(node))] > best[2][node] if len(node) else np.zeros(0, bool)
        node = 2 * rank[node] + right
        numbers = (2 * np.repeat(numbers[split], 2) + np.tile(np.array([1, 2], np.uint64), int(split.sum()))).astype(np.uint64)
    return {name: np.concatenate(c) for name, c in out.items()}


def _histograms(rows: DataFrame, tops: dict[int, TopTree], nodes: list[tuple[int, int]], widths: Sequence[int], p: RandomForestParams) -> np.ndarray:
    """(weight, weighted target) per node and bin of each feature; a node's last cell holds its weight and sum of squares."""
    k, width = len(widths), sum(widths) + 1
    offsets = np.cumsum([0, *widths])
    slots = {t: np.full(len(tops[t].feature), -1) for t in {t for t, _ in nodes}}
    for slot, (t, node) in enumerate(nodes):
        slots[t][node] = slot
    cells = len(nodes) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_sum, s_sum = np.zeros(cells), np.zeros(cells)
        for block, x, y in _blocks(batches, k):
            for t, slot_of in slots.items():
                slot = slot_of[tops[t].place(x)]
                w = draws(p.seed, t, block, len(y)) if p.bootstrap else np.ones(len(y), np.uint8)
                use = np.flatnonzero((slot >= 0) & (w > 0))
                slot, weight = slot[use], w[use].astype(float)
                target = weight * y[use]
                for f in range(k):
                    key, size = slot * widths[f] + x[f, use], len(nodes) * widths[f]
                    into = slice(offsets[f], offsets[f + 1])
                    w_sum.reshape(len(nodes), width)[:, into] += np.bincount(key, weight, size).reshape(len(nodes), widths[f])
                    s_sum.reshape(len(nodes), width)[:, into] += np.bincount(key, target, size).reshape(len(nodes), widths[f])
                w_sum[width - 1 :: width] += np.bincount(slot, weight, len(nodes))
                s_sum[width - 1 :: width] += np.bincount(slot, target * y[use], len(nodes))
        full = np.flatnonzero(w_sum)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(w_sum[full]), pa.array(s_sum[full])], names=["cell", "w", "s"])

    sums = rows.mapInArrow(run, "cell long, w double, s double").groupBy("cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).toArrow()
    out = np.zeros((cells, 2))
    out[sums.column("cell").to_numpy()] = np.column_stack([sums.column("w").to_numpy(), sums.column("s").to_numpy()])
    return out.reshape(len(nodes), width, 2)


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, bins (features x rows) and targets of each block."""
    for batch in batches:
        for i, (block, n) in enumerate(zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist())):
            x, y = batch.column("bins")[i].as_buffer(), batch.column("y")[i].as_buffer()
            yield block, np.frombuffer(x, np.uint8 if x.size == n * k else np.int16).reshape(k, n), np.frombuffer(y)


def _split_large(rows: DataFrame, tops: dict[int, TopTree], widths: Sequence[int], p: RandomForestParams, n: int) -> dict[tuple[int, int], int]:
    """Split nodes of more than ``LOCAL_ROWS`` rows; the leaves left to be grown on, and their depths."""
    k, least = len(widths), max(p.min_leaf, 1)
    if n <= grown_trees.LOCAL_ROWS:
        return {(t, 0): 0 for t in tops}
    open_, waiting, depth = [(t, 0) for t in tops], {}, 0
    offsets = np.cumsum([0, *widths])
    while open_:
        hist, ahead = _histograms(rows, tops, open_, widths, p), []
        total, q = hist[:, -1, 0], hist[:, -1, 1]
        s = hist[:, : widths[0], 1].sum(axis=1) if k else np.zeros(len(open_))
        best = [np.full(len(open_), -np.inf), np.full(len(open_), -1), np.zeros(len(open_), np.int64)]
        looks = np.concatenate([looked_at(p, t, np.array([tops[t].number[node]], np.uint64), k) for t, node in open_])
        for f in range(k) if depth < p.max_depth else ():
            cells = np.where(looks[:, f, None], hist[:, offsets[f] : offsets[f + 1], 0], 0.0).ravel()
            cell = np.flatnonzero(cells)
            _improve(best, f, cell, widths[f], cells[cell], hist[:, offsets[f] : offsets[f + 1], 1].ravel()[cell], total, s, least)
        gain, split = _splits(best[0], total, s, q)
        for i, (t, node) in enumerate(open_):
            tops[t].value[node] = float(s[i] / total[i]) if total[i] else 0.0
            if not split[i]:
                continue
            f, cut = int(best[1][i]), int(best[2][i])
            left = hist[i, offsets[f] : offsets[f] + cut + 1].sum(axis=0)
            for child, (weight, target) in zip(tops[t].split(node, f, float(cut), float(gain[i])), (left, (total[i] - left[0], s[i] - left[1]))):
                tops[t].value[child] = float(target / weight)
                if weight > grown_trees.LOCAL_ROWS:
                    ahead.append((t, child))
                elif depth + 1 < p.max_depth:
                    waiting[t, child] = depth + 1
        open_, depth = ahead, depth + 1
    return waiting


def fit_random_forest(df: DataFrame, features: Sequence[str], target: str, params: RandomForestParams = RandomForestParams()) -> GrownTrees:
    """A forest on numeric columns; rows without a target are left out. ``df`` is read four times before it is staged."""
    features, k, p = list(features), len(features), params
    known = df.filter(F.col(target).isNotNull())
    edges = fit_edges(known, features, p.max_bins)
    widths = [len(c) + 2 for c in edges]
    kind = np.uint8 if max(widths, default=1) <= 256 else np.int16
    base, n = known.agg(F.avg(F.col(target).cast("double")), F.count(F.lit(1))).first()
    base = base or 0.0
    raw = known.select(*[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            # Sums of targets around their mean lose less to rounding.
            parts.append((bins_of(batch.columns[:k], edges).astype(kind).reshape(k, batch.num_rows), batch.column("y").to_numpy() - base))
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield whole(block, parts, count)
                parts, count, block = [], 0, block + 1
        if count:
            yield whole(block, parts, count)

    def whole(block: int, parts: list, count: int) -> pa.RecordBatch:
        bins, y = np.concatenate([b for b, _ in parts], axis=1), np.concatenate([y for _, y in parts])
        ids = [pa.array([block], pa.int64()), pa.array([count], pa.int32())]
        return pa.RecordBatch.from_arrays([*ids, *[pa.array([a.tobytes()], pa.binary()) for a in (bins, y)]], names=["block", "rows", "bins", "y"])

    rows = stage(raw.mapInArrow(binned, "block long, rows int, bins binary, y binary"))
    model = GrownTrees(features, edges, base=base)
    weigh = (lambda t, block, size: draws(p.seed, t, block, size)) if p.bootstrap else None

    def grow(tree: int, number: int, depth: int, xs: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> Columns:
        return grow_node(p, widths, tree, number, depth, xs, y, w)

    for group in groups_of(p.trees, n):
        tops = {t: TopTree() for t in group}
        waiting = _split_large(rows, tops, widths, p, n) if n else {}
        grown = grow_small(rows, tops, waiting, [kind] * k, lambda batches: _blocks(batches, k), weigh, grow, n * len(group)) if waiting else None
        model.add(tops, grown)
        if len(group) < p.trees:
            release_shuffles(rows)
    return model
