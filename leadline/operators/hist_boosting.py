"""Histogram gradient boosting for squared error, grown leaf by leaf.

Columns are cut into at most ``max_bins`` bins once; nulls are a bin of their own. A pass over the rows adds up
gradients and counts per (node, feature, bin): each task fills its histograms in numpy, one grouped
aggregation adds them, and the driver sees nodes x features x bins cells, however many rows there are. Of two
siblings only the smaller is counted, the other is its parent less its sibling.

Leaves are split best gain first, up to ``max_leaves``. A split's gain does not depend on the order, so one pass counts
the children of all leaves that may still be split; a tree takes about as many passes as it is deep.
The binned rows are staged in blocks of up to ``BLOCK_ROWS`` rows, a byte per bin, so that a pass moves a few
buffers and no single values. Predictions so far are written with the rows every ``STAGE_ROUNDS`` trees; between, tasks
work them out from the trees, so a lost executor costs one task. A table of at most ``LOCAL_ROWS`` rows is no work to
share: one task grows its trees.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.operators.grown_trees import bins_of
from leadline.session import stage

STAGE_ROUNDS = 10
BLOCK_ROWS = 1 << 16
LOCAL_ROWS = 250_000
BLOCKS = "rows int, bins binary, y binary, p binary, held binary"
# Distinct values of a feature up to which its quantiles are exact.
DISTINCT_LIMIT = 1_000_000


@dataclass(frozen=True)
class BoostParams:
    """``patience``: stop when the error on a tenth of the rows, held out by a hash of the row's number, has not
    fallen for so many rounds; None trains on all rows for all rounds."""

    iterations: int = 100
    rate: float = 0.1
    max_leaves: int = 31
    max_depth: int | None = None
    min_leaf: int = 20
    l2: float = 0.0
    max_bins: int = 255
    patience: int | None = None
    tolerance: float = 1e-7


@dataclass
class Tree:
    """Nodes by number, 0 the root. A row goes left if its bin is at most ``cut``; ``null_left`` says where nulls go."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, null_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.null_left[node], self.gain[node] = feature, cut, null_left, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, value in (("feature", -1), ("cut", 0), ("null_left", False), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0)):
                getattr(self, column).append(value)
            self.depth.append(self.depth[node] + 1)
        return self.left[node], self.right[node]

    def place(self, bins: np.ndarray, null_bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a (features x rows) matrix of bins."""
        out, todo = np.zeros(bins.shape[1], np.int64), [(0, np.arange(bins.shape[1], dtype=np.int32))]
        while todo:
            node, rows = todo.pop()
            f = self.feature[node]
            if f < 0:
                out[rows] = node
                continue
            b = bins[f][rows]
            to_left = b <= self.cut[node]
            # The bin of nulls is past every cut.
            if self.null_left[node]:
                to_left |= b == null_bins[f]
            todo += [(child, part) for child, part in ((self.left[node], rows[to_left]), (self.right[node], rows[~to_left])) if len(part)]
        return out


def fit_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Upper edges of the bins but the last, per feature: a value is in the first bin whose edge is not below it.

    A feature with few values has a bin for each; others are cut at quantiles. Quantiles are exact up to
    ``DISTINCT_LIMIT`` distinct values and from a mergeable sketch beyond.
    """
    values = [F.col(f"`{f}`").cast("double") for f in features]
    sizes = df.agg(*[F.approx_count_distinct(v).alias(str(k)) for k, v in enumerate(values)]).first()
    probs = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    cells = []
    for k, v in enumerate(values):
        if sizes[k] <= 2 * max_bins:
            cells.append(F.array_sort(F.collect_set(v)))
        elif sizes[k] <= DISTINCT_LIMIT:
            cells.append(F.percentile(v, probs))
        else:
            cells.append(F.percentile_approx(v, probs, F.lit(100 * max_bins)))
    found = df.agg(*[c.alias(str(k)) for k, c in enumerate(cells)]).first()
    edges = []
    for k, size in enumerate(sizes):
        cut = np.unique(np.array(found[k] or [], dtype=float))
        if size <= 2 * max_bins and len(cut) > max_bins:
            cut = cut[np.linspace(0, len(cut), max_bins + 1)[1:-1].astype(int) - 1]
        elif size <= 2 * max_bins:
            cut = cut[:-1]
        edges.append(cut)
    return edges


def _double(value: float) -> str:
    """A number that SQL reads as a double, not as a decimal."""
    said = repr(float(value))
    return said if "e" in said else f"{said}e0"


@dataclass
class BoostedTrees:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    errors: list[float]

    def _null_bins(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.edges])

    def add(self, bins: np.ndarray, value: np.ndarray, since: int = 0) -> np.ndarray:
        """``value`` and what the trees from number ``since`` on add to it."""
        for tree in self.trees[since:]:
            value = value + np.array(tree.value)[tree.place(bins, self._null_bins())]
        return value

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """``df`` with the prediction, in one pass."""
        model, k = self, len(self.features)
        inputs = [F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]
        kept = df.select("*", *inputs)
        schema = df.withColumn(name, F.lit(0.0)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.columns[: batch.num_columns - k]
                bins = bins_of(batch.columns[batch.num_columns - k :], model.edges)
                value = model.add(bins, np.full(batch.num_rows, model.base))
                yield pa.RecordBatch.from_arrays([*own, pa.array(value)], names=schema.names)

        return kept.mapInArrow(run, schema)

    def as_sql(self) -> str:
        """The prediction as one SQL expression over the feature columns, a CASE per node."""

        def said(tree: Tree, node: int) -> str:
            f = tree.feature[node]
            if f < 0:
                return _double(tree.value[node])
            name, cut = f'"{self.features[f]}"', self.edges[f]
            # Past the last edge only the null side differs.
            test = f"{name} <= {_double(cut[tree.cut[node]])}" if tree.cut[node] < len(cut) else f"{name} IS NOT NULL"
            test = f"({test} OR {name} IS NULL)" if tree.null_left[node] else f"({test} AND {name} IS NOT NULL)"
            return f"CASE WHEN {test} THEN {said(tree, tree.left[node])} ELSE {said(tree, tree.right[node])} END"

        return " + ".join([_double(self.base), *[said(t, 0) for t in self.trees]])

    def gains(self) -> dict[str, float]:
        """Each feature's part of the total gain of all splits."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[self.features[f]] += gain
        whole = sum(total.values()) or 1.0
        return {f: g / whole for f, g in total.items()}


def best_split(hist: np.ndarray, null_bins: np.ndarray, p: BoostParams) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, nulls go left) of a node's (features x bins x (gradient, count)); None if none gains.

    Of equal gains the first feature, then the lowest cut counts.
    """
    g, n = hist[0, :, 0].sum(), hist[0, :, 1].sum()
    whole = g * g / (n + p.l2)
    best = None
    for f, last in enumerate(null_bins):
        null_g, null_n = hist[f, last]
        upto = np.cumsum(hist[f, :last], axis=0)
        for null_left in (False, True) if null_n else (False,):
            left_g, left_n = upto[:, 0] + null_g * null_left, upto[:, 1] + null_n * null_left
            right_g, right_n = g - left_g, n - left_n
            fits = (left_n >= p.min_leaf) & (right_n >= p.min_leaf) & (left_n > 0) & (right_n > 0)
            if not fits.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, left_g**2 / (left_n + p.l2) + right_g**2 / (right_n + p.l2) - whole, -np.inf)
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-12 * max(abs(whole), 1.0) and (best is None or gain[cut] > best[0]):
                if not null_n:  # nulls unseen here go where more rows go
                    null_left = bool(left_n[cut] > right_n[cut])
                best = (float(gain[cut]), f, cut, bool(null_left))
    return best


def _block(bins: np.ndarray, y: np.ndarray, p: np.ndarray, held: np.ndarray) -> dict:
    return {"rows": len(y), "bins": np.ascontiguousarray(bins).tobytes(), "y": y.tobytes(), "p": p.tobytes(), "held": held.tobytes()}


def _blocks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bins (features x rows), targets, predictions and the held-out mark of each block."""
    for i, n in enumerate(batch.column("rows").to_pylist()):
        cell = [batch.column(c)[i].as_buffer() for c in ("bins", "y", "p", "held")]
        # The bins of a block are bytes unless a feature has more than 256 of them.
        kind = np.uint8 if cell[0].size == n * k else np.int16
        yield np.frombuffer(cell[0], kind).reshape(k, n), np.frombuffer(cell[1]), np.frombuffer(cell[2]), np.frombuffer(cell[3], bool)


def _histograms(rows: DataFrame, model: BoostedTrees, since: int, tree: Tree, nodes: list[int], width: int, check: bool) -> tuple[dict[int, np.ndarray], float]:
    """Histograms of some nodes of ``tree``, and with ``check`` the held-out mean squared error before it."""
    k, null_bins = len(model.features), model._null_bins()
    slot_of = np.full(len(tree.feature), -1)
    slot_of[nodes] = np.arange(len(nodes))
    cells = len(nodes) * k * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held = len(nodes) * width, [0.0, 0]
        by_feature, n_by_feature = np.zeros((k, size)), np.zeros((k, size), np.int64)
        for batch in batches:
            for bins, y, p, out in _blocks(batch, k):
                slot = slot_of[tree.place(bins, null_bins)]
                if check:
                    held[0] += float(((model.add(bins[:, out], p[out], since) - y[out]) ** 2).sum())
                    held[1] += int(out.sum())
                use = np.flatnonzero((slot >= 0) & ~out)
                part = bins[:, use]
                first, err = slot[use] * width, model.add(part, p[use], since) - y[use]
                for f in range(k):
                    at = first + part[f]
                    by_feature[f] += np.bincount(at, err, size)
                    n_by_feature[f] += np.bincount(at, minlength=size)
        g = by_feature.reshape(k, len(nodes), width).transpose(1, 0, 2).reshape(cells)
        n = n_by_feature.reshape(k, len(nodes), width).transpose(1, 0, 2).reshape(cells)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(full, -1)), pa.array(np.append(g[full], held[0])), pa.array(np.append(n[full], held[1]))],
            names=["cell", "g", "n"],
        )

    sums = rows.mapInArrow(run, "cell long, g double, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    cell, g, n = (sums.column(c).to_numpy() for c in ("cell", "g", "n"))
    hist = np.zeros((cells, 2))
    inside = cell >= 0
    hist[cell[inside], 0], hist[cell[inside], 1] = g[inside], n[inside]
    hist = hist.reshape(len(nodes), k, width, 2)
    error = float((g[~inside].sum()) / max(n[~inside].sum(), 1))
    return {node: hist[i] for i, node in enumerate(nodes)}, error


Counter = Callable[[Tree, list[int], bool], tuple[dict[int, np.ndarray], float]]


def _grow(count: Counter, model: BoostedTrees, p: BoostParams) -> tuple[Tree, float]:
    """The next tree, and the held-out error before it. ``count`` gives histograms of nodes and, if asked, that error."""
    null_bins = model._null_bins()
    tree = Tree()
    hists, error = count(tree, [0], p.patience is not None)
    found = {0: best_split(hists[0], null_bins, p) if hists[0][0, :, 1].sum() else None}
    # ``tree`` is split further than the leaf limit allows, to count ahead; the order decides what stays.
    kids: dict[int, tuple[int, int]] = {}
    while True:
        kept, waiting = _best_first(found, kids, p.max_leaves)
        ahead = [n for n in waiting if n not in kids and (p.max_depth is None or tree.depth[n] < p.max_depth)]
        if not ahead:
            break
        small = []
        for n in ahead:
            gain, f, cut, null_left = found[n]
            kids[n] = tree.split(n, f, cut, null_left, gain)
            left_n = hists[n][f, : cut + 1, 1].sum() + (hists[n][f, null_bins[f], 1] if null_left else 0)
            small.append(kids[n][0] if 2 * left_n <= hists[n][0, :, 1].sum() else kids[n][1])
        counted, _ = count(tree, small, False)
        for n, one in zip(ahead, small):
            other = kids[n][0] if one == kids[n][1] else kids[n][1]
            hists[one], hists[other] = counted[one], hists[n] - counted[one]
            for child in (one, other):
                deep = p.max_depth is not None and tree.depth[child] >= p.max_depth
                found[child] = None if deep else best_split(hists[child], null_bins, p)
    for n in kids:
        if n not in kept:
            tree.feature[n] = -1
    for n, hist in hists.items():
        g, count = hist[0, :, 0].sum(), hist[0, :, 1].sum()
        tree.value[n] = float(-p.rate * g / (count + p.l2)) if count + p.l2 else 0.0
    return tree, error


def _best_first(found: dict, kids: dict, max_leaves: int) -> tuple[set[int], list[int]]:
    """Splits that best-first growth makes as far as children are known, and the leaves it may split next."""
    heap = [(-found[0][0], 0)] if found[0] else []
    kept, waiting = set(), []
    while heap and len(kept) + 1 < max_leaves:
        _, n = heapq.heappop(heap)
        kept.add(n)
        if n not in kids:
            waiting.append(n)
            continue
        for child in kids[n]:
            if found.get(child):
                heapq.heappush(heap, (-found[child][0], child))
    return kept, waiting


def fit_boosting(df: DataFrame, features: Sequence[str], target: str, params: BoostParams = BoostParams()) -> BoostedTrees:
    """Boosted trees on numeric columns; rows without a target are left out. ``df`` is read four times before it is staged."""
    features = list(features)
    known = df.filter(F.col(target).isNotNull())
    edges = fit_edges(known, features, params.max_bins)
    base, n = known.agg(F.avg(F.col(target).cast("double")), F.count(F.lit(1))).first()
    k = len(features)
    model = BoostedTrees(features, edges, base or 0.0, [], [])
    width = max((len(c) + 2 for c in edges), default=1)
    inputs = [F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    held = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(10)) == 0 if params.patience else F.lit(False)
    raw = known.select(*inputs, F.col(target).cast("double").alias("y"), held.alias("held"))
    kind = np.uint8 if width <= 256 else np.int16

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for batch in batches:
            parts.append((bins_of(batch.columns[:k], edges).astype(kind), batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield whole(parts, count)
                parts, count = [], 0
        if count:
            yield whole(parts, count)

    def whole(parts: list, count: int) -> pa.RecordBatch:
        bins, y, out = np.concatenate([b for b, _, _ in parts], axis=1), *(np.concatenate(c) for c in list(zip(*parts))[1:])
        return pa.RecordBatch.from_pylist([_block(bins, y, np.full(count, model.base), out)], schema=_arrow_blocks())

    rows = stage(raw.mapInArrow(binned, BLOCKS))
    if n <= LOCAL_ROWS:
        return _boost_in_task(rows, model, params, width)
    since = 0

    def count(tree: Tree, nodes: list[int], check: bool) -> tuple[dict[int, np.ndarray], float]:
        nonlocal rows, since
        if nodes == [0] and len(model.trees) - since >= STAGE_ROUNDS:
            rows, since = stage(_advanced(rows, model, since)), len(model.trees)
        return _histograms(rows, model, since, tree, nodes, width, check)

    return _boost(count, model, params)


def _boost(count: Counter, model: BoostedTrees, params: BoostParams) -> BoostedTrees:
    """Tree after tree, until the rounds are over or nothing gains any more."""
    for _ in range(params.iterations):
        tree, error = _grow(count, model, params)
        if params.patience is not None:
            model.errors.append(error)
            if len(model.errors) > params.patience and min(model.errors[-params.patience :]) > model.errors[-params.patience - 1] - params.tolerance:
                break
        if tree.feature[0] < 0:
            break  # nothing gains any more
        model.trees.append(tree)
    return model


def _boost_in_task(rows: DataFrame, model: BoostedTrees, params: BoostParams, width: int) -> BoostedTrees:
    """All trees of a small table, grown by one task: passes over few rows would be nothing but their fixed costs."""
    k, null_bins = len(model.features), model._null_bins()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.array(bins), np.array(y), np.array(p), np.array(out)) for batch in batches for bins, y, p, out in _blocks(batch, k)]
        empty = (np.zeros((k, 0), np.uint8), np.zeros(0), np.zeros(0), np.zeros(0, bool))
        bins, y, value, out = (np.concatenate(c, axis=-1) for c in zip(*(found or [empty])))
        grown, place = BoostedTrees(model.features, model.edges, model.base, [], []), np.zeros(len(y), np.int64)

        def count(tree: Tree, nodes: list[int], check: bool) -> tuple[dict[int, np.ndarray], float]:
            nonlocal value, place
            if nodes == [0]:
                if grown.trees:
                    # Nodes are numbered as they were split, also those that were merged again.
                    value = grown.add(bins, value, len(grown.trees) - 1)
                place = np.zeros(len(y), np.int64)
            else:
                place = tree.place(bins, null_bins)
            slot_of = np.full(len(tree.feature), -1)
            slot_of[nodes] = np.arange(len(nodes))
            slot = slot_of[place]
            use = np.flatnonzero((slot >= 0) & ~out)
            err, first, size = value[use] - y[use], slot[use] * width, len(nodes) * width
            hist = np.zeros((len(nodes), k, width, 2))
            for f in range(k):
                at = first + bins[f, use]
                hist[:, f, :, 0] = np.bincount(at, err, size).reshape(len(nodes), width)
                hist[:, f, :, 1] = np.bincount(at, minlength=size).reshape(len(nodes), width)
            error = float(((value[out] - y[out]) ** 2).sum() / max(out.sum(), 1)) if check else 0.0
            return {node: hist[i] for i, node in enumerate(nodes)}, error

        _boost(count, grown, params)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((grown.trees, grown.errors))], pa.binary())], names=["model"])

    model.trees, model.errors = pickle.loads(rows.coalesce(1).mapInArrow(run, "model binary").first()[0])
    return model


def _arrow_blocks() -> pa.Schema:
    return pa.schema([("rows", pa.int32()), *[(c, pa.binary()) for c in ("bins", "y", "p", "held")]])


def _advanced(rows: DataFrame, model: BoostedTrees, since: int) -> DataFrame:
    """The rows with the trees from ``since`` on added to their predictions."""
    k, trees = len(model.features), BoostedTrees(model.features, model.edges, model.base, list(model.trees), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, y, p, held in _blocks(batch, k):
                yield pa.RecordBatch.from_pylist([_block(bins, y, trees.add(bins, p, since), held)], schema=_arrow_blocks())

    return rows.mapInArrow(run, BLOCKS)
