"""What the trainers of forests share: nodes that one task grows on, and models larger than the driver.

A trainer splits large nodes itself, in passes over all rows. A node of at most ``LOCAL_ROWS`` rows is cheaper to finish
where its rows are: ``grow_small`` moves the rows of each such node to a task, which grows everything below it and
writes the nodes it made. Trees take their turns in groups of at most ``GROUP_ROWS`` rows times trees, so what is moved
at once does not grow with the forest. Finished trees are broadcast in parts of about ``NODES_AT_ONCE`` nodes; the
driver and a worker hold one part at a time, however large the forest is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.session import stage

LOCAL_ROWS = 250_000
GROUP_ROWS = 200_000_000
NODES_AT_ONCE = 4_000_000
# Rows that are scored together if the model has several parts.
CHUNK_ROWS = 1 << 20
SLICE_ROWS = 1 << 14

KINDS = {"feature": np.int16, "cut": np.float64, "left": np.int32, "value": np.float64, "gain": np.float64}
Columns = dict[str, np.ndarray]


@dataclass
class TopTree:
    """Nodes by number, 0 the root; the right child follows the left. A value goes left if it is at most ``cut``,
    nulls go right. ``number`` is the place as in a heap: 0, then 2n + 1 and 2n + 2."""

    number: list[int] = field(default_factory=lambda: [0])
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, at: int, feature: int, cut: float, gain: float) -> list[int]:
        self.feature[at], self.cut[at], self.gain[at], self.left[at] = feature, cut, gain, len(self.feature)
        for side in (1, 2):
            self.number.append(2 * self.number[at] + side)
            for column, value in (("feature", -1), ("cut", 0.0), ("left", -1), ("value", 0.0), ("gain", 0.0)):
                getattr(self, column).append(value)
        return [self.left[at], self.left[at] + 1]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each column of a (features x rows) matrix."""
        out, todo = np.zeros(x.shape[1], np.int64), [(0, np.arange(x.shape[1], dtype=np.int32))]
        while todo:
            node, rows = todo.pop()
            f = self.feature[node]
            if f < 0:
                out[rows] = node
                continue
            to_left = x[f][rows] <= self.cut[node]
            todo += [(child, part) for child, part in ((self.left[node], rows[to_left]), (self.left[node] + 1, rows[~to_left])) if len(part)]
        return out

    def columns(self) -> Columns:
        return {name: np.array(getattr(self, name), kind) for name, kind in KINDS.items()}


def bins_of(columns: list[pa.Array], edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of raw values, features x rows; nulls and NaN get the last bin."""
    out = np.empty((len(edges), len(columns[0]) if columns else 0), np.int16)
    for k, (column, cut) in enumerate(zip(columns, edges)):
        value = column.to_numpy(zero_copy_only=False).astype(float)
        out[k] = np.where(np.isnan(value), len(cut) + 1, np.searchsorted(cut, value, side="left"))
    return out


def matrix_of(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Values, features x rows; nulls become NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns]) if columns else np.zeros((0, rows))


def leaf_values(x: np.ndarray, nodes: Columns, root: int) -> np.ndarray:
    """The value of the leaf of each row of a (rows x features) matrix."""
    n, k = x.shape
    feature, cut, left, value = (nodes[c] for c in ("feature", "cut", "left", "value"))
    out = np.empty(n)
    for begin in range(0, n, SLICE_ROWS):
        flat = x[begin : begin + SLICE_ROWS].ravel()
        rows = np.arange(begin, min(begin + SLICE_ROWS, n))
        node, at = np.full(len(rows), root, np.int64), (rows - begin) * k
        while len(rows):
            f = feature[node]
            done = f < 0
            if done.any():
                out[rows[done]] = value[node[done]]
                rest = ~done
                rows, node, at, f = rows[rest], node[rest], at[rest], f[rest]
            node = left[node] + ~(flat[at + f] <= cut[node])
    return out


@dataclass
class GrownTrees:
    """A forest. ``parts`` are broadcast nodes with the roots of their trees; ``edges``, if any, tell the bins that cuts mean."""

    features: list[str]
    edges: list[np.ndarray] | None = None
    parts: list[Broadcast] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    @property
    def trees(self) -> list:
        """All trees as nodes in columns, for forests that fit on the driver."""
        out = []
        for part in self.parts:
            ends = [*part.value["roots"][1:], len(part.value["feature"])]
            for begin, end in zip(part.value["roots"], ends):
                tree = TopTree()
                for name in KINDS:
                    setattr(tree, name, part.value[name][begin:end])
                out.append(tree)
        return out

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """``df`` with the mean of the trees' leaf values, in one pass."""
        parts, edges, base, k, trees = self.parts, self.edges, self.base, len(self.features), max(len(self.weights), 1)
        kept = df.select("*", *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)])
        schema = df.withColumn(name, F.lit(0.0)).schema
        narrow = np.uint8 if edges is not None and max((len(c) + 2 for c in edges), default=1) <= 256 else None

        def inputs(batch: pa.RecordBatch) -> np.ndarray:
            columns = batch.columns[batch.num_columns - k :]
            x = matrix_of(columns, batch.num_rows) if edges is None else bins_of(columns, edges)
            return np.ascontiguousarray((x if narrow is None else x.astype(narrow)).T)

        def scored(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate([inputs(b) for b in held])
            total = np.zeros(len(x))
            for part in parts:
                nodes = part.value
                for root in nodes["roots"]:
                    total += leaf_values(x, nodes, root)
                if len(parts) > 1:
                    del nodes, part._value  # read again for the next rows
            begin = 0
            for batch in held:
                value = pa.array(base + total[begin : begin + batch.num_rows] / trees)
                begin += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - k], value], names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for batch in batches:
                held, rows = [*held, batch], rows + batch.num_rows
                if len(parts) < 2 or rows >= CHUNK_ROWS:
                    yield from scored(held)
                    held, rows = [], 0
            if held:
                yield from scored(held)

        return kept.mapInArrow(run, schema)

    def importance(self) -> dict[str, float]:
        """Each feature's part of the fall in squared error, as the mean of the trees that split at all."""
        split = [w / w.sum() for w in self.weights if w.sum() > 0]
        return dict(zip(self.features, np.mean(split, axis=0).tolist() if split else [0.0] * len(self.features)))

    def add(self, tops: dict[int, TopTree], grown: DataFrame | None) -> None:
        """Take in finished trees: their tops, and the staged nodes below."""
        sizes = {t: len(top.feature) for t, top in tops.items()}
        if grown is not None:
            for r in grown.groupBy("tree").agg(F.sum("n").alias("n")).collect():
                sizes[r["tree"]] += r["n"]
        part: list[int] = []
        for t in tops:
            if part and sum(sizes[x] for x in part) + sizes[t] > NODES_AT_ONCE:
                self._broadcast(part, tops, grown)
                part = []
            part.append(t)
        if part:
            self._broadcast(part, tops, grown)

    def _broadcast(self, trees: list[int], tops: dict[int, TopTree], grown: DataFrame | None) -> None:
        below: dict[int, list[tuple[int, Columns]]] = {t: [] for t in trees}
        if grown is not None:
            found = grown.filter(F.col("tree").isin(trees)).toArrow()
            for i, (t, leaf) in enumerate(zip(found.column("tree").to_pylist(), found.column("leaf").to_pylist())):
                below[t].append((leaf, {name: np.frombuffer(found.column(name)[i].as_buffer(), kind) for name, kind in KINDS.items()}))
        out, roots, size = {name: [] for name in KINDS}, [], 0
        for t in trees:
            nodes = _joined(tops[t].columns(), sorted(below[t], key=lambda x: x[0]))
            inner = nodes["feature"] >= 0
            self.weights.append(np.bincount(nodes["feature"][inner], nodes["gain"][inner], len(self.features)))
            nodes["left"] = np.where(inner, nodes["left"] + size, -1).astype(np.int32)
            roots.append(size)
            size += len(inner)
            for name in KINDS:
                out[name].append(nodes[name])
        context = SparkSession.active().sparkContext
        self.parts.append(context.broadcast({"roots": roots, **{name: np.concatenate(c) for name, c in out.items()}}))


def _joined(top: Columns, below: list[tuple[int, Columns]]) -> Columns:
    """One tree of its top and what was grown from its leaves: a leaf becomes the root of what is below it."""
    out, size = {name: [c] for name, c in top.items()}, len(top["feature"])
    for leaf, nodes in below:
        left = np.where(nodes["feature"] >= 0, nodes["left"] + (size - 1), -1)
        for name in KINDS:
            column = left if name == "left" else nodes[name]
            out[name][0][leaf] = column[0]
            out[name].append(column[1:])
        size += len(left) - 1
    return {name: np.concatenate(c).astype(KINDS[name]) for name, c in out.items()}


def groups_of(trees: int, rows: int) -> Iterator[range]:
    """Trees that are grown together."""
    step = max(GROUP_ROWS // max(rows, 1), 1)
    for begin in range(0, trees, step):
        yield range(begin, min(begin + step, trees))


def grow_small(
    rows: DataFrame,
    tops: dict[int, TopTree],
    waiting: dict[tuple[int, int], int],
    kinds: Sequence[np.dtype],
    blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    weigh: Callable[[int, int, int], np.ndarray] | None,
    grow: Callable[[int, int, int, list[np.ndarray], np.ndarray, np.ndarray], Columns],
    expected: int,
) -> DataFrame:
    """The nodes below the leaves ``waiting`` ((tree, leaf) -> depth), staged: tree, leaf, number of nodes and their columns.

    ``blocks`` reads numbered (features x rows) matrices and their targets from a task's batches, ``weigh`` says how often
    a tree sees the rows of a block, ``grow`` grows a node from its rows. At most ``expected`` rows times trees are moved.
    """
    spark, wanted = rows.sparkSession, {}
    for t, top in tops.items():
        flags = np.zeros(len(top.feature), bool)
        flags[[leaf for tree, leaf in waiting if tree == t]] = True
        wanted[t] = flags
    numbers = {(t, leaf): (tops[t].number[leaf], depth) for (t, leaf), depth in waiting.items()}
    names = ["tree", "leaf", "block", "x", "y", "w"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x, y in blocks(batches):
            for t, top in tops.items():
                leaf = top.place(x)
                use = wanted[t][leaf]
                w = None if weigh is None else weigh(t, block, len(y))
                idx = np.flatnonzero(use if w is None else use & (w > 0))
                idx = idx[np.argsort(leaf[idx], kind="stable")]
                at, first = np.unique(leaf[idx], return_index=True)
                cells = [
                    (b"".join(x[f][i].astype(kind).tobytes() for f, kind in enumerate(kinds)), y[i].tobytes(), b"" if w is None else w[i].tobytes())
                    for i in np.split(idx, first[1:]) if len(i)
                ]
                if cells:
                    m = len(cells)
                    ids = [pa.array([t] * m, pa.int32()), pa.array(at, pa.int32()), pa.array([block] * m, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, pa.binary()) for c in zip(*cells)]], names=names)

    def finished(key: tuple[int, int], pieces: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        xs: list[list[np.ndarray]] = [[] for _ in kinds]
        for x, y, _ in pieces:
            begin, n = 0, len(y) // 8
            for f, kind in enumerate(kinds):
                xs[f].append(np.frombuffer(x, kind, n, begin))
                begin += n * np.dtype(kind).itemsize
        y = np.concatenate([np.frombuffer(y) for _, y, _ in pieces])
        w = np.concatenate([np.frombuffer(w, np.uint8) for _, _, w in pieces]).astype(float) if weigh is not None else np.ones(len(y))
        nodes = grow(key[0], *numbers[key], [np.concatenate(c) for c in xs], y, w)
        cells = [pa.array([np.ascontiguousarray(nodes[name], kind).tobytes()], pa.binary()) for name, kind in KINDS.items()]
        ids = [pa.array([v], pa.int32()) for v in (*key, len(nodes["feature"]))]
        return pa.RecordBatch.from_arrays([*ids, *cells], names=["tree", "leaf", "n", *KINDS])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "leaf", "x", "y", "w")]
            for t, leaf, *piece in zip(*columns):
                if (t, leaf) != key and pieces:
                    yield finished(key, pieces)
                    pieces = []
                key = (t, leaf)
                pieces.append(piece)
        if pieces:
            yield finished(key, pieces)

    tasks = min(len(waiting), max(4 * spark.sparkContext.defaultParallelism, expected // (4 * LOCAL_ROWS) + 1))
    moved = rows.mapInArrow(send, "tree int, leaf int, block long, x binary, y binary, w binary")
    moved = moved.repartition(max(tasks, 1), "tree", "leaf").sortWithinPartitions("tree", "leaf", "block")
    return stage(moved.mapInArrow(take, "tree int, leaf int, n int, " + ", ".join(f"{name} binary" for name in KINDS)))


def release_shuffles(rows: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished groups: its cleaner waits for the JVM's garbage collection."""
    rows.sparkSession.sparkContext._jvm.System.gc()
