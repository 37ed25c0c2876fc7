"""Token id files, compressed by Re-Pair grammars, with random access.

``write`` sorts documents by id, encodes them, and writes shards as Parquet rows. A shard holds
about SHARD_IDS ids of consecutive documents. Its grammar is built by Re-Pair: the most frequent
pairs of neighbouring symbols are replaced by new symbols (nonterminals), again and again. No
rule crosses the end of a document.

A shard row has: ``part`` (write task, in id order), ``piece`` (shard in the part), ``first`` (ids
of the part before the shard), ``n_ids``, ``doc_ids``, ``n_tokens`` and ``n_symbols`` per document,
and the grammar: ``base`` (first nonterminal), ``rules`` (two unsigned 16-bit symbols each),
``spans`` (ids that each rule expands to, unsigned 32-bit) and ``symbols`` (unsigned 16-bit). All
numbers are little-endian. Every symbol fits 16 bits, which bounds the rules of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadline.llm.batches import free_memory, slices
from leadline.llm.columns import free_name
from leadline.llm.token_ids import encoder

SHARD_IDS = 1 << 20
LEAST_COUNT = 6  # a pair is replaced if it occurs so often in the shard
MAX_SYMBOL = 1 << 16
MAX_BROADCAST_PARTS = 200_000


@dataclass
class Grammar:
    base: int
    rules: np.ndarray  # (n, 2), unsigned 16-bit
    symbols: np.ndarray  # unsigned 16-bit
    n_symbols: np.ndarray  # per document

    def spans(self) -> np.ndarray:
        """Ids that each rule expands to."""
        out: list[int] = []
        size = lambda s: 1 if s < self.base else out[s - self.base]
        for a, b in self.rules.tolist():
            out.append(size(a) + size(b))
        return np.array(out, dtype="<u4")

    def expansions(self) -> list[bytes]:
        """The ids of every nonterminal, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        of = lambda s: s.to_bytes(4, "little") if s < self.base else out[s - self.base]
        for a, b in self.rules.tolist():
            out.append(of(a) + of(b))
        return out


def re_pair(ids: np.ndarray, counts: np.ndarray, base: int, least: int = LEAST_COUNT) -> Grammar:
    """Grammar of documents given as one run of ids and the number of ids of each.

    Each round counts all neighbouring pairs inside documents and replaces those at least a third
    as frequent as the round before asked for, from the most frequent on. Where chosen pairs
    overlap, a run of them is replaced from its left end. Rounds go on until no pair occurs
    ``least`` times or 16-bit symbols run out.
    """
    if base > MAX_SYMBOL or len(ids) and int(ids.max()) >= base:
        raise ValueError("ids must be smaller than base, and base at most 65536")
    symbols = ids.astype(np.uint32)
    ends = np.cumsum(counts)
    last = np.zeros(len(symbols), bool)
    last[ends[counts > 0] - 1] = True
    owner_sizes = counts.astype(np.int64)
    rules: list[np.ndarray] = []
    free = base
    bits = 18
    asked = len(symbols)
    while free < MAX_SYMBOL and len(symbols) > 1:
        keys = (symbols[:-1] << np.uint32(16)) | symbols[1:]
        inside = ~last[:-1]
        ordered = np.sort(keys[inside])
        if not len(ordered):
            break
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        pairs, times = ordered[edges], np.diff(np.append(edges, len(ordered)))
        asked = max(least, min(asked, int(times.max())) // 3)
        frequent = np.flatnonzero(times >= asked)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-times[frequent], kind="stable")][: MAX_SYMBOL - free]
        chosen = pairs[frequent]
        # A table by hash: of chosen pairs with one hash the most frequent stays, the others wait.
        slots = ((chosen * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)
        _, kept = np.unique(slots, return_index=True)
        kept.sort()
        chosen, slots = chosen[kept], slots[kept]
        # Most places are ruled out by one bit per hash, which stays in the processor's cache.
        marked = np.zeros(1 << bits, bool)
        marked[slots] = True
        hashed = (keys * np.uint32(2654435761)) >> np.uint32(32 - bits)
        found = np.flatnonzero(marked[hashed] & inside)
        table = np.zeros(1 << bits, np.int32)
        table[slots] = np.arange(len(chosen))
        at = table[hashed[found]]
        same = chosen[at] == keys[found]
        found, at = found[same], at[same]
        starts = np.concatenate(([True], np.diff(found) != 1))
        place = np.arange(len(found))
        run = place[starts][np.cumsum(starts) - 1]
        even = (place - run) % 2 == 0
        found, at = found[even], at[even]
        used = np.flatnonzero(np.bincount(at, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.uint32)
        number[used] = np.arange(len(used), dtype=np.uint32)
        rules.append(np.stack([chosen[used] >> np.uint32(16), chosen[used] & np.uint32(0xFFFF)], axis=1))
        symbols[found] = np.uint32(free) + number[at]
        free += len(used)
        stay = np.ones(len(symbols), bool)
        stay[found + 1] = False
        last[found] = last[found + 1]
        symbols, last = symbols[stay], last[stay]
    stops = np.append(0, np.flatnonzero(last) + 1)
    owner_sizes[counts > 0] = np.diff(stops)
    made = np.concatenate(rules) if rules else np.zeros((0, 2))
    return Grammar(base, made.astype("<u2"), symbols.astype("<u2"), owner_sizes)


class Shard:
    """Random access to the documents and the ids of one shard."""

    def __init__(self, base: int, rules: bytes, spans: bytes, symbols: bytes, n_symbols, n_tokens):
        self.grammar = Grammar(
            base, np.frombuffer(rules, "<u2").reshape(-1, 2), np.frombuffer(symbols, "<u2"), np.asarray(n_symbols, np.int64)
        )
        self.spans = np.frombuffer(spans, "<u4")
        self.n_tokens = np.asarray(n_tokens, np.int64)
        self.bounds = np.append(0, np.cumsum(self.grammar.n_symbols))
        self._table: list[bytes] | None = None

    def documents(self) -> Iterator[bytes]:
        """Ids of every document, in order."""
        if self._table is None:
            self._table = [k.to_bytes(4, "little") for k in range(self.grammar.base)] + self.grammar.expansions()
        of, symbols = self._table.__getitem__, self.grammar.symbols.tolist()
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            yield b"".join(map(of, symbols[a:b]))

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the shard's id number ``start`` on; expands only the rules it meets."""
        base, symbols, rules, spans = self.grammar.base, self.grammar.symbols, self.grammar.rules, self.spans
        sizes = np.ones(len(symbols), np.int64)
        long = symbols >= base
        sizes[long] = spans[symbols[long].astype(np.int64) - base]
        ends = np.cumsum(sizes)
        k = int(np.searchsorted(ends, start, side="right"))
        out: list[int] = []
        skip = start - (int(ends[k - 1]) if k else 0)
        while len(out) < n and k < len(symbols):
            todo = [int(symbols[k])]
            while todo and len(out) < n:
                s = todo.pop()
                size = 1 if s < base else int(spans[s - base])
                if size <= skip:
                    skip -= size
                elif s < base:
                    out.append(s)
                else:
                    todo += [int(rules[s - base][1]), int(rules[s - base][0])]
            k += 1
        return np.array(out, dtype="<u4")

    def document(self, k: int) -> np.ndarray:
        before = int(self.n_tokens[:k].sum())
        return self.read(before, int(self.n_tokens[k]))


def _schema(kind: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType(
        [T.StructField(c, T.LongType()) for c in ("part", "piece", "first", "n_ids", "base")]
        + [T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_tokens", longs), T.StructField("n_symbols", longs)]
        + [T.StructField(c, T.BinaryType()) for c in ("rules", "spans", "symbols")]
    )


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode ``docs`` in ascending id order, ``end_id`` after each, and write shards to ``path``.

    A null or empty text is the end id alone. Null ids come first; rows with equal ids follow
    each other in the order of a hash of their texts; equal rows are all written. An empty
    table writes no shard. Extra columns are not read.
    """
    schema = _schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def shard(piece: int, first: int, names: list[pa.Array], parts: list[np.ndarray], base: int) -> pa.RecordBatch:
        counts = np.array([len(p) for p in parts], np.int64)
        grammar = re_pair(np.concatenate(parts), counts, base)
        row = {
            "part": TaskContext.get().partitionId(),
            "piece": piece,
            "first": first,
            "n_ids": int(counts.sum()),
            "base": base,
            "doc_ids": pa.concat_arrays(names).to_pylist(),
            "n_tokens": counts.tolist(),
            "n_symbols": grammar.n_symbols.tolist(),
            "rules": grammar.rules.tobytes(),
            "spans": grammar.spans().tobytes(),
            "symbols": grammar.symbols.tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        base = max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        names, parts, held, piece, first = [], [], 0, 0, 0
        for batch in batches:
            for rows in slices(batch, "text", 4 * shard_ids):
                flat, counts = coder.encode(rows.column("text"))
                ends = np.cumsum(counts)
                begin = 0
                for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    parts.append(np.append(flat[a:b], np.uint32(end_id)))
                    held += b - a + 1
                    if held >= shard_ids:
                        names.append(rows.column("doc_id").slice(begin, k + 1 - begin))
                        yield shard(piece, first, names, parts, base)
                        names, parts, first, held, piece, begin = [], [], first + held, 0, piece + 1, k + 1
                if begin < rows.num_rows:
                    names.append(rows.column("doc_id").slice(begin))
        if parts:
            yield shard(piece, first, names, parts, base)
        names = parts = flat = rows = batch = None
        free_memory()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Texts move once, to ranges of ids; what follows runs in the same task.
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids.

    ``start`` counts the ids of all documents before it, over all files. ``ids`` are little-endian
    unsigned 32-bit integers.
    """
    shards = spark.read.parquet(path)
    # One row per write task, from the small columns only.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("part_first"))
    if totals.count() <= MAX_BROADCAST_PARTS:
        totals = F.broadcast(totals)
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    first = free_name(shards, "shard_first")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = Shard(row["base"], row["rules"], row["spans"], row["symbols"], row["n_symbols"], row["n_tokens"])
                counts = np.array(row["n_tokens"], np.int64)
                starts = row[first] + np.cumsum(counts) - counts
                ids = list(found.documents())
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], arrow.field("doc_id").type), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    schema=arrow,
                )
                for at in range(0, whole.num_rows, 2000):
                    yield whole.slice(at, 2000)
                row = found = ids = whole = None
        free_memory()

    placed = shards.join(totals, "part").withColumn(first, F.col("part_first") + F.col("first"))
    return placed.select("base", "doc_ids", "n_tokens", "n_symbols", "rules", "spans", "symbols", first).mapInArrow(decode, schema)
