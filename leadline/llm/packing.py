"""Hierarchical multi-length packing of documents into token sequences.

Documents are routed by length to tiers, the window lengths of TIERS. What a document holds
beyond whole long windows goes on as a fragment of a shorter tier. Each tier's windows are
opened by its own fragments, longest first; the gap of a window is filled with the longest
shorter fragment that fits, and where none fits a fragment is cut to close the gap. Every
window is therefore full, but for the last few of a block.

Documents are packed in blocks of about BLOCK_TOKENS ids, or BLOCK_DOCS documents, as a task reads them: no shuffle, bounded
memory, and a lost task repeats only its own blocks.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadline.llm.batches import free_memory, slices
from leadline.llm.token_ids import encoder

TIERS = (1024, 512, 256, 128, 64)
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 1 << 14
# Sequences of one tier that make a step group.
GROUP = 32

Piece = tuple[int, int, int]  # document, first id, number of ids


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows as (window length, pieces) for documents of the given lengths.

    ``tiers`` are powers of two, longest first. A sequence is shorter than its window only in
    the shortest tier's last window, which is padded to the longest window instead.
    """
    longest = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, first id), ascending
    for doc, n in enumerate(lengths):
        whole = n // longest
        windows += [(longest, [(doc, k * longest, longest)]) for k in range(whole)]
        if n % longest:
            pool.append((n % longest, doc, whole * longest))
    pool.sort()
    left = sum(p[0] for p in pool)
    while pool:
        # The tier of the longest fragment, or the longest tier that what is left can fill.
        room = min(t for t in tiers if t >= pool[-1][0])
        if left < room:
            room = next((t for t in tiers if t <= left), longest)
        size, pieces = room, []
        while room and pool:
            k = bisect_right(pool, (room, len(lengths), 0)) - 1
            if k >= 0:
                n, doc, start = pool.pop(k)
            else:  # none fits: cut the shortest
                n, doc, start = pool.pop(0)
                insort(pool, (n - room, doc, start + room))
                n = room
            pieces.append((doc, start, n))
            room -= n
            left -= n
        windows.append((size, pieces))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], group: int = GROUP) -> list[tuple[int, int]]:
    """(tier, group number in the tier) per window; groups of a tier get like attention costs.

    The cost of a window is the sum of its pieces' squared lengths. Windows are dealt from the
    costliest to the cheapest, forth and back over the groups.
    """
    by_tier: dict[int, list[int]] = {}
    for k, (size, _) in enumerate(windows):
        by_tier.setdefault(size, []).append(k)
    out = [(0, 0)] * len(windows)
    for size, members in by_tier.items():
        n = -(-len(members) // group)
        members.sort(key=lambda k: (-sum(p[2] ** 2 for p in windows[k][1]), k))
        for rank, k in enumerate(members):
            lap, place = divmod(rank, n)
            out[k] = (size, place if lap % 2 == 0 else n - 1 - place)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers; a document's ids are
    those of its text and then ``end_id``. ``start`` counts the document's ids before the piece,
    ``offset`` the sequence's. A null or empty text is the end id alone. Rows are packed one by
    one: rows with equal or null ids are separate documents of the same name, and equal rows
    repeat. An empty table gives no pieces. Extra columns are not read. Sequence and step group
    numbers are unique, not dense: they hold the number of the task that made them.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset", "step_group")
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in longs]
        + [T.StructField("tier", T.IntegerType())]
    )
    arrow = to_arrow_schema(schema)

    def block(names: list[pa.Array], ids: list[np.ndarray], sequence: count, groups: count) -> Iterator[pa.RecordBatch]:
        windows = pack_lengths([len(x) for x in ids], tiers)
        dealt, numbers = step_groups(windows, group), {}
        rows, docs_of = {f.name: [] for f in schema.fields}, []
        for (_, pieces), where in zip(windows, dealt):
            number, at = next(sequence), 0
            if where not in numbers:
                numbers[where] = next(groups)
            for doc, start, n in pieces:
                docs_of.append(doc)
                rows["ids"].append(ids[doc][start : start + n].tobytes())
                for name, value in zip(longs, (start, n, len(ids[doc]), number, at, numbers[where])):
                    rows[name].append(value)
                rows["tier"].append(where[0])
                at += n
        rows["doc_id"] = pa.concat_arrays(names).take(pa.array(docs_of, pa.int64()))
        columns = [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(c).type) for c, v in rows.items()]
        whole = pa.RecordBatch.from_arrays(columns, names=list(rows))
        for at in range(0, whole.num_rows, 2000):
            yield whole.slice(at, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same input split gives the same numbers when a task is repeated.
        first = TaskContext.get().partitionId() << 32
        sequence, groups = count(first), count(first)
        names, ids, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", min(8 << 20, 4 * block_tokens)):
                flat, counts = encoder(tokenizer).encode(part.column("text"))
                ends = np.cumsum(counts)
                names.append(part.column("doc_id"))
                for a, b in zip((ends - counts).tolist(), ends.tolist()):
                    ids.append(np.append(flat[a:b], end_id).astype("<u4"))
                held += int(ends[-1]) + len(counts)
                if held >= block_tokens or len(ids) >= BLOCK_DOCS:
                    yield from block(names, ids, sequence, groups)
                    names, ids, held = [], [], 0
        if ids:
            yield from block(names, ids, sequence, groups)
        names = ids = flat = part = batch = None
        free_memory()

    return source.mapInArrow(run, schema)
