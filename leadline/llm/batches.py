"""Arrow batches for operators that work row by row on texts in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leadline.llm.columns import free_name, without

# Bytes of text that one call of a batch function sees at most, unless one text is longer.
SLICE_BYTES = 8 << 20


def free_memory() -> None:
    """Give back what a task no longer holds; its Python worker stays for later tasks, idle or not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes."""
    begin, held = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for k, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    work: Callable[[pa.Array, pa.RecordBatch], dict[str, list | pa.Array]],
    keep: list[str] | None = None,
    as_bytes: bool = True,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns of ``df`` and the columns that ``work`` gives for its texts.

    ``work`` gets the texts of a slice of about ``limit`` bytes as an Arrow array, UTF-8 bytes or strings, and the slice
    with the kept columns. It returns a column of equal length for each field. Columns of
    ``keep`` named like a field are replaced.
    """
    kept = without(df.columns if keep is None else keep, [f.name for f in fields])
    text = free_name(df, "text_in")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("binary" if as_bytes else "string").alias(text))
    schema = T.StructType([f for f in source.schema.fields if f.name != text] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                made = work(part.column(text), part)
                columns = [part.column(c) for c in kept]
                columns += [
                    v if isinstance(v, pa.Array) else pa.array(v, arrow.field(f.name).type)
                    for f in fields
                    for v in [made[f.name]]
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[f.name for f in fields]])
                made = columns = part = None
            batch = None
        free_memory()

    return source.mapInArrow(run, schema)
