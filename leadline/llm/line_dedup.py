"""Line dedup: lines found in many documents stay in one of them only.

DataFrame functions only. Lines are exploded with their position, normalised and hashed;
documents per hash are counted; the positions to drop are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.columns import ascii_lower, free_name, strip_space, without


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    r"""``docs`` with repeated lines removed from the text, and two counts per row.

    A text is split at \n. A line's key is the line without ASCII white space at both ends,
    A-Z lower-cased. A key of at least ``min_chars`` code points that at least ``min_docs``
    different ids hold keeps its lines only in the largest of these ids.

    * Null or empty text: one empty line, which is never dropped; the result text is "".
    * Null id: all such rows count as one document, smaller than any id.
    * Rows that share an id are one document: each is cleaned by itself, and an id counts
      once per key.
    * Equal rows stay equal rows. An empty table gives an empty table.
    * Other columns pass through; extra columns named like the counts are replaced.

    Keys are compared by 96 hash bits. A key held by very many documents is counted by
    partial sums and joined back by a join that Spark may split, so it never meets in one
    task.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in without(docs.columns, (n_lines, n_dropped))])
    row, text, pos, line, h1, h2, top, many, gone, parts, gone_id, gone_row = (
        free_name(docs, c)
        for c in ("row", "whole_text", "pos", "line", "h1", "h2", "top", "many", "gone", "parts", "gone_id", "gone_row")
    )
    # Rows that share an id may have different texts, hence the text's hash as part of the key.
    whole = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(row, F.xxhash64(text))

    lines = whole.select(F.col(id_col).alias("id"), row, F.posexplode(F.split(text, "\n", -1)).alias(pos, line))
    keyed = lines.withColumn(line, strip_space(F.col(line))).where(F.char_length(line) >= min_chars)
    keyed = keyed.withColumn(line, ascii_lower(F.col(line))).select(
        "id", row, pos, F.xxhash64(line).alias(h1), F.hash(line).alias(h2)
    )
    # Distinct (key, id) first, so that an id counts once; both steps sum before they shuffle.
    held = keyed.groupBy(h1, h2, "id").agg(F.count(F.lit(1)).alias("n"))
    frequent = (
        held.groupBy(h1, h2)
        .agg(F.count(F.lit(1)).alias(many), F.max("id").alias(top))
        .where(F.col(many) >= min_docs)
        .select(h1, h2, top)
    )
    dropped = (
        keyed.join(frequent, [h1, h2])
        .where(~F.col("id").eqNullSafe(F.col(top)))
        .groupBy("id", row)
        .agg(F.collect_set(pos).alias(gone))
        .select(F.col("id").alias(gone_id), F.col(row).alias(gone_row), gone)
    )
    joined = whole.join(
        dropped, whole[id_col].eqNullSafe(dropped[gone_id]) & (whole[row] == dropped[gone_row]), "left"
    ).withColumn(parts, F.split(text, "\n", -1))
    # array_except keeps the order and works by a hash set: linear in the lines of a text.
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(F.col(parts), i)
    )
    out = {
        text_col: F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        n_lines: F.size(parts).cast("long"),
        n_dropped: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }
    return joined.select(
        *[out.pop(c).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        *[value.alias(c) for c, value in out.items()],
    )
