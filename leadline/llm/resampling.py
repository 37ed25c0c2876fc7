r"""Importance resampling towards a target distribution, on hashed word n-grams.

Features are all runs of 1 to 3 words, in buckets of their CRC-32. A bucket's gain is 1000 times the log
ratio of its share of the target texts and its share of all texts, floored. A document's weight is
the sum of its features' gains; Gumbel noise from a hash of its id makes the highest scores a draw without
replacement in proportion to exp(weight / 1000).

Both passes work on Arrow arrays. A slice of texts is lower-cased and split by Arrow kernels, its words are
flattened and dictionary-encoded, and shifted dictionary indices form the n-grams. Only different n-grams get a
CRC, which is put together from the CRCs of their parts; gains are taken by dictionary index and summed per document
by segment. What leaves the first pass is at most one count per bucket and task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm import batches
from leadline.llm.columns import free_name
from leadline.operators.ranking import global_rank
from leadline.session import stage

BUCKETS = 10_000
LONGEST = 3
SEED = 42
MIN_WORDS = 20
DRAW_PERCENT = 5
# Bytes of text whose n-grams are worked on at once, unless one text is longer.
SLICE_BYTES = 2 << 20
_SPACE_CRC = zlib.crc32(b" ")
# What separates words, once A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class _Shift:
    """What a CRC-32 becomes when bytes follow: the CRC of AB is shift(crc of A, length of B) xor crc of B.

    The shift is linear over bits, so 4 x 256 words hold what it does to the bytes of a CRC. Tables of 1, 2, 4, ...
    bytes are kept, and those of other lengths put together from them.
    """

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
        ones = np.arange(256, dtype=np.uint32)
        self.nothing = np.stack([ones << np.uint32(8 * k) for k in range(4)])
        self.powers = [(self.nothing >> np.uint32(8)) ^ step[self.nothing & 255]]

    @staticmethod
    def apply(tables: np.ndarray, crc: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
        """``crc`` shifted by the table of its ``kind``, of several tables one behind the other."""
        flat, at = tables.reshape(-1), np.asarray(kind) * 1024
        out = flat[at + (crc & np.uint32(255))]
        for k in range(1, 4):
            out ^= flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
        return out

    def of(self, length: int) -> np.ndarray:
        table, k = self.nothing, 0
        while length >> k:
            if k == len(self.powers):
                self.powers.append(self.apply(self.powers[-1], self.powers[-1]))
            if length >> k & 1:
                table = self.apply(self.powers[k], table)
            k += 1
        return table


_SHIFT = _Shift()


def _offsets(lists: pa.ListArray) -> np.ndarray:
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one text after the other, and the bounds of each text's words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), _GAP)
    words, bounds = pc.list_flatten(lists), _offsets(lists)
    filled = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), upto[bounds]


def feature_buckets(
    words: pa.Array, bounds: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: the first word of each n-gram, and the n-gram's bucket. None crosses from text to text."""
    coded = words.dictionary_encode()
    size = len(coded.dictionary)
    ids = coded.indices.to_numpy().astype(np.int64)
    different_words = coded.dictionary.cast(pa.binary()).to_pylist()
    crcs = np.fromiter(map(zlib.crc32, different_words), np.uint32, size)
    yield np.arange(len(ids)), (crcs % np.uint32(buckets)).astype(np.int64)[ids]
    # " word" behind another n-gram: its own CRC, and the table of its length.
    lengths, kind = np.unique(pc.binary_length(coded.dictionary).to_numpy() + 1, return_inverse=True)
    tables = np.stack([_SHIFT.of(int(n)) for n in lengths]) if size else np.zeros((1, 4, 256), np.uint32)
    kind = kind.astype(np.int64)
    spaced = np.fromiter((zlib.crc32(w, _SPACE_CRC) for w in different_words), np.uint32, size)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(ids))  # words from here to the text's end
    grams, gram_crcs = ids, crcs
    first = np.arange(len(ids))
    for n in range(2, longest + 1):
        inside = left[first] >= n
        first, before = first[inside], grams[inside]
        # The n-gram is the (n - 1)-gram and the word behind it; a number below gram count x word count.
        pairs = pa.array(before * size + ids[first + n - 1]).dictionary_encode()
        different = pairs.dictionary.to_numpy()
        head, tail = different // max(size, 1), different % max(size, 1)
        gram_crcs = _SHIFT.apply(tables, gram_crcs[head], kind[tail]) ^ spaced[tail]
        grams = pairs.indices.to_numpy().astype(np.int64)
        yield first, (gram_crcs % np.uint32(buckets)).astype(np.int64)[grams]


def bucket_counts(df: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket and n, the features of all texts in it; buckets without any are left out."""
    text = df.select(F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in parts:
            for part in batches.slices(batch, "text", SLICE_BYTES):
                for _, found in feature_buckets(*words_of(part.column("text")), buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])
        batches.free_memory()

    return text.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class Resampler:
    """Gains per bucket."""

    gains: np.ndarray
    longest: int = LONGEST

    def weigh(
        self, df: DataFrame, text_col: str = "text", n_words: str = "n_words", n_features: str = "n_features",
        weight: str = "weight", keep: list[str] | None = None,
    ) -> DataFrame:
        """``df`` with the words, features and weight of each text; columns of these names are replaced.

        Null, empty and wordless texts have no features and weight 0.
        """
        gains, longest = self.gains, self.longest

        def work(texts: pa.Array, _: pa.RecordBatch) -> dict:
            words, bounds = words_of(texts)
            gained = np.zeros(len(words), np.int64)
            begun = np.zeros(len(words), np.int64)
            for first, found in feature_buckets(words, bounds, len(gains), longest):
                # An n-gram begins at most once at a word.
                gained[first] += gains[found]
                begun[first] += 1
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (begun, gained)]
            counts, weights = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
            return {n_words: pa.array(np.diff(bounds)), n_features: pa.array(counts), weight: pa.array(weights)}

        fields = [T.StructField(c, T.LongType()) for c in (n_words, n_features, weight)]
        return batches.map_texts(df, text_col, fields, work, keep, as_bytes=False, limit=SLICE_BYTES)


def fit(
    raw: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS,
    longest: int = LONGEST,
) -> Resampler:
    """Gains that lead from all ``raw`` texts to all ``target`` texts, one pass over each.

    A bucket with s of S raw and t of T target features gains
    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))). Only ``buckets`` counts come to the driver.
    """

    def counts(df: DataFrame, column: str) -> np.ndarray:
        total = np.zeros(buckets)
        for r in bucket_counts(df, column, buckets, longest).collect():
            total[r["bucket"]] = r["n"]
        return total

    s, t = counts(raw, text_col), counts(target, target_col)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return Resampler(np.floor(1000 * np.log(ratio)).astype(np.int64), longest)


def noise(identity: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    min_words: int = MIN_WORDS,
    draw_percent: int = DRAW_PERCENT,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all but the text) with n_words, n_features, weight, score and rank
    (1, 2, ... of the drawn rows, else null).

    Of the N rows with ``min_words`` words or more, floor(draw_percent * N / 100) are drawn: those
    of the highest scores, ties to the smaller id. Ranks come from a range sort of what is kept, so name the
    text in ``keep`` only where it is needed.

    * Null, empty and wordless texts: no features, weight 0, never drawn.
    * A null id comes after all others of its score; rows that share an id share its noise.
    * An empty table gives an empty table; an empty target gives equal gains to equally frequent buckets.
    * Extra columns named like a result, whatever their case, are left out.
    """
    results = {"n_words", "n_features", "weight", "score", "rank"}
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in dict.fromkeys([id_col, *keep]) if c.lower() not in results]
    model = fit(docs, target, text_col, target_col, buckets, longest)
    # Staged: the range sort reads its input twice.
    weighed = stage(model.weigh(docs, text_col, keep=keep)).withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    enough = F.col("n_words") >= min_words
    small = free_name(weighed, "small")
    ordered = global_rank(weighed.withColumn(small, ~enough), [F.asc(small), F.desc("score"), F.asc_nulls_last(id_col)], "rank")
    n = ordered.where(~F.col(small)).count()
    drawn = draw_percent * n // 100
    return ordered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop(small)
