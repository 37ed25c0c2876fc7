r"""Periodic runs: stretches of consecutive words that repeat with a period, several times over.

A run is a stretch of words with smallest period q (words q apart are equal) that holds at least
``min_periods`` periods and ``min_length`` words, and that no neighbouring word extends. Two suffixes of a text
that start q apart inside a run share a long prefix, so runs are read off the suffix order:

* The suffixes of a text are sorted by prefix doubling, all texts of a slice at once; longest common prefixes (LCP) of
  neighbours come from the doubling's ranks.
* Neighbours are united by falling LCP (Kruskal): classes of suffixes are kept as ordered sets of
  positions, with union-find over them, the smaller set going into the larger. Positions i < j that become
  adjacent in a set have an LCP equal to the level L. If j - i <= L, the words from i to j + L have the
  period j - i, and seed a run; it starts at i where the words before i and j differ.
* A run's first word i and i + q meet at level length - q, and nothing lies between them in their class: a
  position between would give the run a smaller period. So every run is seeded once, by its smallest period.

A run's LCP is at least length - q, which is 16 words at the usual limits. Texts where no 16 words
occur twice have no run and stay out of the sort.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm import batches

MIN_LENGTH = 24
MIN_PERIODS = 3
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def least_lcp(min_length: int, min_periods: int) -> int:
    """The least LCP of a run's first position and the one a period later."""
    return min(max(min_length, min_periods * q) - q for q in range(1, min_length + 1))


def _codes(values: np.ndarray) -> tuple[np.ndarray, int]:
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def repeated_starts(ids: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions where ``width`` words begin that also begin elsewhere in the same text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(ids))
    at = np.arange(len(ids))
    codes, n = _codes(doc * (ids.max(initial=0) + 1) + ids)
    span = 1
    while True:
        # A stretch that is not repeated begins no longer one that is.
        often = np.bincount(codes, minlength=n)[codes] > 1
        at, codes = at[often], codes[often]
        if span == width or not len(at):
            return at
        step = min(span, width - span)  # the last step overlaps
        code_at = np.full(len(ids), -1, np.int64)
        code_at[at] = codes
        fits = left[at] >= span + step
        at, codes = at[fits], codes[fits]
        follow = code_at[at + step]
        at, codes, follow = at[follow >= 0], codes[follow >= 0], follow[follow >= 0]
        codes, n = _codes(codes * n + follow)
        span += step


def suffix_levels(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by the next 1, 2, 4, ... words, the last level by whole suffixes.

    Words of different texts never compare equal, and a text's end comes before any word. About 8 bytes a word and level.
    """
    size = len(ids)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.repeat(bounds[1:], np.diff(bounds))
    key = doc * (ids.max(initial=0) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = _group_starts(order, key[order], size)
    levels, span = [rank], 1
    open_ = _shared(rank, np.arange(size))
    while len(open_):
        # Only positions that still share their rank are sorted on.
        follow = np.where(open_ + span < end[open_], rank[np.minimum(open_ + span, size - 1)] + 1, 0)
        by = np.lexsort((follow, rank[open_]))
        at, lead, follow = open_[by], rank[open_][by], follow[by]
        new_group = np.concatenate([[True], lead[1:] != lead[:-1]])
        new_rank = new_group | np.concatenate([[True], follow[1:] != follow[:-1]])
        row = np.arange(len(at))
        group_row = np.maximum.accumulate(np.where(new_group, row, 0))
        rank_row = np.maximum.accumulate(np.where(new_rank, row, 0))
        rank = rank.copy()
        rank[at] = lead + rank_row - group_row
        levels.append(rank)
        span *= 2
        open_ = _shared(rank, open_)
    return levels


def _group_starts(order: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Rank of each position: the place of the first one with its key."""
    row = np.arange(size)
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), row, 0))
    rank = np.empty(size, np.int64)
    rank[order] = starts
    return rank


def _shared(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    counts = np.bincount(rank[at], minlength=len(rank))
    return at[counts[rank[at]] > 1]


def common_prefix(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCP of the suffixes at a and b, widest level first; ``ends`` is the end of each position's text."""
    size, out = len(levels[0]), np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        span = 1 << k
        # A rank below the top level may be shared by suffixes that end early only if they are equal so far.
        inside = (a < size) & (b < size)
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        same[inside] &= (a[inside] + span <= ends[a[inside]]) & (b[inside] + span <= ends[b[inside]])
        step = np.where(same, span, 0)
        out, a, b = out + step, a + step, b + step
    return out


def _kruskal(ids: list[int], begins: list[int], edges: Iterator[tuple[int, int, int]], min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, positions counted over the slice. ``edges``: (a, b, LCP), largest LCP first."""
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up] if up in parent else up
        return x

    def seed(i: int, j: int, level: int) -> None:
        period = j - i
        length = period + level
        # Extended to the left by one word, the pair would have met at a higher level.
        if period <= level and length >= min_length and length >= min_periods * period and (i == begins[i] or ids[i - 1] != ids[j - 1]):
            found.append((i, length, period))

    for a, b, level in edges:
        a, b = root(a), root(b)
        large, small = held.pop(a, None) or [a], held.pop(b, None) or [b]
        if len(large) < len(small):
            large, small = small, large
        last = len(small) - 1
        for k, x in enumerate(small):
            place = bisect_left(large, x)
            # Adjacent in the union: none of the smaller set lies between.
            if place and (k == 0 or small[k - 1] < large[place - 1]):
                seed(large[place - 1], x, level)
            if place < len(large) and (k == last or small[k + 1] > large[place]):
                seed(x, large[place], level)
        if len(small) * 8 > len(large):
            large = sorted(large + small)  # two sorted parts: linear
        else:
            for x in small:
                insort(large, x)
        parent[b] = a
        held[a] = large
    return found


def runs_of(ids: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """All runs of the texts whose word ids lie in ``ids`` between ``bounds``: rows of text, start, length, period.

    Sorted by text, start, period.
    """
    least = least_lcp(min_length, min_periods)
    starts = repeated_starts(ids, bounds, least)
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    text_of = np.unique(np.searchsorted(bounds, starts, side="right") - 1)
    # Only texts with repeated stretches go on, put together anew.
    sizes = np.diff(bounds)[text_of]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(bounds[text_of] - upto[:-1], sizes) + np.arange(upto[-1])
    part = ids[at]
    ends = np.repeat(upto[1:], sizes)
    levels = suffix_levels(part, upto)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = common_prefix(levels, ends, a, b)
    near = lcp >= least
    a, b, lcp = a[near], b[near], lcp[near]
    fall = np.argsort(-lcp, kind="stable")
    begins = np.repeat(upto[:-1], sizes).tolist()
    edges = zip(a[fall].tolist(), b[fall].tolist(), lcp[fall].tolist())
    found = np.array(_kruskal(part.tolist(), begins, edges, min_length, min_periods), np.int64).reshape(-1, 3)
    text = np.searchsorted(upto, found[:, 0], side="right") - 1
    found = np.column_stack([text_of[text], found[:, 0] - upto[text], found[:, 1], found[:, 2]])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def collapsed(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word stays: those that a run holds after its first period go."""
    change = np.zeros(bounds[-1] + 1, np.int64)
    start = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(
    docs: DataFrame,
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
    keep: list[str] | None = None,
    n_words: str = "n_words",
    runs: str = "runs",
    text_out: str = "collapsed",
) -> DataFrame:
    r"""``keep`` columns (default: all), the number of words, all runs and the text without repeated periods.

    Words are ``[^\x20\x09-\x0D]+``, compared as they are. ``runs`` holds (start, length, period) by
    start, then period; start counts words from 0. Words that a run holds after its first period are dropped from
    ``text_out``; the others stand with single spaces between. One pass, no shuffle; each text is judged whole.

    * Null, empty and blank texts: no words, no runs, an empty text.
    * Very long texts: a text is held in memory with about 8 bytes a word and doubling of its longest repeat.
    * Rows are judged one by one: repeated rows get equal results. An empty table gives an empty table.
    * Other columns pass through; extra columns named like a result, whatever their case, are left out.
    """
    taken = {n_words.lower(), runs.lower(), text_out.lower()}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]

    def work(texts: pa.Array, _: pa.RecordBatch) -> dict:
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words, bounds = pc.list_flatten(lists), lists.offsets.to_numpy().astype(np.int64)
        filled = pc.greater(pc.binary_length(words), 0)
        upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        words, bounds = words.filter(filled), upto[bounds - bounds[0]]
        found = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), bounds, min_length, min_periods)
        stays = collapsed(found, bounds)
        left = np.concatenate([[0], np.cumsum(stays)])[bounds]
        kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stays)))
        upto = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        cells = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
        return {
            n_words: pa.array(np.diff(bounds)),
            runs: pa.ListArray.from_arrays(pa.array(upto, pa.int32()), cells),
            text_out: pc.binary_join(kept, " "),
        }

    fields = [
        T.StructField(n_words, T.LongType()),
        T.StructField(runs, T.ArrayType(RUN, containsNull=False)),
        T.StructField(text_out, T.StringType()),
    ]
    return batches.map_texts(docs, text_col, fields, work, names, as_bytes=False)


def digests(found: DataFrame, id_col: str = "doc_id", runs: str = "runs", text_out: str = "collapsed") -> DataFrame:
    """Per row of ``find_runs``: number of runs, the run of the greatest exponent, and hashes of runs and text."""
    # Quotients of words below 2**26 differ as doubles where they differ; ties go to the smallest start, then period.
    best = F.array_min(
        F.transform(
            F.col(runs),
            lambda r: F.struct((-(r["length"] / r["period"])).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")),
        )
    )
    listed = F.transform(F.col(runs), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(listed, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        id_col,
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col(text_out), 256).alias("collapsed_sha256"),
    )
