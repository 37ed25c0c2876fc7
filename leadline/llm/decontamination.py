r"""Benchmark decontamination by a generalised suffix automaton over item words.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. The automaton
holds every substring (of words) of every item. Document words stream through it; at each
word it knows the longest run of words, ending there, that occurs in some item. A run of at
least ``window`` words, or a whole shorter item, marks the run's words as hit.

The items are split into blocks of at most BLOCK_WORDS words, and one automaton per block is
broadcast. One pass over the documents applies up to BLOCKS_AT_ONCE of them; a larger item
table takes several passes, so what is broadcast at once is bounded, however large it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.batches import map_texts
from leadline.llm.columns import free_name, without
from leadline.session import stage

WINDOW = 10
BLOCK_WORDS = 60_000
BLOCKS_AT_ONCE = 4
# Spans that the cleaner cuts: hit runs of at least this many words; and the share of hit
# words above which it drops the whole document.
MAX_SPAN, MAX_COVERAGE = 10, 0.5
# Items shorter than a window that the cleaner cuts have at least this many words; below it, ordinary
# phrases would go ("all day").
LEAST_ITEM = 5

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Bytes of words keep their value with A-Z lower-cased, all others become a space. UTF-8 bytes
# of non-ASCII characters are all above 0x7F.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, tokens in items:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        # For each state: the nearest state up its links (or itself) that holds strings of
        # exactly ``window`` words; -1 if its strings are shorter.
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.at_window = [-1] * len(order)
        for s in order[1:]:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        self.items: dict[int, set] = {}
        short: dict[int, list[tuple[int, object]]] = {}
        self.least = window
        for item, tokens in items:
            s = 0
            for k, t in enumerate(tokens):
                s = self.next[s][t]
                if k + 1 >= window:
                    self.items.setdefault(self.at_window[s], set()).add(item)
            if len(tokens) < window:
                while self.length[self.link[s]] >= len(tokens):
                    s = self.link[s]
                short.setdefault(s, []).append((len(tokens), item))
                self.least = min(self.least, len(tokens))
        # Short items end at a state if they are held by it or by a state up its links.
        self.short: list[list[tuple[int, object]]] = [[] for _ in order]
        for s in order[1:]:
            self.short[s] = short.get(s, []) + self.short[self.link[s]]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """A copy of ``q`` for the strings that end in ``p`` followed by ``t``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:  # this prefix is already there, from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit runs (from, to) of word positions, joined where they touch, and the items met."""
        hits: list[tuple[int, int]] = []
        met: set = set()
        if len(words) < self.least:
            return hits, met
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        # A word that no item has ends every match, so only runs of item words are streamed.
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin >= self.least:
                self._stream(ids[begin:end].tolist(), begin, hits, met)
        return hits, met

    def _stream(self, ids: list[int], begin: int, hits: list, met: set) -> None:
        state = size = 0
        following, link, length, window = self.next, self.link, self.length, self.window
        for k, t in enumerate(ids, begin):
            while state and t not in following[state]:
                state = link[state]
                size = length[state]
            if t in following[state]:
                state = following[state][t]
                size += 1
            found = 0
            if size >= window:
                found = size
                met.update(self.items[self.at_window[state]])
            for n, item in self.short[state]:
                if n <= size:
                    found = max(found, n)
                    met.add(item)
            if found:
                first = k + 1 - found
                while hits and hits[-1][1] >= first:
                    first = min(first, hits.pop()[0])
                hits.append((first, k + 1))


def item_blocks(
    items: DataFrame, item_id: str, item_text: str, block_words: int
) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of at most ``block_words`` words (one longer item is its own block)."""
    block: list[tuple[object, list[bytes]]] = []
    held = 0
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["t"]))
        if held and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    yield block


def _joined(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])


# Of one text: number of words, hit runs apart from each other, ids of the items met.
Found = tuple[int, list[tuple[int, int]], set[str]]


def _as_spans(hits: list[tuple[int, int]]) -> list[dict]:
    return [{"from": a, "to": b} for a, b in hits]


def _through_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str,
    keep: list[str],
    fields: list[T.StructField],
    result: Callable[[list[bytes | None], list[Found]], dict[str, list | pa.Array]],
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``keep`` columns of every row and the columns of ``fields`` that ``result`` makes of the texts and what they hit.

    The last pass over the documents makes the result, in the Python worker that has the text already.
    """
    context = docs.sparkSession.sparkContext
    text, old_spans, old_items = (free_name(docs, c) for c in ("text_again", "spans_before", "items_before"))
    so_far = [T.StructField(old_spans, T.ArrayType(_SPAN)), T.StructField(old_items, T.ArrayType(T.StringType()))]

    def scanner(sent: list, result: Callable) -> Callable:
        def work(texts, part):
            texts = texts.to_pylist()
            earlier = [part.column(c).to_pylist() if c in part.schema.names else repeat([]) for c in (old_spans, old_items)]
            found = []
            for value, old_runs, old_ids in zip(texts, *earlier):
                words = words_of(value)
                hits, ids = [(s["from"], s["to"]) for s in old_runs], set(old_ids)
                for block in sent:
                    more, items_met = block.value.scan(words)
                    hits += more
                    ids.update(map(str, items_met))
                found.append((len(words), _joined(hits), ids))
            return result(texts, found)

        return work

    def noted(texts, found):
        return {old_spans: [_as_spans(hits) for _, hits, _ in found], old_items: [sorted(ids) for _, _, ids in found]}

    source, columns = docs.withColumn(text, F.col(text_col)), keep
    blocks = item_blocks(items, item_id, item_text, block_words)
    group = list(islice(blocks, BLOCKS_AT_ONCE))
    while later := list(islice(blocks, BLOCKS_AT_ONCE)):  # a large item table: what was met is written with the columns
        sent = [context.broadcast(Automaton(block, window)) for block in group]
        source = stage(map_texts(source, text, so_far, scanner(sent, noted), [*columns, text]))
        columns, group = [*keep, old_spans, old_items], later
    sent = [context.broadcast(Automaton(block, window)) for block in group]
    made = map_texts(source, text, fields, scanner(sent, result), columns)
    names = [f.name for f in fields]
    return made.select(*[F.col(f"`{c}`") for c in [*without(keep, names), *names]])


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """``keep`` columns of every row with its word count, hit spans and items met.

    Spans are the hit runs as (from, to) word positions, apart from each other; items are the
    ids, as strings in string order, of items with an occurring window. An item of fewer than
    ``window`` words is one window; null items and items without a word have none. A null or
    empty text has no words. Null ids, repeated rows and empty tables are passed on as they are;
    equal items with different ids are all reported. Columns named like a result are replaced.
    """
    n_words, spans, met = names
    fields = [
        T.StructField(n_words, T.LongType()),
        T.StructField(spans, T.ArrayType(_SPAN)),
        T.StructField(met, T.ArrayType(T.StringType())),
    ]

    def result(texts, found):
        return {
            n_words: [n for n, _, _ in found],
            spans: [_as_spans(hits) for _, hits, _ in found],
            met: [sorted(ids) for _, _, ids in found],
        }

    wanted = without(docs.columns if keep is None else keep, names)
    return _through_items(docs, items, text_col, wanted, fields, result, item_id, item_text, window, block_words)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def _without(text: bytes, hits: list[tuple[int, int]], window: int, max_span: int, least_item: int) -> bytes:
    """The text without the words of long spans, or of whole short items, and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, end in hits:
        n = end - first
        if n >= max_span or least_item <= n < window:  # a span below the window holds whole items only
            out.append(text[at : places[first][0]])
            at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def clean(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    max_span: int = MAX_SPAN,
    max_coverage: float = MAX_COVERAGE,
    least_item: int = LEAST_ITEM,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without benchmark passages: rows with too much of them go, others lose them.

    A row whose hit words are more than ``max_coverage`` of its words goes. From other rows
    every span of at least ``max_span`` words is cut out of the text, from its first to its last
    word, and so is a shorter one of whole items of fewer than ``window`` words, if it has at least
    ``least_item`` words. Still shorter spans stay. Rows without a hit keep their text unchanged, null texts included.
    """
    goes = free_name(docs, "goes")
    fields = [T.StructField(text_col, T.StringType()), T.StructField(goes, T.BooleanType())]

    def result(texts, found):
        gone = [sum(b - a for a, b in hits) > max_coverage * n for n, hits, _ in found]
        cut = [
            None if out else _without(t, hits, window, max_span, least_item) if hits else t
            for t, (_, hits, _), out in zip(texts, found, gone)
        ]
        return {text_col: pa.array(cut, pa.binary()).cast(pa.string()), goes: gone}

    keep = without(docs.columns, [text_col])
    cleaned = _through_items(docs, items, text_col, keep, fields, result, window=window, block_words=block_words)
    return cleaned.where(~F.col(goes)).select(*[F.col(f"`{c}`") for c in docs.columns])
