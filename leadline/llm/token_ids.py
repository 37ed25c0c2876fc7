"""Token ids of many texts with a tokenizer file of the tokenizers library.

Natural text repeats its words, and the library is slow on each. A text is therefore cut at
spaces where the cut cannot change the ids, and its pieces again between a letter and a mark
after it ("end," and "end." share a word). Every different word is encoded once, many words in
one string, and the ids of a text are those of its words put together. Words and their ids stay
in a bounded table that a Python worker keeps between tasks.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words kept between calls; about 40 bytes each.
MAX_WORDS = 500_000
# White space before a space: a run that a pre-tokenizer may split inside.
_SPACE_RUN = r"[\s\x0b\x1c-\x1f\x{85}\pZ] "

# Letters that normalisation leaves as they are and whose lower case is one letter (not so U+0130).
_LETTERS = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f"
# Pieces that may be cut and folded: no space, and nothing that joins with the letter before it.
_PLAIN = f"^[!-~{_LETTERS}]*$"
_WORD_END = rf"([{_LETTERS}])([!-/:-@\[-`{{-~])"
_WORD = f"^ ?[{_LETTERS}]+$"
# Words that the library gets in one string.
_JOINED = 256
# The pattern of a pre-tokenizer under which a letter and a mark after it never share a match.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode_strings(tokenizer, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum()))
    return flat, lengths


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[k] .. starts[k] + lengths[k] - 1 for each k, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            rules = json.load(f)
        before, suffix = rules["pre_tokenizer"], rules["model"].get("end_of_word_suffix")
        if before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not rules["normalizer"]:
            # A space belongs to the word after it; a cut before a lone space is always one of the pattern's.
            self.space, self.fine, self.fold = True, True, False
        elif before["type"] == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed":
            # White space is dropped, so any space is a cut.
            self.space = False
            steps = (rules["normalizer"] or {}).get("normalizers", [])
            known = {"Regex": _SPLIT} == before["pretokenizers"][0].get("pattern") and {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"}
            self.fine = known and all(x.get("pattern") == {"Regex": r"\s+"} for x in steps if x["type"] == "Replace")
            self.fold = self.fine and any(x["type"] == "Lowercase" for x in steps)
        else:
            raise ValueError("no rule for where this tokenizer may be cut")
        # Text that the library takes out before all else.
        self.added = [x["content"] for x in rules["added_tokens"]]
        # Ids that only the first, or the last, id of a word can be.
        edge = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, k in rules["model"]["vocab"].items():
            edge[k] = token.startswith("Ġ") if self.space else bool(suffix) and token.endswith(suffix)
        self.edge = edge
        self.words = pa.array([], pa.string())
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, many in one string."""
        mark = "" if self.space else " "
        flat, _ = _encode_strings(self.tokenizer, [mark.join(words[k : k + _JOINED]) for k in range(0, len(words), _JOINED)])
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(words):
            return _encode_strings(self.tokenizer, words)
        return flat, np.diff(np.append(edges, len(flat)) if self.space else np.append(-1, edges))

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids and number of ids of new words, and the words in that order."""
        letters = pc.match_substring_regex(words, _WORD) if self.fine else pa.array(np.zeros(len(words), bool))
        plain, other = words.filter(letters), words.filter(pc.invert(letters))
        flat, lengths = self._joined(plain.to_pylist())
        more, sizes = _encode_strings(self.tokenizer, other.to_pylist())
        return np.concatenate([flat, more]), np.concatenate([lengths, sizes]), pa.concat_arrays([plain, other])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Rows of the table for different words; new ones are encoded and added."""
        known = pc.index_in(words, value_set=self.words)
        missing = words.filter(pc.is_null(known))
        rows = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(missing):
            flat, lengths, missing = self._encoded(missing)
            at = pc.index_in(words, value_set=missing).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.where(rows < 0, len(self.words) + at, rows)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.words = pa.concat_arrays([self.words, missing])
        return rows

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces, where each begins, and the number of ids of each."""
        cut = pieces
        if self.fine:
            plain = pc.match_substring_regex(pieces, _PLAIN)
            for content in self.added:
                plain = pc.and_not(plain, pc.match_substring(pieces, content, ignore_case=True))
            cut = pc.replace_substring_regex(pieces, _WORD_END, r"\1 \2")
            cut = pc.if_else(plain, pc.ascii_lower(cut) if self.fold else cut, pieces)
        lists = pc.split_pattern(cut, " ")
        words = lists.flatten()
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        first -= first[0]
        if self.space:
            begins = np.zeros(len(words), np.int8)
            begins[first] = 1
            words = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(begins)), words, "")
        coded = words.dictionary_encode()
        rows = self._places(coded.dictionary)
        codes = coded.indices.to_numpy()
        starts, sizes = self.starts[rows][codes], self.lengths[rows][codes]
        flat, lengths = self.flat[spread(starts, sizes)], np.add.reduceat(sizes, first)
        self._forget()
        return flat, np.cumsum(lengths) - lengths, lengths

    def _forget(self) -> None:
        """Keep the later half of a full table."""
        if len(self.words) > MAX_WORDS:
            half = len(self.words) // 2
            at = self.starts[half]
            self.words = pa.concat_arrays([self.words.slice(half)])
            self.flat, self.starts, self.lengths = self.flat[at:].copy(), self.starts[half:] - at, self.lengths[half:].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text. Null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.cast(pa.string()).fill_null("")
        cut = texts if self.space else pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(cut, " ")
        parts = lists.flatten()
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        first -= first[0]
        coded = parts.dictionary_encode()
        flat, begins, sizes = self._pieces(coded.dictionary)
        codes = coded.indices.to_numpy()
        starts, lengths = begins[codes], sizes[codes]
        if self.space:
            # The first piece has no space before it. A text with a space after white space is encoded whole.
            whole = pc.match_substring_regex(texts, _SPACE_RUN).to_numpy(zero_copy_only=False)
            ends = np.append(first[1:], len(parts))
            for k in np.flatnonzero(whole):
                lengths[first[k] : ends[k]] = 0
            heads = parts.take(pa.array(first)).to_pylist()
            for k in np.flatnonzero(whole):
                heads[k] = texts[int(k)].as_py()
            more, heads_sizes = _encode_strings(self.tokenizer, heads)
            starts[first] = len(flat) + np.cumsum(heads_sizes) - heads_sizes
            lengths[first] = heads_sizes
            flat = np.concatenate([flat, more])
        ids = flat[spread(starts, lengths)]
        return ids, np.add.reduceat(lengths, first)
