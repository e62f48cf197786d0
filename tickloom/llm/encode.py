"""Vectorised word-wise encoding with the ``tokenizers`` library inside Arrow tasks.

Both tokenizers used here cut a text into words before any merge, so a text's ids are the ids
of its words one after another. Each task therefore encodes the distinct words of a piece of
text once, through the library, remembers the first of them, and builds the documents from their ids. Where a cut at a space or line
break would not be a word boundary of the tokenizer, the whole text goes through the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.common import holds

CACHE_WORDS = 300_000  # distinct words one Python worker remembers; rarer ones are encoded wherever they stand
CHUNK_BYTES = 2 << 20  # text encoded at a time
_MARK = "\x01"  # stands for a line break before a word while a text is cut
_BREAK = r"[\s\x0b\x{85}\p{Z}\x{1c}-\x{1f}]"
# A cut before a space or line break is a word boundary unless white space stands on both sides.
_UNSAFE = rf"{_BREAK}[ \n]({_BREAK}|\z)|\x01"
_PLAIN = r"^\p{L}+$"
_PLAIN_SPACED = r"^ [\p{L}\p{N}][\p{L}\p{N}'-]*$"
_ENDING = r"^(?P<base>.*[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])(?P<end>[.,;:!?]+)$"

_encoders: dict[tuple[str, bool], WordEncoder] = {}
holds("encode", _encoders.clear)


def ragged_take(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates ``flat[starts[r]:starts[r + 1]]`` for all ``r`` of ``rows``; also the new starts."""
    sizes = starts[rows + 1] - starts[rows]
    new = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(sizes, out=new[1:])
    at = np.arange(new[-1], dtype=np.int64)
    at += np.repeat(starts[rows] - new[:-1], sizes)
    return flat[at], new


class _Words:
    """Ids of the words seen first, which are mostly the frequent ones: an Arrow array of words beside their flat ids."""

    def __init__(self, encode):
        self.encode = encode
        self.words = pa.array([], pa.large_string())
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, where each row of them starts, and the row of each (distinct) word. Unknown words are encoded
        and, while there is room, remembered."""
        at = pc.index_in(words, value_set=self.words)
        row = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        if not missing.any():
            return self.flat, self.starts, row
        asked = words.filter(pa.array(missing))
        new, ids, sizes = self.encode(asked)
        row[missing] = len(self.words) + pc.index_in(asked, value_set=new).to_numpy(zero_copy_only=False)
        flat = np.concatenate([self.flat, ids])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        room = CACHE_WORDS - len(self.words)
        if room > 0:
            kept = min(room, len(new))
            self.words = pa.concat_arrays([self.words, new.slice(0, kept)])
            self.starts = starts[: len(self.words) + 1].copy()
            self.flat = flat[: self.starts[-1]].copy()
        return flat, starts, row


class WordEncoder:
    """Encodes Arrow string arrays. ``spaced`` says that a word's ids depend on the space before it."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.words = _Words(self._encode_words)
        bounds = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            bounds[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        self.bounds = bounds  # tokens that begin (spaced) or end a word

    @classmethod
    def of(cls, path: str, spaced: bool) -> WordEncoder:
        """The encoder of this Python worker."""
        if (path, spaced) not in _encoders:
            _encoders.clear()
            _encoders[path, spaced] = cls(path, spaced)
        return _encoders[path, spaced]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _sized(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(texts), 2000):
            some = self._plain(texts[k : k + 2000])
            sizes.append(np.fromiter(map(len, some), np.int64, len(some)))
            ids.append(np.fromiter(chain.from_iterable(some), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words in some order, their flat ids and sizes. Plain words go through the library many
        at a time, told apart again by the tokens that begin or end a word."""
        plain = pc.match_substring_regex(words, _PLAIN_SPACED if self.spaced else _PLAIN)
        many, rest = words.filter(plain), words.filter(pc.invert(plain))
        done, flat, sizes = [], [], []
        for k in range(0, len(many), 2000):
            part = many.slice(k, 2000)
            ids = np.array(self._plain([("" if self.spaced else " ").join(part.to_pylist())])[0], dtype=np.int32)
            edge = np.flatnonzero(self.bounds[ids])
            if len(edge) != len(part):  # a word that the tokenizer cuts further
                rest = pa.concat_arrays([rest, part])
                continue
            ends = np.append(edge[1:], len(ids)) if self.spaced else edge + 1
            done.append(part)
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        ids, n = self._sized(rest.to_pylist())
        return pa.concat_arrays([*done, rest]), np.concatenate([*flat, ids]), np.concatenate([*sizes, n])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), concatenated, and where each text starts (one more at the end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        unsafe = np.zeros(len(texts), dtype=bool)
        if self.spaced:
            unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
            cut = pc.replace_substring(texts, "\n", f" {_MARK}")
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        if unsafe.any():
            cut = pc.if_else(pa.array(unsafe), pa.scalar("", pa.large_string()), cut)
        pieces = pc.split_pattern(cut, " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        values = pieces.flatten() if pieces.offset else pieces.values
        coded = values.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = coded.dictionary
        if self.spaced:
            n = len(known)
            first = np.zeros(len(code), dtype=bool)
            first[bounds[:-1][np.diff(bounds) > 0]] = True
            used_first, used_later = np.zeros(n, bool), np.zeros(n, bool)
            used_first[code[first]] = True
            used_later[code[~first]] = True
            broken = pc.starts_with(known, _MARK)
            later = pc.if_else(broken, pc.replace_substring_regex(known, "^\x01", "\n"), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), known, pa.scalar(" ", pa.large_string())))
            alone = pc.replace_substring_regex(known, "^\x01", "\n")
            place_first, place_later = np.cumsum(used_first) - 1, np.cumsum(used_later) - 1 + used_first.sum()
            code = np.where(first, place_first[code], place_later[code])
            known = pa.concat_arrays([alone.filter(pa.array(used_first)), later.filter(pa.array(used_later))])
        flat, starts = self._of_distinct(known)
        ids, at = ragged_take(flat, starts, code)
        begins = at[bounds]
        if unsafe.any():
            return self._with_whole(texts, unsafe, ids, begins)
        return ids, begins

    def _of_distinct(self, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words; marks at a word's end are encoded apart, so that fewer words are distinct."""
        parts = pc.extract_regex(known, _ENDING)
        ended = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        base = pc.if_else(pa.array(ended), parts.field("base"), known) if ended.any() else known
        coded = base.dictionary_encode()
        flat, starts, row = self.words.lookup(coded.dictionary)
        base_flat, base_starts = ragged_take(flat, starts, row[coded.indices.to_numpy(zero_copy_only=False)])
        if not ended.any():
            return base_flat, base_starts
        ends = parts.field("end").filter(pa.array(ended)).dictionary_encode()
        end_flat, end_sizes = self._sized(ends.dictionary.to_pylist())
        end_starts = np.concatenate([[0], np.cumsum(end_sizes)])
        flat = np.concatenate([base_flat, end_flat])
        # each word is the run of its base and, for some, the run of its ending
        size = len(known)
        runs_from = np.empty(2 * size, np.int64)
        runs_len = np.zeros(2 * size, np.int64)
        runs_from[0::2], runs_len[0::2] = base_starts[:-1], np.diff(base_starts)
        which = ends.indices.to_numpy(zero_copy_only=False)
        runs_from[1::2] = 0
        runs_from[1::2][ended] = len(base_flat) + end_starts[which]
        runs_len[1::2][ended] = np.diff(end_starts)[which]
        new = np.concatenate([[0], np.cumsum(runs_len)])
        at = np.arange(new[-1], dtype=np.int64) + np.repeat(runs_from - new[:-1], runs_len)
        return flat[at], new[0::2]

    def _with_whole(self, texts, unsafe, ids, begins):
        parts, sizes = [], np.diff(begins)
        whole = iter(self._plain(texts.filter(pa.array(unsafe)).to_pylist()))
        for i, odd in enumerate(unsafe):
            x = np.array(next(whole), dtype=np.int32) if odd else ids[begins[i] : begins[i + 1]]
            parts.append(x)
            sizes[i] = len(x)
        return np.concatenate(parts).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each (one document at least)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        limit = (sizes[start - 1] if start else 0) + size
        stop = max(start + 1, int(np.searchsorted(sizes, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
