"""Token ids of whole texts from a fixed public vocabulary, each distinct chunk encoded once.

A text is cut where the tokenizer's own pre-tokenisation always cuts, so encoding the chunks one
by one gives the ids of the whole text.  Chunks already met are looked up by their 64-bit hash in
a table of bounded size that a Python worker keeps from task to task.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from binweave.llm.words import Words, span_hashes, split, text_bytes

CACHED_CHUNKS = 1 << 20  # after this many the table starts anew


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def _may_be_space(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends there may be white space beyond ASCII, by its bytes."""
    one, two, three = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    return (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE1) & (two == 0x9A))
        | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
        | ((three == 0xE3) & (two == 0x80))
    )


class Encoder:
    """Ids of texts under one vocabulary file.

    ``spaced``: the vocabulary keeps white space, and a chunk is a word with the one space before
    it (cut only between a non-space and a single space, where its pattern always cuts);
    otherwise white space is dropped and a chunk is a word.
    """

    def __init__(self, name: str, spaced: bool):
        self.name, self.spaced = name, spaced
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.hashes) + len(hashes) > CACHED_CHUNKS:
            self._clear()
        encoded = [e.ids for e in tokenizer(self.name).encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in encoded for i in ids), np.uint32, int(sizes.sum()))])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.at, self.sizes = np.concatenate([self.at, at])[order], np.concatenate([self.sizes, sizes])[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[place] == hashes

    def _chunks(self, column: pa.Array) -> Words:
        """Chunks as words whose spans and hashes cover what is encoded together."""
        words = split(column)
        if not self.spaced:
            return words
        data, offsets = text_bytes(column)
        starts, ends = words.starts, words.ends
        row = np.repeat(np.arange(len(offsets) - 1), words.counts)
        first = np.ones(len(starts), bool)
        first[1:] = row[1:] != row[:-1]
        # A word joins the chunk before it unless exactly one space stands between the two, and no
        # other white space before that.
        opens = first.copy()
        opens[1:] |= (starts[1:] - ends[:-1] == 1) & (data[starts[1:] - 1] == 0x20) & ~_may_be_space(data, ends[:-1])
        head = np.flatnonzero(opens)
        last = np.append(first[head][1:], True)[: len(head)]
        # The first and the last chunk of a row take the white space around them.
        low = np.where(first[head], offsets[row[head]], starts[head] - 1)
        high = np.where(last, offsets[row[head] + 1], ends[np.append(head[1:], len(starts)) - 1][: len(head)] if len(head) else 0)
        rows = row[head]
        blank = np.flatnonzero((words.counts == 0) & (np.diff(offsets) > 0))
        if len(blank):
            order = np.argsort(np.concatenate([rows, blank]), kind="stable")
            rows = np.concatenate([rows, blank])[order]
            low = np.concatenate([low, offsets[blank]])[order]
            high = np.concatenate([high, offsets[blank + 1]])[order]
        return Words(span_hashes(data, low, high), np.searchsorted(rows, np.arange(len(offsets))), low, high, data)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order (uint32) and the row offsets into them; NULL has none."""
        chunks = self._chunks(column)
        distinct, first, inverse = np.unique(chunks.hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._find(distinct))
        if len(new) and len(self.hashes) + len(new) > CACHED_CHUNKS:
            self._clear()
            new = np.arange(len(distinct))
        if len(new):
            data = chunks.data.tobytes()
            spans = zip(chunks.starts[first[new]].tolist(), chunks.ends[first[new]].tolist(), strict=True)
            self._learn(distinct[new], [data[a:b].decode(errors="replace") for a, b in spans])
        place = np.searchsorted(self.hashes, distinct)[inverse]
        sizes = self.sizes[place]
        stops = np.cumsum(sizes)
        source = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.at[place] - (stops - sizes), sizes)
        return self.flat[source], np.concatenate([[0], stops])[chunks.first]


@cache
def encoder(name: str, spaced: bool) -> Encoder:
    return Encoder(name, spaced)
