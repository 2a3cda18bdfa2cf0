"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallgrass.llm.common import PolyHash, mix64

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BLOCK = 1 << 20


class Shingler:
    """Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case.

    A document with fewer than ``words`` words has its whole sequence as its one shingle, one without words has none.
    """

    def __init__(self, words: int, seed: int = 11):
        self.words, self.poly = words, PolyHash(seed)
        self.weights = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def word_hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of ``data``, and for each document (by its start) the number of words before it."""
        inside = np.concatenate(([False], ~SEPARATOR[data], [False]))
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True  # a document's start also ends a word
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        prefix = self.poly.prefix(LOWER[data])
        return self.poly.spans(prefix, begin, end), np.searchsorted(begin, starts)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of documents ``data[offsets[i]:offsets[i+1]]``, concatenated and sorted in each; their offsets."""
        n = len(offsets) - 1
        hashes, before = self.word_hashes(data, offsets[:-1])
        before = np.append(before, len(hashes))
        counts = np.diff(before)
        with np.errstate(over="ignore"):
            size = max(0, len(hashes) - self.words + 1)
            raw = np.zeros(size, np.uint64)
            for i, weight in enumerate(self.weights):
                raw += hashes[i : i + size] * weight
            raw = mix64(raw + np.uint64(self.words))
            parts, sizes = [], np.zeros(n + 1, np.int64)
            for d in range(n):
                a, count = before[d], counts[d]
                if count >= self.words:
                    own = raw[a : a + count - self.words + 1]
                    own.sort()
                    own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                elif count:
                    own = mix64(np.array([(hashes[a : a + count] * self.weights[:count]).sum() + np.uint64(count)], np.uint64))
                else:
                    continue
                parts.append(own)
                sizes[d + 1] = len(own)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, last + 1, shingles, their offsets) for blocks of a column of texts; a longer text is a block."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            own = offsets[at : to + 1]
            yield at, to, *self.sets(data[own[0] : own[-1]], own - own[0])
            at = to
