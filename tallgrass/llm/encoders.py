"""Chunk-memoised encoders that give exactly the ids of a ``tokenizers`` file.

Texts are cut where no token can cross, each distinct chunk is encoded once by the library, and a text's ids are
the concatenation. Texts for which the cuts are not proven go to the library whole. A new chunk of letters, with
punctuation after it or not, is made of two pre-tokens that go straight to the library's merge model.

``SpaceLedEncoder.many`` does so for a column of texts: Arrow cuts the words, tells them apart and parts them from the punctuation
after them, only what is distinct in the column is looked up, and the ids are put together by index arithmetic.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallgrass.llm.common import Memo

#: Letters that the files' normalisers leave alone but for the case, and that are letters to any library.
PLAIN = re.compile(r"([A-Za-zß-öø-ÿÀ-ÖØ-Þ]+)([.,;:!?]*)\Z")
LETTERS = "".join(c for c in map(chr, range(0x100)) if PLAIN.match(c))

_LOADED: dict = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class _Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, _byte_letters()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.after = Memo(self.encode)  # punctuation
        self.memo = Memo(self.chunk, 500_000)

    def encode(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def merge(self, word: str) -> bytes:
        """Ids of one pre-token."""
        letters = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()


def _distinct(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings of a column, and the place among them of each row's."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def _flat(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one piece after the other, and how many each has."""
    return np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4


def _chosen(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_flat`` of the pieces that ``codes`` names, in that order."""
    starts, chosen = np.cumsum(sizes) - sizes, sizes[codes]
    at = np.repeat(starts[codes] - (np.cumsum(chosen) - chosen), chosen)
    at += np.arange(len(at))
    return ids[at], chosen


class SpaceLedEncoder(_Encoder):
    """For byte-level files whose pre-tokens take one leading space (`` ?letters``, `` ?digits``, `` ?others``, spaces).

    A cut before a lone space is safe; runs of spaces and line ends split as the file's pattern does. Texts with any
    other white space, or with an added token's string, are encoded whole.
    """

    ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
    CHUNKS = re.compile(r"[ \n]+(?![^ \n])| ?[^ \n]+|[ \n]")
    RUNS = ("  ", " \n", "\n ", "\n\n")

    def __init__(self, path: str):
        super().__init__(path)
        self.odd = [*self.ODD, *self.added]
        self.runs = Memo(self.encode, 400_000)
        self.line_end = self.encode("\n")
        self.units = Memo(self.unit, 700_000)
        self.across = any(c in t for t in self.added for c in " \n")

    def unit(self, key: str) -> bytes:
        """``chunk``; nothing for blanks and for strings whose texts are encoded whole."""
        if key.isascii() and key.isalpha():
            return array("I", [t.id for t in self.model.tokenize(self.letters[32] + key)]).tobytes()
        if key[:1] == "\n" and key[1:].isascii() and key[1:].isalpha():
            return self.line_end + self.merge(key[1:])
        return b"" if key in ("", "\n") or any(c in key for c in self.odd) else self.chunk(key)

    def head(self, word: str) -> bytes:
        """``unit`` for the first word of a text: no space stands before it."""
        return b"" if not word or any(c in word for c in self.odd) else self.runs[word]

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a column without nulls, as ``__call__`` gives them."""
        if not len(texts) or self.across:
            return [self(t) for t in texts.to_pylist()]
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        edges, coded = cut.offsets.to_numpy() - cut.offsets[0].as_py(), cut.flatten().dictionary_encode()
        words, codes, starts = coded.dictionary, coded.indices.to_numpy().copy(), edges[:-1]
        firsts, first = _distinct(words.take(pa.array(codes[starts])))
        codes[starts] = len(words) + first
        words = pc.if_else(pa.array(np.bincount(codes, minlength=len(words))[: len(words)] > 0), words, "")

        # a distinct word is letters and the punctuation after them, or one unit
        stems, ends = pc.utf8_rtrim(words, string.punctuation), pc.utf8_ltrim(words, LETTERS + "\n")
        whole, stem, end = (pc.binary_length(x).to_numpy() for x in (words, stems, ends))
        parted = pa.array((stem + end == whole) & (stem > 0) & ~pc.equal(stems, "\n").to_numpy(zero_copy_only=False))
        (units, unit), (marks, mark) = _distinct(pc.if_else(parted, stems, words)), _distinct(pc.if_else(parted, ends, ""))
        ids, sizes = _flat([*map(self.units.__getitem__, units), *map(self.after.__getitem__, marks)])
        ids, sizes = _chosen(ids, sizes, np.column_stack((unit, mark + len(units))).ravel())

        more, their = _flat(list(map(self.head, firsts)))
        ids, sizes = np.concatenate((ids, more)), np.concatenate((sizes.reshape(-1, 2).sum(1), their))
        alone = np.logical_or.reduceat(sizes[codes] == 0, starts).tolist()
        ids, sizes = _chosen(ids, sizes, codes)
        at = np.concatenate(([0], np.cumsum(sizes)))[edges].tolist()
        return [self(texts[i].as_py()) if alone[i] else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]

    def chunk(self, key: str) -> bytes:
        """A word after a space, or a line end and the word after it."""
        plain = PLAIN.match(key)
        if plain:
            return self.merge(" " + plain[1]) + (self.after[plain[2]] if plain[2] else b"")
        return self.line_end + self.runs[key[1:]] if key[0] == "\n" else self.encode(" " + key)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(c in text for c in self.odd):
            return self.encode(text)
        if any(c in text for c in self.RUNS) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(self.runs.__getitem__, self.CHUNKS.findall(text)))
        first, *words = text.replace("\n", " \n").split(" ")
        return self.runs[first] + b"".join(map(self.memo.__getitem__, words))


class SpaceFreeEncoder(_Encoder):
    """For files that drop white space, ignore case and cut at spaces: each run of other characters is encoded by itself."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special = [t for t in self.added if re.search(r"\s", t)]

    def chunk(self, key: str) -> bytes:
        plain = PLAIN.match(key)
        if plain:
            return self.merge(plain[1].lower()) + (self.after[plain[2]] if plain[2] else b"")
        return self.encode(key)

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.encode(text)
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(kind: type, path: str):
    """One encoder for each file and worker process; its memo lives as long as the worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
