"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a doubly linked list; a heap holds the adjacent pairs that the vocabulary can merge, best score
first, leftmost first among equals. The best pair that is still adjacent is merged until the heap is empty. The count is
the initial symbols less the merges (symbols outside the vocabulary count their bytes, the file's byte fallback); no id is
made.

Texts are normalised by the file's own rules and cut where no piece of the vocabulary can cross, so that each distinct
word is merged once for each worker.

Defined cases: null text is empty (0 tokens); every row counts by itself; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import Memo, arrow, text_or_empty

SPACE = "▁"
_LOADED: dict = {}


class PieceCounter:
    """Counts the tokens that a SentencePiece BPE file gives."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = sentencepiece.SentencePieceNormalizer(model_file=path)
        size = range(sp.get_piece_size())
        special = {i for i in size if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in size if i not in special}
        self.fallback = any(sp.is_byte(i) for i in size)
        if not self.fallback or any(sp.is_unused(i) for i in size):
            raise ValueError("only files with byte fallback and without unused pieces are supported")
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in self.score)
        #: With no piece that holds a space after another character, a word with the spaces before it stands alone.
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not crossing else None
        joined = {c for piece in self.score if len(piece) > 1 for c in piece}
        #: Characters of no longer piece never merge: cut the word around them.
        self.alone = lambda c: c not in joined
        self.memo = Memo(self.merge)
        #: Plain texts need no normaliser: it only writes the spaces and the first space as such.
        probe = "a b\nc  d,é "
        plain = [10, *range(33, 127), *range(0xC0, 0x180)]
        self.plain = self.normaliser.normalize(probe) == SPACE + probe.replace(" ", SPACE) and all(self.normaliser.normalize(chr(c)) == SPACE + chr(c) for c in plain)

    PLAIN = re.compile(r"[\n -~À-ſ]*\Z")

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        got = SPACE + text.replace(" ", SPACE) if self.plain and self.PLAIN.match(text) else self.normaliser.normalize(text)
        if self.words is None:
            return self.merge(got)
        if SPACE + SPACE not in got and got[0] == SPACE and got[-1] != SPACE:
            return sum(map(self.memo.__getitem__, got[1:].split(SPACE)))
        # Memo keys are words without their one leading space; "" never arises there
        return sum(self.memo[w[1:]] if w[0] == SPACE and len(w) > 1 and w[1] != SPACE else self.symbols(w) for w in self.words.findall(got))

    def merge(self, word: str) -> int:
        return self.symbols(SPACE + word)

    def symbols(self, word: str) -> int:
        """Initial symbols less merges, of one word with its spaces."""
        count, run = 0, []
        for c in word:
            if self.alone(c):
                count += self.heap(run) + self.cost(c)
                run = []
            else:
                run.append(c)
        return count + self.heap(run)

    def cost(self, symbol: str) -> int:
        return 1 if symbol in self.score else len(symbol.encode("utf-8", "surrogatepass"))

    def heap(self, parts: list[str]) -> int:
        n = len(parts)
        if n < 2:
            return self.cost(parts[0]) if parts else 0
        score, parts = self.score, list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-s, i, pair) for i in range(n - 1) if (s := score.get(pair := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(agenda)
        merges = 0
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j], k = pair, "", after[j]
            after[i] = k
            merges += 1
            if k < n:
                before[k] = i
                if (s := score.get(new := pair + parts[k])) is not None:
                    heapq.heappush(agenda, (-s, i, new))
            if (h := before[i]) >= 0 and (s := score.get(new := parts[h] + pair)) is not None:
                heapq.heappush(agenda, (-s, h, new))
        extra = sum(self.cost(p) - 1 for p in parts if p and p not in score)
        return n - merges + extra


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def count(batches):
        if model not in _LOADED:
            _LOADED[model] = PieceCounter(model)
        counter = _LOADED[model]
        for batch in batches:
            texts = batch.column(1)
            tokens = [counter(t) for t in texts.to_pylist()]
            sizes = pa.compute.binary_length(texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow(rows, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
