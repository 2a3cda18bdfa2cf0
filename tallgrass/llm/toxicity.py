"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their beginnings (stems carry inflected forms). Besides the usual loss it
pays for counterfactual twins of labelled sentences: in a sentence that names a group, each identity term in turn is swapped
for another; a labelled document that names none gets one term put into its first sentence. The squared change of the score
is penalised. So all group names weigh alike, a neutral mention adds nothing, and this holds on corpora whose labels hardly
name a group as well as on such that blame one. The terms are a parameter; ``Toxicity`` tells how many twins of each kind
there were.

Labels are learned from at most ``max_rows`` labelled documents (the smallest hashes of doc_id), the one bounded sample
here; every whole text is scored. The driver gets at most ``MOST`` features, for each document of the sample the codes of
those that it has, and the distinct twins (a document has at most one for each term, of chosen codes).

Defined cases: null and empty texts get the score of no evidence; a null id is never held out nor learned from; a doc_id
with several labels counts as toxic if any says so, null labels are ignored; without both classes in the labels the score
is the share of toxic labels (0 without labels); every row is scored, equal rows alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import Memo, arrow, bounded, compact, fresh, quoted, stored, text_or_empty, trimmed

#: Neutral names of groups, by language; a term is swapped for the others of its line.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "africans", "asians", "europeans", "americans", "blacks", "whites", "elders", "teenagers"),
    ("woman", "man", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee", "gay", "lesbian", "african", "asian", "european", "american", "black", "white", "deaf", "blind"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "africains", "asiatiques"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "afrikaner", "asiaten"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "africanos", "asiáticos"),
)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 5, 6)


def features(word: str) -> list[int]:
    """Codes of a lower-case word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n))]


def codes_of(words) -> np.ndarray:
    """Sorted distinct codes of the words."""
    return np.unique(np.array([c for w in set(words) for c in features(w)], np.uint32))


def lines_of(terms) -> tuple[dict[str, str], np.ndarray]:
    """The term that each identity term is swapped for, and the codes of all terms."""
    return {w: line[(i + 1) % len(line)] for line in terms for i, w in enumerate(line)}, codes_of([w for line in terms for w in line])


SWAPPED, PUT = 0, 1  #: kinds of twins


def twins(text: str, partner: dict[str, str], words: list[str] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, codes that a sentence has and its twin has not, the other way round) for each twin of a text (of these words)."""
    low = text.lower()
    names = partner.keys() & set(WORD.findall(low) if words is None else words)
    if not names:
        first = SENTENCE.search(low)
        own = codes_of(WORD.findall(first[0]) if first else [])
        term = sorted(partner)[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(partner)] if partner else None
        return [(PUT, np.zeros(0, np.uint32), np.setdiff1d(codes_of([term]), own))] if term else []
    out = {}  # one of each term: further sentences of a document differ by the same codes, but for its other words
    for sentence in SENTENCE.findall(low):
        inside = set(WORD.findall(sentence))
        for name in sorted(names & inside):
            if name not in out:
                own, twin = codes_of(inside), codes_of(inside - {name} | {partner[name]})
                out[name] = (SWAPPED, np.setdiff1d(own, twin), np.setdiff1d(twin, own))
    return list(out.values())


@dataclass
class Toxicity:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    swapped: int = 0  #: twins by swapped terms that it was trained with
    put: int = 0  #: twins by a term put into a sentence

    def scorer(self):
        weights = self.weights

        def active(chunk: str) -> tuple[int, ...]:
            return tuple({c for w in WORD.findall(chunk.lower()) for c in features(w) if c in weights})

        memo = Memo(active, 200_000)

        def score(text: str) -> float:
            found = {c for chunk in set(text.split()) for c in memo[chunk]}
            z = self.bias + sum(weights[c] for c in sorted(found))
            return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))

        return score


def constant(labels) -> Toxicity | None:
    """The model of labels that hold one class only, or none."""
    if not len(labels) or min(labels) == max(labels):
        p = float(np.mean(labels)) if len(labels) else 0.0
        return Toxicity({}, float(np.clip(np.log((p + 1e-9) / (1 - p + 1e-9)), -40, 40)))
    return None


Twins = list[tuple[np.ndarray, np.ndarray, int]]  #: codes of the sentence only, of the twin only, how often


def optimised(chosen: np.ndarray, docs: list[np.ndarray], labels, pairs: Twins, l2: float, swap: float, steps: int) -> Toxicity:
    """Weights of the sorted codes ``chosen``; docs and pairs hold codes, of which only chosen ones count."""
    y = np.array(labels, np.float64)

    def place(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
        known = chosen[at] == flat
        return at[known], owner[known]

    column, row = place(docs)
    sides = [place([pair[k] for pair in pairs]) for k in (0, 1)]
    d_column, d_row = (np.concatenate([side[k] for side in sides]) for k in (0, 1))
    d_value = np.repeat([1.0, -1.0], [len(side[0]) for side in sides])
    often = np.array([pair[2] for pair in pairs], np.float64)
    often /= max(1.0, often.sum())

    n, m, share = len(docs), len(chosen), y.mean()
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    first, second, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[column], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        gradient = np.bincount(column, weights=error[row], minlength=m) + l2 * w
        if len(d_row):
            change = often * np.bincount(d_row, weights=d_value * w[d_column], minlength=len(pairs))
            gradient += swap * 2 * np.bincount(d_column, weights=d_value * change[d_row], minlength=m)
        slope = error.sum()
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        b1, b2 = 0.9 * b1 + 0.1 * slope, 0.999 * b2 + 0.001 * slope**2
        up, down = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.1 * (first / up) / (np.sqrt(second / down) + 1e-8)
        b -= 0.1 * (b1 / up) / (np.sqrt(b2 / down) + 1e-8)
    return Toxicity({int(c): float(v) for c, v in zip(chosen, w, strict=True) if abs(v) > 1e-3}, float(b))


LEAST, MOST, LIFT, L2, SWAP, STEPS = 4, 30_000, 2.5, 1e-4, 20.0, 250


def train(texts: list[str], labels: list[int], terms=IDENTITY_TERMS, swap: float = SWAP) -> Toxicity:
    """Fit the classifier to a few texts on the driver; ``swap`` weighs the counterfactual penalty."""
    if found := constant(labels):
        return found
    partner, forced = lines_of(terms)
    docs = [codes_of(WORD.findall(t.lower())) for t in texts]
    codes, seen = np.unique(np.concatenate(docs), return_counts=True)
    mine, toxic = np.unique(np.concatenate([d for d, y in zip(docs, labels, strict=True) if y]), return_counts=True)
    toxic = np.where(np.isin(codes, mine), toxic[np.minimum(np.searchsorted(mine, codes), len(mine) - 1)], 0)
    share = np.mean(labels)
    lift = np.abs(toxic - seen * share) / np.sqrt(seen * share * (1 - share))
    lift[seen < LEAST] = 0
    best = np.argsort(-lift, kind="stable")[:MOST]
    chosen = np.union1d(codes[best[lift[best] > LIFT]], forced)
    pairs = [p for t in texts for p in twins(t, partner)]
    model = optimised(chosen, docs, labels, [(a, b, 1) for _, a, b in pairs], L2, swap, STEPS)
    return told(model, [kind for kind, _, _ in pairs], [1] * len(pairs))


def told(model: Toxicity, kinds: list[int], counts: list[int]) -> Toxicity:
    """The model with the number of its twins."""
    model.swapped, model.put = (sum(n for k, n in zip(kinds, counts, strict=True) if k == kind) for kind in (SWAPPED, PUT))
    return model


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, terms=IDENTITY_TERMS, swap: float = SWAP) -> Toxicity:
    """Learn from at most ``max_rows`` labelled documents (of rows that share an id, the smallest text).

    Features are counted and chosen by Spark; the driver gets at most ``MOST`` features and, for each document of the sample,
    the codes of those that it has.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    rows = stored(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return constant([1] * positive + [0] * (n - positive))
    partner, forced = lines_of(terms)

    def count(batches):
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                codes = [codes_of(WORD.findall(t.lower())) for t in part.column(0).to_pylist()]
                flat = np.concatenate([*codes, np.zeros(0, np.uint32)])
                marks = np.repeat(np.array(part.column(1).to_pylist(), np.int64), [len(c) for c in codes])
                found, at = np.unique(flat, return_inverse=True)
                n, t = np.bincount(at, minlength=len(found)), np.bincount(at, weights=marks, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n), pa.array(t.astype(np.int64))], ["code", "n", "t"])

    counts = arrow(rows.select("text", "toxic"), count, "code long, n long, t long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= LEAST)
    share = positive / n
    lift = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.select("code", lift.alias("lift")).where(F.col("lift") > LIFT).orderBy(F.desc("lift"), "code").limit(MOST).select("code").toArrow().column(0).to_numpy()
    chosen = np.union1d(best.astype(np.uint32), forced)

    def sparse(batches):
        """The chosen codes of each document, and those of its twins."""

        def known(codes):
            return codes[chosen[np.minimum(np.searchsorted(chosen, codes), len(chosen) - 1)] == codes]

        def row(kind, toxic, own, twin=()):
            for values, x in zip(out, (kind, toxic, np.asarray(own, np.uint32).tobytes(), np.asarray(twin, np.uint32).tobytes()), strict=True):
                values.append(x)

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                row(-1, toxic, known(codes_of(words)))
                for kind, own, twin in twins(text, partner, words):
                    row(kind, None, known(own), known(twin))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["kind", "toxic", "own", "twin"])

    found = stored(arrow(rows.select("text", "toxic"), sparse, "kind int, toxic int, own binary, twin binary"), "codes")
    sentences = found.where("kind >= 0").groupBy("kind", "own", "twin").agg(F.count("*").alias("n")).toArrow().to_pydict()
    marked = found.where("kind < 0").select("toxic", "own").toArrow().to_pydict()
    codes = lambda name, of: [np.frombuffer(x, np.uint32) for x in of[name]]
    pairs = list(zip(codes("own", sentences), codes("twin", sentences), sentences["n"], strict=True))
    return told(optimised(chosen, codes("own", marked), marked["toxic"], pairs, L2, swap, STEPS), sentences["kind"], sentences["n"])


def scoring(model: Toxicity):
    """The model as a function of a text column. Only the text goes to Python; the other columns stay in the JVM."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = model.scorer()
        try:
            for texts in batches:
                yield pa.array([one(t) for t in texts.to_pylist()], pa.float64())
        finally:
            del one
            trimmed()

    return score


def score_documents(docs: DataFrame, model: Toxicity, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The score of every whole text, called ``name``, beside the columns ``keep`` (by default doc_id)."""
    bounded(docs.sparkSession)
    return docs.select(*quoted(keep or ["doc_id"]), scoring(model)(text_or_empty()).alias(name))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns."""
    name = fresh(docs, "__score")
    return score_documents(compact(docs), fit(docs, labels), docs.columns, name).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
