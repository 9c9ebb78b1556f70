"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(cut[k] - w.x) with one weight vector for all ordered cuts; x holds
log(1 + count) of the terms, which are words and word beginnings (marked by a star).  The labels carry a flag only, so the grades of the fit are made
from it: 0 for clean rows, 1 to 3 for flagged rows by the thirds of how many terms they hold.
The fit rests on at most ``FIT_ROWS`` labelled rows of either flag, taken by a hash of their id; it is
small and runs on the driver.  Scoring covers every row and every word.

Cases: NULL and empty texts hold no term and get the grade probabilities of w.x = 0; labels of
unknown documents are ignored, repeated labels count once, a document labelled both ways is
flagged; without labels of both flags, or without a telling term, nothing is rejected and
severity is 0; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.text import pieces

#: Bound of the labelled rows of either flag that the fit uses.
FIT_ROWS = 3000
#: Most terms, fewest flagged rows of one, least chi-square and least log odds ratio.
TERMS, LEAST_ROWS, LEAST_CHI2, LEAST_ODDS = 512, 3, 32.0, 2.5
BEGINNINGS = (4, 5, 6, 7, 8)
GRADES = 4
RIDGE = 3e-5
#: A row is rejected from this probability of a grade over 0.
REJECT = 0.3

#: Letters to lower case, ASCII punctuation to spaces.
_FOLD = bytes(b + 32 if 65 <= b < 91 else 32 if b < 128 and not (48 <= b < 58 or 97 <= b < 123) else b for b in range(256))


@dataclass
class Ordinal:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))

    def over(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -50, 50))) * np.isfinite(self.cuts)[None, :]


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_counts(text: bytes) -> Counter:
    """Counts of words and of word beginnings (bytes)."""
    counts = Counter(words(text))
    for word, n in list(counts.items()):
        for size in BEGINNINGS:
            if len(word) >= size:
                counts[word[:size] + b"*"] += n
    return counts


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic and the distinct words with counts of the labelled rows of the fit."""
    flags = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = flags.filter("toxic = 0").orderBy(order, "doc_id").limit(rows).union(flags.filter("toxic = 1").orderBy(order, "doc_id").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, counts = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                held = term_counts(text or b"")
                found.append([t.decode("latin-1") for t in held])  # byte for byte, a beginning may end inside a character
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "counts"]
            )

    # the picked ids are at most 2 * rows, so they may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    texts = texts.dropDuplicates(["text", "toxic"])  # copies are no further evidence
    key = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {key}, toxic int, words array<string>, counts array<long>").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ordinal:
    sample = _sample(docs, labels, rows).persist()
    try:
        totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        bad, good = totals.get(1, 0), totals.get(0, 0)
        if not bad or not good:
            return Ordinal()
        per = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
            F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")
        )
        odds = F.log((F.col("a") + 0.5) * (good - F.col("b") + 0.5) / ((F.col("b") + 0.5) * (bad - F.col("a") + 0.5)))
        held = F.col("a") + F.col("b")
        chi2 = (bad + good) * F.pow(F.col("a") * (good - F.col("b")) - F.col("b") * (bad - F.col("a")), F.lit(2)) / (
            held * F.greatest(bad + good - held, F.lit(0.5)) * bad * good
        )
        chosen = per.filter((F.col("a") >= LEAST_ROWS) & (odds >= LEAST_ODDS) & (chi2 >= LEAST_CHI2)).orderBy(chi2.desc(), "word").limit(TERMS)
        terms = sorted(r["word"] for r in chosen.select("word").collect())
        if not terms:
            return Ordinal()
        wanted = F.array(*map(F.lit, terms))
        pairs = F.arrays_zip(F.col("words").alias("w"), F.col("counts").alias("n"))
        kept = sample.select("toxic", F.filter(pairs, lambda p: F.array_contains(wanted, p["w"])).alias("found")).collect()
    finally:
        sample.unpersist()
    place = {t: i for i, t in enumerate(terms)}
    x, toxic = np.zeros((len(kept), len(terms))), np.array([r["toxic"] for r in kept])
    for i, row in enumerate(kept):
        for p in row["found"]:
            x[i, place[p["w"]]] = np.log1p(p["n"])
    return fit_cumulative(x, graded(x, toxic), terms)


def graded(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grade 0 for clean rows, 1 to 3 by thirds of the number of terms for flagged ones."""
    held = (x > 0).sum(axis=1)
    limits = np.quantile(held[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (held > limits[0]) + (held > limits[1]), 0)


def fit_cumulative(x: np.ndarray, grades: np.ndarray, terms: list[str], steps: int = 800, rate: float = 0.05) -> Ordinal:
    """Penalised likelihood by Adam; cuts are a first cut plus positive gaps, so their order holds."""
    n, d = x.shape
    # v: weights, first cut, logarithms of the gaps
    v = np.concatenate([np.zeros(d), [1.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, steps + 1):
        gaps = np.exp(v[d + 1 :])
        cuts = v[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = cuts[None, :] - (x @ v[:d])[:, None]
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(z, -50, 50))), np.ones((n, 1))], axis=1)
        rows = np.arange(n)
        p = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-12)
        slope = below * (1 - below)
        at_cut = np.zeros((n, GRADES + 1))
        at_cut[rows, grades + 1] = slope[rows, grades + 1]
        at_cut[rows, grades] -= slope[rows, grades]
        dz = -(1 / p)[:, None] * at_cut[:, 1:-1] / n
        by_cut = dz.sum(axis=0)
        grad = np.concatenate([-(x.T @ dz.sum(axis=1)) + RIDGE * v[:d], [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        v -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Ordinal(list(terms), v[:d].copy(), v[d] + np.concatenate([[0.0], np.cumsum(np.exp(v[d + 1 :]))]))


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """All columns of ``docs`` plus severity (expected grade), p_toxic and rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = {t.encode("latin-1"): w for t, w in zip(model.terms, model.weights)}
        whole = {t for t in weight if t[-1:] != b"*"}
        begun = {size: {t[:-1] for t in weight if t[-1:] == b"*" and len(t) == size + 1} for size in BEGINNINGS}
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                if text and weight:
                    distinct = set(words(text))
                    if whole & distinct or any(terms and not terms.isdisjoint({w[:size] for w in distinct}) for size, terms in begun.items()):
                        counts = term_counts(text)
                        scores[i] = sum(weight[t] * np.log1p(counts[t]) for t in sorted(counts.keys() & weight.keys()))
            over = model.over(scores)
            arrays = [*batch.columns, pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(over[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "__severity", "__p_toxic", "__rejected"])

    added = T.StructType.fromDDL("__severity double, __p_toxic double, __rejected boolean")
    out = docs.mapInArrow(run, T.StructType(docs.schema.fields + added.fields))
    own = [c for c in docs.columns if c not in ("severity", "p_toxic", "rejected")]
    return out.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"__{c}").alias(c) for c in ("severity", "p_toxic", "rejected")])
