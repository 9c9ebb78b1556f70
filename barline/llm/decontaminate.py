"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of 16-bit word codes, stored once.
2. Passages of ``PASSAGE`` words over hashed terms, weighted by TF-IDF, form a matrix A.  A distributed
   randomised SVD finds its leading term directions: tasks add up A'(A R) for a random R, the driver
   orthonormalises that to Q, tasks add up (A Q)'(A Q), and its eigenvectors turn Q.  All matrices that travel
   have the fixed size terms x rank; all passages of all documents count.
3. Every passage (half overlapping) and every benchmark item is projected; passages whose cosine with an item
   reaches ``COSINE`` are candidates.  The items are a stated query set, compared in blocks.  For items of at
   most ``SHORT`` words every smallest passage with one of their answer words is a candidate, whatever its cosine.
4. Candidates that hold enough of the item's words are checked by longest common subsequence against the item,
   within the passage and its surroundings, and by its answer words, the rarest third: both must be found.

Cases: NULL, empty and blank texts are clean; an empty item matches nothing; an empty benchmark leaves all
rows clean; equal items are reported by the smallest id; repeated rows are judged alike; documents without
id are judged too; other columns are ignored by ``judged`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.stage import spare_memory, written
from barline.llm.text import pieces, words_of

PASSAGE = 40
BLOCK = 10
TERMS = 1 << 15
RANK, EXTRA = 48, 8
COSINE = 0.3
#: Items of at most so many words are not searched by cosine: their vectors drown in a passage's.
SHORT = 20
#: Least share of an item's words in the passage and its surroundings, of the item in the common subsequence, and of its answer words.
OVERLAP, SUBSEQUENCE, ANSWER = 0.6, 0.65, 0.6
#: Rows of matrices that travel in one piece, passages searched at once, and passages added up at once; all are fitted on.
SLICE, AT_ONCE, FIT_PASSAGES = 512, 4000, 4000


def coded(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and codes (16-bit word codes as bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = words_of(batch.column(1), bare=True)
            codes = w.fingerprints(lower=True).astype(np.uint16)
            data = [codes[a:b].tobytes() for a, b in zip(w.offsets[:-1], w.offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [key, "codes"])
        spare_memory()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, codes binary")


def joined_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows one behind the other, and where each row begins."""
    data = [b or b"" for b in column.to_pylist()]
    return np.frombuffer(b"".join(data), dtype=np.uint16), np.concatenate([[0], np.cumsum([len(b) // 2 for b in data])]).astype(np.int64)


def cuts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``size`` words that never cross a row, and the row of each."""
    per = -(-np.diff(offsets) // size)
    row = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return offsets[row] + nth * size, row


def _summed(coded_docs: DataFrame, shape: tuple[int, int], work: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all tasks of a matrix that ``work(codes, starts, total)`` adds to.

    Each task sends its matrix in slices of rows; slices are added up as they stream in.
    """
    kind, at_once = "piece int, data binary", FIT_PASSAGES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.float64)
        for batch in batches:
            for part in _parts(batch):
                codes, offsets = joined_codes(part.column(0))
                starts, _ = cuts(offsets, PASSAGE)
                for a in range(0, len(starts), at_once):
                    own = starts[a : a + at_once]
                    end = starts[a + at_once] if a + at_once < len(starts) else len(codes)
                    work(codes[own[0] : end], own - own[0], total)
        yield _sliced(total)
        del total
        spare_memory()

    def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return pieces(iter([batch]), "codes", 2 << 20)

    def _sliced(total: np.ndarray) -> pa.RecordBatch:
        n = range(0, shape[0], SLICE)
        return pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in n], pa.int32()), pa.array([total[i : i + SLICE].tobytes() for i in n], pa.binary())], ["piece", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data, dtype=np.float64)
                held[piece] = held[piece] + values if piece in held else values
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "data"])

    rows = coded_docs.select("codes").mapInArrow(partial, kind).repartition(F.col("piece")).mapInArrow(added, kind).collect()
    out = np.zeros(shape, dtype=np.float64)
    for row in rows:
        values = np.frombuffer(row["data"], dtype=np.float64).reshape(-1, shape[1])
        out[row["piece"] * SLICE : row["piece"] * SLICE + len(values)] += values
    return out


def _terms(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint16(TERMS - 1)).astype(np.int64)


def passage_frequencies(coded_docs: DataFrame) -> tuple[np.ndarray, int]:
    """Expected number of passages with each term, from its occurrences, and the number of passages."""

    def work(codes: np.ndarray, starts: np.ndarray, total: np.ndarray) -> None:
        total[:TERMS, 0] += np.bincount(_terms(codes), minlength=TERMS)
        total[TERMS, 0] += len(starts)

    total = _summed(coded_docs, (TERMS + SLICE, 1), work)[:, 0]
    n = int(total[TERMS])
    return n * (1 - np.exp(-total[:TERMS] / max(n, 1))), n


@dataclass
class Latent:
    idf: np.ndarray
    directions: np.ndarray  # terms x rank, TF-IDF weights included, and a row of zeros


def _runs(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Terms of each run as a row of ``size``; the number TERMS fills runs that are shorter."""
    at = starts[:, None] + np.arange(size)
    terms = np.take(_terms(codes), at, mode="clip")
    terms[at >= np.append(starts[1:], len(codes))[:, None]] = TERMS
    return terms


def _projected(runs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each run."""
    out = np.empty((len(runs), table.shape[1]), dtype=np.float32)
    ones = np.ones((1, runs.shape[1]), dtype=np.float32)
    for a in range(0, len(runs), 500):
        out[a : a + 500] = (ones @ np.take(table, runs[a : a + 500], axis=0, mode="clip"))[:, 0]
    return out


def _with_zeros(table: np.ndarray) -> np.ndarray:
    return np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def fitted(coded_docs: DataFrame, rank: int = RANK, extra: int = EXTRA, seed: int = 7) -> Latent:
    """Leading term directions of the TF-IDF matrix of all passages."""
    held, n = passage_frequencies(coded_docs)
    idf = (np.log((1 + n) / (1 + held))).astype(np.float32)
    width = rank + extra
    start = np.random.default_rng(seed).standard_normal((TERMS, width))
    weighed, squares = _with_zeros(start * idf[:, None]), np.append(np.square(idf), np.float32(0))

    def power(codes: np.ndarray, starts: np.ndarray, total: np.ndarray) -> None:
        runs = _runs(codes, starts, PASSAGE)
        y = _projected(runs, weighed) / np.maximum(np.take(squares, runs).sum(axis=1), 1e-6)[:, None]
        passage = np.repeat(np.arange(len(runs)), PASSAGE)
        terms = runs.ravel().astype(np.uint16)  # the number TERMS still fits
        order = np.argsort(terms, kind="stable")
        order = order[: np.searchsorted(terms[order], TERMS)]
        ordered = terms[order].astype(np.int64)
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        total[ordered[first]] += np.add.reduceat(np.take(y, passage[order], axis=0, mode="clip"), first, axis=0)

    y = _summed(coded_docs, (TERMS, width), power) * idf[:, None]
    # Nystroem with a small shift, so that the core is positive definite
    shift = 1e-7 * max(float(np.linalg.norm(y)), 1e-6)
    y += shift * start
    values, vectors = np.linalg.eigh((start.T @ y + y.T @ start) / 2)
    half = (vectors / np.sqrt(np.maximum(values, 1e-9 * max(float(values.max()), 1e-9)))) @ vectors.T
    directions, singular, _ = np.linalg.svd(y @ half, full_matrices=False)
    squared = np.maximum(np.square(singular) - shift, 1e-6 * max(float(singular[0]) ** 2, 1e-6))
    lead = directions[:, 1 : rank + 1] / np.sqrt(squared[1 : rank + 1])
    latent = Latent(idf, _with_zeros(lead * idf[:, None]))
    # the sums and their factors are freed here, on the driver too
    del start, weighed, y, values, vectors, half, directions, lead
    spare_memory()
    return latent


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit by bit over the item."""
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, row = (1 << len(item)) - 1, 0
    for c in words:
        match = at.get(c)
        if match:
            x = row | match
            row = x & ~(x - (row << 1 | 1)) & full
    return row.bit_count()


@dataclass
class Items:
    ids: list
    codes: list[np.ndarray]
    answers: list[set[int]]
    vectors: np.ndarray


def prepared(benchmark: DataFrame, latent: Latent) -> Items:
    """The benchmark as query set on the driver: it is a stated list, bounded by the benchmark itself."""
    rows = sorted((r for r in coded(benchmark, "item_id").collect() if r["codes"]), key=lambda r: (r["item_id"] is None, r["item_id"]))
    codes = [np.frombuffer(r["codes"], dtype=np.uint16) for r in rows]
    answers, vectors = [], np.zeros((len(rows), latent.directions.shape[1]), dtype=np.float32)
    for i, c in enumerate(codes):
        own = np.unique(c)
        rare = own[np.argsort(-latent.idf[_terms(own)], kind="stable")]
        answers.append(set(rare[: max(1, len(rare) // 3)].tolist()))
        vectors[i] = _unit(_projected(_runs(c, np.array([0]), len(c)), latent.directions))[0]
    return Items([r["item_id"] for r in rows], codes, answers, vectors)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]


def searched(coded_docs: DataFrame, latent: Latent, items: Items, key: str = "doc_id") -> DataFrame:
    """``key``, contaminated, item_id, lcs_share and cosine of the best checked item of every document."""
    sizes = np.array([len(c) for c in items.codes], dtype=np.int64)
    lists = [c.tolist() for c in items.codes]
    # answer words as code -> items: a flag, the place of the first item and the number of items
    pairs = np.array(sorted((code, i) for i, answer in enumerate(items.answers) for code in answer), dtype=np.int64).reshape(-1, 2)
    n_of_code = np.bincount(pairs[:, 0], minlength=1 << 16)
    of_code, of_item, asked = np.cumsum(n_of_code) - n_of_code, pairs[:, 1], n_of_code > 0

    def candidates(codes: np.ndarray, offsets: np.ndarray, flat: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, end, cosine) of passages near an item that hold one of its answer words."""
        starts, row = cuts(offsets, BLOCK)
        n = len(starts)
        blocks = _projected(_runs(codes, starts, BLOCK), latent.directions)
        ends = np.append(starts[1:], len(codes))
        nth = (starts - offsets[row]) // BLOCK
        told = _answer_words(codes, starts)
        # two blocks make a short passage, two of those a longer one, and so on; a part counts if it is in the same row
        last = np.arange(n)
        short = sizes <= SHORT
        for width in (1, 2, 4):
            sums, reach = blocks.copy(), last.copy()
            if n > width:
                more = row[width:] == row[:-width]
                sums[:-width] += blocks[width:] * more[:, None]
                told[:-width] |= told[width:] & more[:, None]  # each row is read before it changes
                reach[:-width] = np.where(more, last[width:], last[:-width])
            blocks, last = sums, reach
            wanted = np.flatnonzero(nth % width == 0)
            for a in range(0, len(wanted), AT_ONCE):
                here = wanted[a : a + AT_ONCE]
                near = _unit(sums[here]) @ items.vectors.T
                hit = near >= COSINE
                if width == 1:
                    hit |= short
                found = np.flatnonzero(hit & told[here])
                if len(found):
                    p, i = np.divmod(found, near.shape[1])
                    yield from _overlapping(codes, offsets, flat, row[here[p]], i, starts[here[p]], ends[last[here[p]]], near[p, i], 2 * width * BLOCK)

    def _answer_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Blocks x items: whether a block holds an answer word of the item."""
        out = np.zeros((len(starts), len(lists)), dtype=bool)
        where = np.flatnonzero(np.take(asked, codes))
        block = np.searchsorted(starts, where, side="right") - 1
        first, n = np.take(of_code, codes[where]), np.take(n_of_code, codes[where])
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(block, n), of_item[np.repeat(first, n) + nth]] = True
        return out

    def _overlapping(codes, offsets, flat, row, item, first, last, cosine, size):
        # the passage and as many words around it as the item has, inside its document
        low = np.maximum(first - sizes[item], offsets[row])
        high = np.minimum(last + sizes[item], offsets[row + 1])
        # half the wanted share must be in the passage itself
        reach = np.arange(size)
        for a in range(0, len(item), 20_000):
            s = slice(a, a + 20_000)
            where = first[s, None] + reach
            inside = where < last[s, None]
            word = np.take(codes, where, mode="clip") + (item[s, None] << 16)
            enough = (np.take(flat, word) & inside).sum(axis=1) >= 0.5 * OVERLAP * np.minimum(sizes[item[s]], size)
            for j in np.flatnonzero(enough) + a:
                yield int(row[j]), int(item[j]), int(low[j]), int(high[j]), float(cosine[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # which codes an item holds, items x codes: made here, so that it neither stays on the driver nor travels
        flat = np.zeros(len(lists) << 16, dtype=bool)
        for i, own in enumerate(items.codes):
            flat[(i << 16) + own.astype(np.int64)] = True
        # blocks times items are held at once, so a long benchmark makes the pieces smaller
        for batch in pieces(batches, "codes", min(2 << 20, (1 << 30) // max(1, len(lists)))):
            codes, offsets = joined_codes(batch.column(1))
            best: dict[int, tuple] = {}
            if len(sizes) and len(codes):
                for row, item, low, high, cosine in candidates(codes, offsets, flat):
                    if row in best and best[row][0] == 1.0 and best[row][1] >= -item:
                        continue
                    words = codes[low:high].tolist()
                    held = set(words)
                    if len(held.intersection(lists[item])) < OVERLAP * len(set(lists[item])):
                        continue
                    if len(held & items.answers[item]) < ANSWER * len(items.answers[item]):
                        continue
                    share = common_subsequence(lists[item], words) / len(lists[item])
                    found = (share, -item, cosine)
                    if share >= SUBSEQUENCE and found > best.get(row, (0.0,)):
                        best[row] = found
            rows = [best.get(i) for i in range(batch.num_rows)]
            kind = pa.array([items.ids[-r[1]] if r else None for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r is not None for r in rows]), kind, pa.array([r[0] if r else None for r in rows], pa.float64()), pa.array([r[2] if r else None for r in rows], pa.float64())],
                [key, "contaminated", "item_id", "lcs_share", "cosine"],
            )
        del flat
        spare_memory()

    kind = coded_docs.schema[key].dataType.simpleString()
    return coded_docs.select(key, "codes").mapInArrow(run, f"`{key}` {kind}, contaminated boolean, item_id long, lcs_share double, cosine double")


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, contaminated, item_id, lcs_share and cosine of every row of ``docs``."""
    codes = written(coded(docs, key), "codes")
    latent = fitted(codes)
    return searched(codes, latent, prepared(benchmark.select(F.col("item_id").cast("long"), "text"), latent), key)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark item; all columns stay.

    The verdict hangs on the text alone, so it is carried by a fingerprint of 128 bits of the text: rows that share
    an id, or have none, are judged each by their own text.
    """
    print_of_text = F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    texts = docs.select(print_of_text.alias("__text"), "text")
    dirty = written(judged(texts, benchmark, "__text").filter("contaminated").select("__text").distinct(), "dirty")
    return docs.join(dirty, print_of_text == dirty["__text"], "left_anti")
