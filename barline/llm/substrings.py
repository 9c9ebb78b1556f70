"""Substring dedup: words in runs of 20 that start earlier elsewhere are removed.

A truncated generalised suffix tree over words, built in prefix partitions.  A suffix is a word
position; only its first ``DEPTH`` words matter, so the tree is cut there and the deep internal nodes are
those at that depth.  A node is named by the 64-bit fingerprint of its path from the root, made for all
suffixes of a batch by prefix sums.  Suffixes are split by the leading bits of the name (a prefix of fixed
depth, as shorter prefixes are skewed) into groups of ``GROUP`` suffixes; sorting a group brings the leaves of
every node together, and all leaves but the first in (document, position) order are repeats.  Joining
repeats that overlap gives the maximal removed spans.

Flow: batch of texts -> suffixes, of which each batch keeps the first leaf of a node (the rest are known
repeats, so a node held by a third of all documents sends one suffix per batch) -> groups -> repeats back
to their batch -> spans per document -> one join with the texts.

Cases: NULL, empty and blank texts have no words and keep none; texts under 20 words are kept whole; the
same id and text twice keep the same words, as neither copy starts earlier; rows without id come last and
count as one document; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.text import pieces, windows, within, words_of

DEPTH = 20
#: Suffixes of a group that one task sorts, at about 40 bytes each; and bytes of text in a batch.
GROUP = 2_000_000
BATCH_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one behind the other, each with its type and length."""
    parts = []
    for a in arrays:
        parts += [np.array([ord(a.dtype.char), len(a)], dtype="<i8").tobytes(), a.tobytes()]
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = np.frombuffer(data, "<i8", 2, at)
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, int(n), at + 16))
        at += 16 + int(n) * dtype.itemsize
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as steps, in two or four bytes each if they fit."""
    gaps = np.diff(ascending, prepend=0)
    if len(gaps) == 0 or gaps.min() >= 0 and gaps.max() < 1 << 16:
        return gaps.astype(np.uint16)
    return gaps.astype(np.uint32) if gaps.min() >= 0 and gaps.max() < 1 << 32 else gaps


def places(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.int64))


def repeats_in(names: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of the leaves that are not first at their node; equal (document, position) are one leaf."""
    order = np.argsort(names)
    equal = names[order][1:] == names[order][:-1]
    shared = np.zeros(len(names), dtype=bool)
    shared[1:] |= equal
    shared[:-1] |= equal
    leaves = order[shared]
    leaves = leaves[np.lexsort((starts[leaves], docs[leaves], names[leaves]))]
    first = np.ones(len(leaves), dtype=bool)
    first[1:] = names[leaves][1:] != names[leaves][:-1]
    head = leaves[np.maximum.accumulate(np.where(first, np.arange(len(leaves)), 0))]
    return leaves[(docs[leaves] != docs[head]) | (starts[leaves] != starts[head])]


def _suffixes(groups: int):
    """Texts -> rows of suffixes per group, and one row per batch with its documents and known repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, limit=BATCH_BYTES):
            ids = np.asarray(batch.column(0).fill_null(LAST))
            batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
            ids, keys = np.asarray(batch.column(0).fill_null(LAST)), np.asarray(batch.column(1))
            w = words_of(batch.column(2))
            names = windows(w.fingerprints(), DEPTH)
            at = np.flatnonzero(within(w.offsets, DEPTH))
            names, text = names[at], np.searchsorted(w.offsets, at, side="right") - 1
            starts = at - w.offsets[text]
            order = np.argsort(names, kind="stable")
            first = np.ones(len(order), dtype=bool)
            first[1:] = names[order][1:] != names[order][:-1]
            head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = order[~first & ((ids[text[order]] != ids[text[head]]) | (starts[order] != starts[head]))]
            number = task << 32 | count
            count += 1
            rows = [(-1 - number, number, packed(ids, keys, w.offsets.astype(np.int64), steps(np.sort(at[later]))))]
            sent = np.sort(order[first])
            group = ((names[sent] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            by_group = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[by_group], np.arange(groups + 1))
            for g in range(groups):
                mine = sent[by_group[bounds[g] : bounds[g + 1]]]
                if len(mine):
                    inside, n = np.unique(text[mine], return_counts=True)
                    rows.append((g, number, packed(names[mine], steps(at[mine]), steps(ids[inside]), steps(w.offsets[inside]), steps(np.cumsum(n)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["grp", "batch", "data"])

    return run


def _group_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order -> repeats per batch; the rows that describe batches pass."""
    names_of = ["batch", "kind", "data"]

    def rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items), (pa.int64(), pa.int32(), pa.binary()))], names_of)

    def solved(held: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        parts = [unpacked(data) for _, data in held]
        at = [places(p[1]) for p in parts]
        docs = np.concatenate([np.repeat(places(p[2]), p[4]) for p in parts])
        starts = np.concatenate([a - np.repeat(places(p[3]), p[4]) for a, p in zip(at, parts)])
        source = np.repeat(np.arange(len(parts)), [len(a) for a in at])
        found = np.sort(repeats_in(np.concatenate([p[0] for p in parts]), docs, starts))
        bounds = np.searchsorted(source[found], np.arange(len(parts) + 1))
        every = np.concatenate(at)
        return [(held[i][0], 1, packed(steps(every[found[a:b]]))) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]

    current, held = None, []
    for batch in batches:
        for group, number, data in zip(*(c.to_pylist() for c in batch.columns)):
            if group < 0:
                yield rows([(number, 0, data)])
                continue
            if group != current and held:
                if out := solved(held):
                    yield rows(out)
                held = []
            current = group
            held.append((number, data))
    if held and (out := solved(held)):
        yield rows(out)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch after another -> removed spans (pairs of word numbers) of every document with one."""

    def solved(table: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        ids, keys, offsets, known = table
        change = np.zeros(int(offsets[-1]) + 1, dtype=np.int32)
        for at in [places(known), *found]:
            np.add.at(change, at, 1)
            np.add.at(change, at + DEPTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # spans that touch across a text's end are cut there
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(gone))]
        cuts = np.unique(cuts[gone[cuts - 1] & gone[cuts]]) if len(cuts) else cuts
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
        text = np.searchsorted(offsets, begin, side="right") - 1
        pairs = np.column_stack([begin - offsets[text], end - offsets[text]]).astype(np.int32)
        held, first = np.unique(text, return_index=True)
        bounds = [*first.tolist(), len(text)]
        data = [pairs[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids[held]), pa.array(keys[held]), pa.array(data, pa.binary())], ["__id", "__text", "spans"])

    current, table, found = None, None, []
    for batch in batches:
        for number, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if number != current:
                if table is not None:
                    yield solved(table, found)
                current, table, found = number, None, []
            if kind == 0:
                table = unpacked(data)
            else:
                found.append(places(unpacked(data)[0]))
    if table is not None:
        yield solved(table, found)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"), "text"
    )


def removed_spans(docs: DataFrame) -> DataFrame:
    """__id, __text and spans (int32 pairs of word numbers, end exclusive) of every document that loses words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, round(size / 6 / GROUP))
    suffixes = _keyed(docs).select("__id", "__text", "text").mapInArrow(_suffixes(groups), "grp long, batch long, data binary")
    grouped = suffixes.repartition(F.col("grp")).sortWithinPartitions("grp")
    repeats = grouped.mapInArrow(_group_repeats, "batch long, kind int, data binary")
    by_batch = repeats.repartition(F.col("batch")).sortWithinPartitions("batch", "kind")
    return by_batch.mapInArrow(_spans, "__id long, __text long, spans binary").dropDuplicates(["__id", "__text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of every row."""
    joined = _keyed(docs).join(removed_spans(docs), ["__id", "__text"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n_words, n_removed, kept, digests = [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = text.split() if text else []
                n_words.append(len(words))
                if spans:
                    at, rest = 0, []
                    for begin, end in np.frombuffer(spans, dtype=np.int32).reshape(-1, 2).tolist():
                        rest += words[at:begin]
                        at = end
                    words = rest + words[at:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def sql() -> str:
    """The same digests over ``documents`` in SQL, window by window."""
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) - {DEPTH - 2})) AS i FROM w WHERE len(w) >= {DEPTH}),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + {DEPTH - 1}], ' ')) AS name FROM p),
d AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY name ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + {DEPTH})) AS i FROM d),
words AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS MATERIALIZED (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""
