"""Vector code compression: product codes by Lloyd rounds over partition-local cover trees.

A vector becomes integers floor(1024 * x) and is cut into parts; each part position has a codebook of at most
``ENTRIES`` entries.

1. Every task packs its rows into chunks of ``CHUNK``.  A chunk holds one cover tree per part position over its
   distinct parts: the children of a node lie within half its radius of a child and further than that from each
   other.  Nodes stand in preorder, so a subtree is a range of places and its sum and count are differences of
   cumulative sums.  The chunks are written once to the shared folder.
2. A round walks each tree from the root.  By the triangle inequality a node's whole subtree belongs to the
   entry nearest to it if the second nearest is further by more than twice the radius; then the subtree is added
   at once.  Only ambiguous nodes descend; each of them is compared exactly.  Tasks send one sum per entry.
3. Entries become componentwise floors of their means; entries without parts stay.  After the rounds the trees
   are walked once more for the codes.

The driver holds the codebooks only (parts x entries x width integers).  Arithmetic is exact in integers.

Cases: rows whose vector is NULL or holds a NULL or non-finite component are dropped, as are rows whose vector has
another length than the one with the smallest id (it fits no codebook); an id that comes twice gives two rows;
rows without id sort last; equal distances take the lower entry; a length that the parts do not divide gives
parts of nearly equal width; an empty table gives no rows; other columns are ignored; NULL labels are one label.
Components of 2**18 and more in absolute value raise a ValueError, as squares might pass 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.stage import written
from barline.llm.substrings import packed, unpacked

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows of one chunk: a tree of so many nodes takes about n * n / 2 distances to build.
CHUNK = 4096
LARGEST = 1 << 28


def finite(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    limit = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit))
    return F.col(vector).isNotNull() & ~bad


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, ...]:
    """order, end, radius, parent and depth of the nodes in preorder, for distinct points."""
    n = len(points)
    order, end, parent, depth = (np.zeros(n, dtype=np.int32) for _ in range(4))
    radius = np.zeros(n)
    place = points.astype(np.float64)

    def apart(rows: np.ndarray, centre: int) -> np.ndarray:
        gap = place[rows] - place[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    rest = np.arange(1, n, dtype=np.int32)
    stack = [(0, rest, apart(rest, 0), 0, 0)] if n else []
    node = 0
    while stack:
        centre, members, far, up, level = stack.pop()
        order[node], end[node], parent[node], depth[node] = centre, node + 1 + len(members), up, level
        if len(members):
            radius[node] = far.max()
            while len(members):
                child = int(members[0])
                gaps = apart(members, child)
                near = gaps <= radius[node] / 2
                stack.append((child, members[near][1:], gaps[near][1:], node, level + 1))
                members = members[~near]
        node += 1
    return order, end, radius, parent, depth


class Chunk:
    """Rows of one chunk and, per part position, their cover tree."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, labelled: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> None:
        self.ids, self.known, self.labels, self.labelled, self.trees = ids, known, labels, labelled, trees

    @classmethod
    def of(cls, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, labelled: np.ndarray, values: np.ndarray, cuts: list[int]) -> Chunk:
        trees = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            points, back, count = np.unique(values[:, a:b], axis=0, return_inverse=True, return_counts=True)
            order, end, radius, parent, depth = cover_tree(points)
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            trees.append((points[order].astype(np.int32), count[order].astype(np.int32), end, radius, parent, depth, place[back.ravel()]))
        return cls(ids, known, labels, labelled, trees)

    def to_bytes(self) -> bytes:
        return packed(self.ids, self.known, self.labels, self.labelled, *(a.ravel() for tree in self.trees for a in tree))

    @classmethod
    def from_bytes(cls, data: bytes) -> Chunk:
        ids, known, labels, labelled, *arrays = unpacked(data)
        trees = [tuple(arrays[k : k + 7]) for k in range(0, len(arrays), 7)]
        return cls(ids, known, labels, labelled, [(t[0].reshape(len(t[1]), -1), *t[1:]) for t in trees])


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries."""
    most = max((int(np.abs(x).max()) for x in (points, book) if x.size), default=0)
    if points.shape[1] * 4 * most * most < 1 << 53:
        p, b = points.astype(np.float64), book.astype(np.float64)
        return (np.einsum("ij,ij->i", p, p)[:, None] - 2 * (p @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    p, b = points.astype(np.int64), book.astype(np.int64)
    out = np.zeros((len(p), len(b)), dtype=np.int64)
    for k in range(p.shape[1]):
        out += (p[:, k, None] - b[None, :, k]) ** 2
    return out


def walked(tree: tuple[np.ndarray, ...], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of every node, and per entry the sums and counts of its parts."""
    points, weight, end, radius, parent, depth, _ = tree
    n, width = points.shape
    total = np.zeros((n + 1, width + 1), dtype=np.int64)
    np.cumsum(np.column_stack([points.astype(np.int64) * weight[:, None], weight]), axis=0, out=total[1:])
    code = np.zeros(n, dtype=np.int64)
    held = np.zeros((len(book), width + 1), dtype=np.int64)
    descends = np.zeros(n, dtype=bool)
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=0)) + 2))
    for level, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        nodes = by_depth[a:b]
        if level:
            nodes = nodes[descends[parent[nodes]]]
        if not len(nodes):
            break
        gaps = squares(points[nodes], book)
        nearest = gaps.argmin(axis=1)
        rows = np.arange(len(nodes))
        best = np.sqrt(gaps[rows, nearest])
        gaps[rows, nearest] = np.iinfo(np.int64).max
        second = np.sqrt(gaps.min(axis=1).astype(np.float64)) if len(book) > 1 else np.full(len(nodes), np.inf)
        # the slack stands for rounded roots; equal distances always descend
        whole = best + 2 * radius[nodes] < second * (1 - 1e-9)
        whole |= end[nodes] == nodes + 1
        code[nodes] = nearest
        descends[nodes[~whole]] = True
        upto = np.where(whole, end[nodes], nodes + 1)
        np.add.at(held, nearest, total[upto] - total[nodes])
        for at in np.flatnonzero(whole & (end[nodes] > nodes + 1)):
            code[nodes[at] : end[nodes[at]]] = nearest[at]
    return code, held[:, :width], held[:, width]


def trees(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """One row ``chunk`` (binary) for up to ``CHUNK`` rows of a partition of ``vectors`` (vec_id, label, values)."""
    cuts = [len(part) for part in np.array_split(np.arange(width), parts)]
    cuts = [0, *np.cumsum(cuts).tolist()]

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, labels, values = (table.column(i).combine_chunks() for i in range(3))
        flat = np.asarray(values.flatten(), dtype=np.float64).reshape(len(ids), width)
        whole = np.floor(SCALE * flat)
        if whole.size and np.abs(whole).max() >= LARGEST:
            raise ValueError(f"components of {LARGEST // SCALE} and more cannot be coded exactly")
        chunk = Chunk.of(
            np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.int8), np.asarray(labels.fill_null(0)),
            np.asarray(labels.is_valid()).astype(np.int8), whole.astype(np.int64), cuts,
        )
        return pa.RecordBatch.from_arrays([pa.array([chunk.to_bytes()], pa.binary())], ["chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == CHUNK:
                    yield made(held)
                    held, rows = [], 0
        if rows:
            yield made(held)

    return vectors.mapInArrow(run, "chunk binary")


def moved(chunks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(book.shape, dtype=np.int64) for book in books]
        counts = [np.zeros(len(book), dtype=np.int64) for book in books]
        for batch in batches:
            for data in batch.column(0):
                for k, tree in enumerate(Chunk.from_bytes(data.as_py()).trees):
                    _, total, count = walked(tree, books[k])
                    sums[k] += total
                    counts[k] += count
        rows = [(k, int(e), int(counts[k][e]), sums[k][e].tolist()) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "entry", "n", "sums"])

    found = chunks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    cells = found.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [book.copy() for book in books]
    for row in cells.collect():  # parts x entries x width at most
        out[row["part"]][row["entry"], row["pos"]] = row["s"] // row["n"]
    return out


def coded(chunks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                chunk = Chunk.from_bytes(data.as_py())
                n = len(chunk.ids)
                digits, error = np.zeros((n, len(books)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for k, tree in enumerate(chunk.trees):
                    points, place = tree[0].astype(np.int64), tree[6]
                    code, _, _ = walked(tree, books[k])
                    gap = points - books[k][code]
                    digits[:, k] = code[place]
                    error += np.einsum("ij,ij->i", gap, gap)[place]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk.ids, mask=chunk.known == 0), pa.array(chunk.labels, mask=chunk.labelled == 0),
                        pa.array([row.tobytes().hex() for row in digits], pa.string()), pa.array(error),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return chunks.mapInArrow(run, "vec_id long, label long, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes (vec_id, label, code, error) of ``vectors`` (vec_id, embedding, label) and the codebooks, one a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("values")).filter(finite("values"))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(1).collect()
    width = len(seeds[0]["values"]) if seeds else 0
    rows = rows.filter(F.size("values") == width)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).collect()  # at most 256 rows
    start = np.floor(SCALE * np.array([row["values"] for row in first], dtype=np.float64).reshape(len(first), width)).astype(np.int64)
    books = np.array_split(start, parts, axis=1)
    chunks = written(trees(rows, width, parts), "chunks")
    for _ in range(rounds):
        books = moved(chunks, books)
    return coded(chunks, books), books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (over equal labels) and codebooks_sha256."""
    codes, books = compressed(vectors)
    codes = written(codes, "codes")
    # a few sums a label, summed per task first; a hot label is no group of rows
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(labels, codes["label"].eqNullSafe(labels["of"])).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def sql() -> str:
    """The same rounds over ``embeddings`` in SQL."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT p.row, p.part, min(struct_pack(d := p.xx - 2 * list_inner_product(p.x, b.c) + b.cc, e := b.entry)) AS near FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT part, entry, list(v ORDER BY pos) AS c FROM (
    SELECT u.part, near.e AS entry, u.pos, floor(sum(u.v) / count(*)) AS v FROM u JOIN a{k} a ON u.row = a.row AND u.part = a.part GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT part, entry, c, list_inner_product(c, c) AS cc FROM (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT row, part, x, list_inner_product(x, x) AS xx FROM (
    SELECT row, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS parts(part))),
u AS MATERIALIZED (SELECT row, part, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM p),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x AS c, xx AS cc FROM p WHERE row <= {ENTRIES}),{",".join(steps)},
coded AS MATERIALIZED (
  SELECT row, string_agg(lower(printf('%02x', CAST(near.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS sha FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM kept JOIN coded USING (row), books"""
