"""Embedding near duplicates by navigable small-world graphs per shard.

1. Equal vectors are one class, known by its smallest id and its number of rows; so copies cost one search.
2. Classes are dealt to shards by a hash.  A task builds one hierarchical graph per shard: a node's top layer is
   drawn from its hash, layers shrink by ``DEGREE``, and a new node is joined to near but mutually distant nodes
   that a beam search finds.  Insertion and search handle a block of vectors at once.
3. Every graph audits itself: ``AUDITED`` of its vectors are turned away by random angles up to the threshold, and
   a block product tells which nodes each of them is similar to.  The beam is doubled until a search finds at
   least ``RECALL`` of those; the width is kept with the graph.
4. Every shard's vectors are searched in its own graph and in the graphs of all later shards, so a pair of shards
   is met once.  A beam that ends full of similar nodes may have lost some; such a vector is compared with the
   whole shard in a block product, so there is no cap on links.  What is found is verified in double precision.
5. A pair of shards sends, for each class with links, their number of rows, and a spanning forest of the links
   (fewer edges than nodes), not the links.  Union-find and star steps join the forests to components.

Memory: a task holds one graph (``shard`` vectors and ``2 * DEGREE`` neighbours each) and a chunk of queries.  Shards
grow with the square root of the table up to ``LARGEST_SHARD`` vectors, so searches grow by N * sqrt(N) / 2 at first.

Cases: vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, neither do rows
without id (NULL component, kept); vectors of different lengths are never similar; rows that repeat an id with
the same vector count as two linked vectors; rows of one id with different vectors share their links and their component; equal similarities need no order; an empty table gives no
rows; other columns are ignored.  Similarity is the dot product over the root of the product of the squared norms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.codes import finite
from barline.llm.minhash import connected
from barline.llm.stage import written
from barline.llm.substrings import packed, unpacked
from barline.llm.text import mixed

SIMILARITY = 0.9
DEGREE, BUILD_BEAM, FIRST_BEAM = 16, 48, 32
AUDITED, RECALL = 128, 0.995
SMALLEST_SHARD, LARGEST_SHARD = 4096, 1 << 18
#: Vectors searched at once, and rows of a chunk that travels.
BLOCK, CHUNK = 256, 4096
#: Best open nodes of a beam that are expanded in one step.
EXPANDED = 4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision, for search only."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]).astype(np.float32)


def similar(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of ``x`` and ``y`` reach ``least``, in double precision; scaling by powers of two is exact."""
    x, y = (v * np.exp2(-np.frexp(np.abs(v).max(axis=1, keepdims=True))[1].astype(np.float64)) for v in (x, y))
    dot, xx, yy = (np.einsum("ij,ij->i", a, b) for a, b in ((x, y), (x, x), (y, y)))
    return dot / np.sqrt(xx * yy) >= least


class Graph:
    """Nodes in order of their top layer; layer ``l`` is the graph of the first ``sizes[l]`` nodes."""

    def __init__(self, units: np.ndarray, layers: list[np.ndarray], beam: int = FIRST_BEAM) -> None:
        self.units, self.layers, self.beam = units, layers, beam

    @staticmethod
    def order(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Nodes by descending top layer, and the number of nodes of each layer."""
        chance = (mixed(keys.astype(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        top = np.floor(-np.log(np.maximum(chance, 1e-18)) / math.log(DEGREE)).astype(np.int64)
        order = np.lexsort((keys, -top))
        sizes = [int((top >= layer).sum()) for layer in range(int(top.max(initial=0)) + 1)]
        return order, sizes

    @classmethod
    def built(cls, units: np.ndarray, sizes: list[int]) -> Graph:
        graph = cls(units, [np.full((n, DEGREE * (2 if layer == 0 else 1)), -1, dtype=np.int32) for layer, n in enumerate(sizes)])
        for layer in range(len(sizes) - 1, -1, -1):
            done, n = 1, sizes[layer]
            while done < n:
                last = min(n, done + min(done, BLOCK))
                graph._insert(layer, done, last)
                done = last
        return graph

    def _insert(self, layer: int, first: int, last: int) -> None:
        """Join nodes first..last to the earlier nodes of the layer and to each other."""
        links, new = self.layers[layer], np.arange(first, last)
        query = self.units[new]
        near, sims = self._beam(layer, query, self._entries(layer, query), BUILD_BEAM)
        among = query @ query.T
        np.fill_diagonal(among, -np.inf)
        width = min(BUILD_BEAM, len(new))
        best = np.argpartition(-among, width - 1, axis=1)[:, :width]
        rows = np.arange(len(new))[:, None]
        inside = np.where(np.isfinite(among[rows, best]), new[best], -1)
        near, sims = np.concatenate([near, inside], axis=1), np.concatenate([sims, among[rows, best]], axis=1)
        links[new, :DEGREE] = self._chosen(query, near, sims, DEGREE)
        # links back: a node with too many keeps the ones that its own choice would keep
        source, target = np.repeat(new, DEGREE), links[new, :DEGREE].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, begin, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        offered = np.full((len(touched), most), -1, dtype=np.int64)
        offered[np.repeat(np.arange(len(touched)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        every = np.concatenate([links[touched].astype(np.int64), offered], axis=1)
        for a in range(0, len(touched), BLOCK):
            mine = every[a : a + BLOCK]
            own = self.units[touched[a : a + BLOCK]]
            mine = np.sort(mine, axis=1)
            mine[:, 1:][mine[:, 1:] == mine[:, :-1]] = -1
            sim = np.einsum("rkd,rd->rk", self.units[np.maximum(mine, 0)], own)
            links[touched[a : a + BLOCK]] = self._chosen(own, mine, np.where(mine >= 0, sim, -np.inf), links.shape[1])

    def _chosen(self, query: np.ndarray, near: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Per row the nearest nodes that are nearer to it than to those chosen before; places left take the nearest others."""
        keep = min(near.shape[1], 2 * degree + 16)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
        rows = np.arange(len(query))
        near, sims = near[rows[:, None], order], sims[rows[:, None], order]
        place = self.units[np.maximum(near, 0)]
        between = np.einsum("rid,rjd->rij", place, place)
        taken, count = np.zeros(near.shape, dtype=bool), np.zeros(len(query), dtype=np.int64)
        for k in range(near.shape[1]):
            covered = (taken & (between[:, k] > sims[:, k, None])).any(axis=1)
            fine = ~covered & (near[:, k] >= 0) & np.isfinite(sims[:, k]) & (count < degree)
            taken[:, k] = fine
            count += fine
        rank = np.where(taken, 0, np.where((near >= 0) & np.isfinite(sims), 1, 2)) * near.shape[1] + np.arange(near.shape[1])
        first = np.argsort(rank, axis=1)[:, :degree]
        out = np.full((len(query), degree), -1, dtype=np.int32)
        picked = np.where(rank[rows[:, None], first] < 2 * near.shape[1], near[rows[:, None], first], -1)
        out[:, : picked.shape[1]] = picked
        return out

    def _entries(self, layer: int, query: np.ndarray) -> np.ndarray:
        """One entry node per query, by greedy descent through the layers above."""
        at = np.zeros(len(query), dtype=np.int64)
        for above in range(len(self.layers) - 1, layer, -1):
            near, _ = self._beam(above, query, at, 1)
            at = near[:, 0]
        return at

    def _beam(self, layer: int, query: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of each query's beam (unordered, -1 for a free place)."""
        links, n = self.layers[layer], len(query)
        nodes, sims = np.full((n, width), -1, dtype=np.int64), np.full((n, width), -np.inf, dtype=np.float32)
        opened = np.zeros((n, width), dtype=bool)
        seen = np.zeros((n, len(links)), dtype=bool)
        rows = np.arange(n)
        nodes[:, 0], sims[:, 0] = entries, np.einsum("ij,ij->i", self.units[entries], query)
        seen[rows, entries] = True
        going = rows
        step = min(EXPANDED, width)
        while len(going):
            waiting = np.where(opened[going], -np.inf, sims[going])
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < width else np.tile(np.arange(width), (len(going), 1))
            fresh = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            more = fresh.any(axis=1)
            going, pick, fresh = going[more], pick[more], fresh[more]
            if not len(going):
                break
            opened[going[:, None], pick] |= fresh
            around = np.where(fresh[:, :, None], links[np.maximum(nodes[going[:, None], pick], 0)], -1).reshape(len(going), -1)
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            new = (around >= 0) & ~seen[going[:, None], np.maximum(around, 0)]
            r, k = np.nonzero(new)
            found = around[r, k]
            seen[going[r], found] = True
            score = np.full(around.shape, -np.inf, dtype=np.float32)
            score[r, k] = np.einsum("ij,ij->i", self.units[found], query[going[r]])
            every_node = np.concatenate([nodes[going], np.where(new, around, -1)], axis=1)
            every_sim = np.concatenate([sims[going], score], axis=1)
            every_open = np.concatenate([opened[going], np.zeros(around.shape, dtype=bool)], axis=1)
            best = np.argpartition(-every_sim, width - 1, axis=1)[:, :width]
            nodes[going], sims[going] = np.take_along_axis(every_node, best, axis=1), np.take_along_axis(every_sim, best, axis=1)
            opened[going] = np.take_along_axis(every_open, best, axis=1)
        return nodes, sims

    def found(self, query: np.ndarray, least: float, beam: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``query`` and nodes whose similarity may reach ``least`` (single precision, a little below it), in blocks."""
        beam = min(beam or self.beam, len(self.units))
        low = least - 1e-5
        for a in range(0, len(query), BLOCK):
            part = query[a : a + BLOCK]
            nodes, sims = self._beam(0, part, self._entries(0, part), beam)
            full = (sims >= low).all(axis=1)
            r, k = np.nonzero((sims >= low) & ~full[:, None])
            yield a + r, nodes[r, k]
            crowded = np.flatnonzero(full)
            for b in range(0, len(self.units) if len(crowded) else 0, CHUNK):
                r, k = np.nonzero(part[crowded] @ self.units[b : b + CHUNK].T >= low)
                yield a + crowded[r], b + k

    def audited(self, least: float, seed: int) -> Graph:
        """The same graph with the first beam, doubled from ``FIRST_BEAM``, that passes the audit."""
        n, width = self.units.shape
        rng = np.random.default_rng(seed)
        own = self.units[rng.choice(n, min(n, AUDITED), replace=False)].astype(np.float64)
        side = rng.normal(size=own.shape)
        side -= np.einsum("ij,ij->i", side, own)[:, None] * own
        length = np.sqrt(np.einsum("ij,ij->i", side, side))[:, None]
        angle = np.arccos(least) * rng.random((len(own), 1))
        query = np.where(length > 1e-9, np.cos(angle) * own + np.sin(angle) * side / np.maximum(length, 1e-9), own).astype(np.float32)
        truth = np.concatenate([query @ self.units[b : b + CHUNK].T for b in range(0, n, CHUNK)], axis=1) >= least
        self.beam = FIRST_BEAM
        while self.beam < n:
            got = np.zeros(truth.shape, dtype=bool)
            for rows, nodes in self.found(query, least):
                got[rows, nodes] = True
            if (got & truth).sum() >= RECALL * truth.sum():
                break
            self.beam *= 2
        return self


def shard_size(rows: int) -> int:
    return int(min(LARGEST_SHARD, max(SMALLEST_SHARD, 32 * math.isqrt(rows))))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Runs of rows with equal leading columns, each as an iterator of slices; a run must be used up before the next."""
    waiting: list[pa.RecordBatch] = []
    source = iter(batches)

    def key_of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(i)[row].as_py() for i in range(keys))

    def slices(key: tuple) -> Iterator[pa.RecordBatch]:
        while True:
            batch = waiting.pop() if waiting else next(source, None)
            if batch is None:
                return
            if not batch.num_rows:
                continue
            if key_of(batch, batch.num_rows - 1) == key:
                yield batch
                continue
            cut = next(i for i in range(batch.num_rows) if key_of(batch, i) != key)
            waiting.append(batch.slice(cut))
            if cut:
                yield batch.slice(0, cut)
            return

    while True:
        while not waiting:
            batch = next(source, None)
            if batch is None:
                return
            if batch.num_rows:
                waiting.append(batch)
        key = key_of(waiting[-1], 0)
        yield key, slices(key)


def _graphs(least: float):
    """Classes in shard order -> chunks (width, shard, chunk, nodes, links) of audited graphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (width, shard), parts in _grouped(batches, 2):
            table = pa.Table.from_batches(list(parts))
            ids, sizes = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
            values = np.asarray(table.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), width)
            order, layers = Graph.order(ids)
            ids, sizes, values = ids[order], sizes[order], values[order]
            graph = Graph.built(unit(values), layers).audited(least, shard)
            with np.errstate(over="ignore"):
                short = values.astype(np.float32)
            values = short if (short == values).all() else values
            for k, a in enumerate(range(0, len(ids), CHUNK)):
                rows = slice(a, a + CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x], pa.int32()) for x in (width, shard, k)), pa.array([packed(ids[rows], sizes[rows], values[rows].ravel())], pa.binary()),
                        pa.array([packed(np.array([graph.beam]), *(layer[rows].ravel() for layer in graph.layers))], pa.binary()),
                    ],
                    ["width", "shard", "chunk", "nodes", "links"],
                )

    return run


class Labels:
    """Union-find over local numbers, whole arrays at once; the smallest number of a set is its root."""

    def __init__(self) -> None:
        self.up = np.zeros(0, dtype=np.int64)

    def grow(self, n: int) -> None:
        self.up = np.concatenate([self.up, np.arange(len(self.up), len(self.up) + n)])

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[x]
            if (up == x).all():
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _links(least: float):
    """Rows (cell, role, chunk, own, width, nodes, links), a graph's chunks before the queries' -> (a, b, n).

    Rows with a = b give the number ``n`` of linked rows elsewhere, the others are edges of a spanning forest.
    """

    def rows_of(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches, 1):
            held, graph = [], None
            for part in parts:
                for role, chunk, own, width, nodes, links in zip(*(part.column(c) for c in ("role", "chunk", "own", "width", "nodes", "links"))):
                    ids, sizes, flat = unpacked(nodes.as_py())
                    values = flat.reshape(len(ids), width.as_py()).astype(np.float64)
                    if role.as_py() == 0:
                        held.append((ids, sizes, values, *unpacked(links.as_py())))
                        continue
                    if graph is None and not held:  # a shard without vectors of this length
                        continue
                    if graph is None:
                        node_ids, node_sizes, node_values = (np.concatenate([h[i] for h in held]) for i in range(3))
                        layers = [np.concatenate([h[k] for h in held]).reshape(-1, DEGREE * (2 if k == 4 else 1)) for k in range(4, len(held[0]))]
                        graph = Graph(unit(node_values), layers, int(held[0][3][0]))
                        held, labels, every_id = [], Labels(), [node_ids]
                        labels.grow(len(node_ids))
                        counts = np.zeros(len(node_ids), dtype=np.int64)
                    here = chunk.as_py() * CHUNK if own.as_py() else len(labels.up)
                    if not own.as_py():
                        labels.grow(len(ids))
                        every_id.append(ids)
                        counts = np.concatenate([counts, np.zeros(len(ids), dtype=np.int64)])
                    for rows, near in graph.found(unit(values), least):
                        if own.as_py():  # a pair inside the shard belongs to its later node
                            earlier = near < here + rows
                            rows, near = rows[earlier], near[earlier]
                        true = np.zeros(len(rows), dtype=bool)
                        for a in range(0, len(rows), 1 << 15):
                            some = slice(a, a + (1 << 15))
                            true[some] = similar(values[rows[some]], node_values[near[some]], least)
                        rows, near = rows[true], near[true]
                        np.add.at(counts, here + rows, node_sizes[near])
                        np.add.at(counts, near, sizes[rows])
                        labels.join(here + rows, near)
            if graph is not None:
                ids = np.concatenate(every_id)
                linked = np.flatnonzero(counts)
                if len(linked):
                    yield rows_of(ids[linked], ids[linked], counts[linked])
                    root = labels.roots(linked)
                    yield rows_of(ids[linked[root != linked]], ids[root[root != linked]], np.zeros(int((root != linked).sum()), dtype=np.int64))

    return run


def class_links(classes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Counts and spanning forests (a, b, n) of ``classes`` (doc_id, vector, n)."""
    rows = classes.count()
    shards = max(1, math.ceil(rows / shard_size(rows)))
    dealt = classes.select(F.size("vector").alias("width"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n", "vector")
    dealt = dealt.repartition(4 * shards, "width", "shard").sortWithinPartitions("width", "shard")
    graphs = written(dealt.mapInArrow(_graphs(least), "width int, shard int, chunk int, nodes binary, links binary"), "graphs")
    own = F.col("shard")
    as_graph = F.transform(F.sequence(F.lit(0), own), lambda i: F.struct(F.lit(0).alias("role"), i.alias("i"), own.alias("j")))
    as_query = F.transform(F.sequence(own, F.lit(shards - 1)), lambda j: F.struct(F.lit(1).alias("role"), own.alias("i"), j.alias("j")))
    cells = graphs.select("width", "chunk", "nodes", "links", F.explode(F.concat(as_graph, as_query)).alias("at"))
    number = (F.col("width").cast("long") * shards + F.col("at.i")) * shards + F.col("at.j")
    cells = cells.select(
        number.alias("cell"), F.col("at.role").alias("role"), "chunk", (F.col("at.i") == F.col("at.j")).alias("own"), "width", "nodes",
        F.when(F.col("at.role") == 0, F.col("links")).alias("links"),
    )
    cells = cells.repartition(min(20_000, shards * (shards + 1)), "cell").sortWithinPartitions("cell", "role", "chunk")
    return cells.mapInArrow(_links(least), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0)
    # adding zero makes minus zero equal to zero
    rows = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0))))
    rows = rows.withColumns({"h": F.when(F.col("vector").isNotNull(), F.xxhash64("vector")), "g": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector"))})
    classes = rows.filter("vector is not null").groupBy("h", "g", "vector").agg(F.min("vec_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    found = written(class_links(classes.select("doc_id", "vector", "n"), least), "links")
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("other"))
    components = connected(found.filter("a <> b").select("a", "b"))
    named = classes.join(counts, classes["doc_id"] == counts["a"], "left").join(components.withColumnRenamed("doc_id", "c"), F.col("doc_id") == F.col("c"), "left")
    named = named.select("h", "g", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("component", "doc_id").alias("component"))
    out = rows.select("vec_id", "h", "g").join(named, ["h", "g"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def sql() -> str:
    """Exact links and components over ``embeddings`` in SQL."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= {SIMILARITY}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
