"""Near duplicates by SuperMinHash, banding, verification on full sets and union-find.

1. Every text becomes its set of five-word shingles (64-bit fingerprints).  Texts with equal
   word sequences are one class and go on as its smallest document.
2. SuperMinHash: every element ranks the signature's places by a random permutation drawn step by
   step; the value at the j-th place is j plus a random fraction, so the values of one element are
   correlated and differ.  Steps end as soon as all places of a text hold a value below the next step.
3. Rows of a signature form bands.  At the wanted similarity of 0.75 a pair misses all bands with a
   chance of 2e-6.
4. A band bucket is never expanded into pairs.  First all members are compared with the bucket's
   smallest one and linked pairs are joined by union-find.  Buckets that still hold several components
   go through two further rounds, in which members of different components whose signatures agree
   well enough to be above the threshold are compared: first each with its likeliest partner, then, block by block
   inside tasks, all pairs that are left.  The full sets of a block's near members come to the task once, and
   only a spanning forest of the links leaves it.  So a link between candidates is lost with a chance of 1e-7,
   copies cost one comparison each, and no row stands for a pair that is none.
5. Links are confirmed on the full sets: 100 * intersection >= 75 * union.

Cases: NULL, empty and blank texts have an empty set and are linked with nothing; fewer than five
words are one shingle; repeated rows (one id twice) share a component; rows without id keep a NULL
component and are kept; other columns are ignored by ``components`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.stage import spare_memory, written
from barline.llm.text import mixed, pieces, windows, within, words_of

SHINGLE = 5
BANDS, ROWS = 48, 5
PLACES = BANDS * ROWS
SIMILARITY = 0.75
#: Share of equal one-byte signature places from which a pair is compared on full sets: a pair at 0.75 has less with a chance of 1e-7.
LIKELY = 0.60
#: Members of a bucket that are compared with each other in one task.
BLOCK = 500
#: Likeliest partners of other components that a member takes in a bucket: in the first round, and at last all.
PARTNERS, ALL_PARTNERS = (1,), 1 << 40
#: Random steps are made for at most so many elements at once.
ELEMENTS = 1 << 16


def shingle_sets(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each text, and a 128-bit fingerprint of its word sequence."""
    w = words_of(column)
    prints = w.fingerprints(lower=True)
    grams, inside = windows(prints, SHINGLE), within(w.offsets, SHINGLE)
    sets, whole = [], np.zeros((len(column), 2), dtype=np.uint64)
    place = np.arange(1, len(prints) + 1, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:])):
        own = prints[a:b]
        if b - a >= SHINGLE:
            ends = b - SHINGLE + 1
            assert inside[a] and inside[ends - 1]
            sets.append(np.unique(grams[a:ends]))
        elif b > a:
            sets.append(mixed(np.array([np.bitwise_xor.reduce(mixed(own + place[: b - a]))], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        if b > a:
            order = place[: b - a]
            whole[i] = np.sum(mixed(own ^ mixed(order))), np.sum(mixed(own + mixed(order) * np.uint64(3)))
    return sets, whole


def _fraction(state: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(state + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places); an empty set has infinities."""
    out = np.full((len(sets), places), np.inf)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + sizes[last] <= ELEMENTS):
            total += sizes[last]
            last += 1
        _sign(sets[first:last], out[first:last], places)
        first = last
    return out


def _sign(sets: list[np.ndarray], out: np.ndarray, places: int) -> None:
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = out.reshape(-1)
    swapped: np.ndarray | None = None  # the permutations so far, kept only for texts that need a second step
    for step in range(places):
        if not len(elements):
            return
        other = step + (_fraction(elements, 2 * step + 1) * (places - step)).astype(np.int64)
        if step == 0:
            place = other
        else:
            rows = np.arange(len(elements))
            place = swapped[rows, other].astype(np.int64)
            swapped[rows, other] = swapped[:, step]
        np.minimum.at(flat, owner * places + place, step + _fraction(elements, 2 * step + 2))
        # a text is done once every place is below the next step's values
        open_texts = out.max(axis=1) >= step + 1
        going = open_texts[owner]
        if step == 0:
            elements, owner, first_other = elements[going], owner[going], other[going]
            swapped = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
            swapped[np.arange(len(elements)), first_other] = 0
        elif not going.all():
            elements, owner, swapped = elements[going], owner[going], swapped[going]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, whole (fingerprint of the words), bands (hash per band), marks (half of each), sig (a byte per place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in pieces(batches):
            sets, whole = shingle_sets(batch.column(1))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            bits = mixed(superminhash(sets).view(np.uint64))
            bands = mixed((bits.reshape(-1, BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64))),
                    pa.array([row.tobytes() for row in (bands >> np.uint64(32)).astype(np.uint32)], pa.binary()),
                    pa.array([row.tobytes() for row in bits.astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "whole_a", "whole_b", "bands", "marks", "sig"],
            )
        spare_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, whole_a long, whole_b long, bands array<long>, marks binary, sig binary"
    )


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and shingles (array) of the wanted documents, made again from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, _ = shingle_sets(batch.column(1))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["doc_id", "shingles"])

    # a merge join at every size: the ids grow with the corpus
    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "sb"}), "b").join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "sa"}), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= round(100 * SIMILARITY) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


class UnionFind:
    """Smallest member wins; paths are halved."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(edges: DataFrame) -> DataFrame:
    """Per partition the edges' union-find trees as stars: a node and its root."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        union = UnionFind()
        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                union.join(a, b)
        rows = [(x, r) for x in list(union.up) if (r := union.find(x)) != x]
        yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def _unsettled(stars: DataFrame) -> bool:
    """Whether some node has two parents, or a parent of others has one itself."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(stars.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or c = 1 and p = 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """doc_id, component (smallest id) of every document on an edge (a, b).

    Union-find shrinks each partition to stars; large-star and small-star steps join those across
    partitions until nothing changes.
    """
    stars = written(_forest(edges), "forest")
    while _unsettled(stars):
        both = stars.select("a", "b").union(stars.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: larger neighbours move to the least one
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        # small star: smaller neighbours and the node itself move to the least one
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select("a", "b", "m")
        stars = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "small")
    roots = stars.select("a", "b")
    return roots.union(roots.select(F.col("b"), F.col("b")).distinct()).toDF("doc_id", "component")


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """key, top (the largest component), most (its members) and all (all members) of the buckets with several components."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")
    )
    return found.filter("parts > 1").drop("parts")


def _cells(members: DataFrame) -> DataFrame:
    """Members that are to be compared with each other, in order of their group.

    ``members``: key, band, doc_id, component, marks, sig, n_shingles of the buckets with several components, and top,
    all and most of each bucket.  The largest component of a bucket is compared only with the others; buckets are cut
    into blocks, so a task holds two blocks at most.
    """
    placed = members.withColumn("rest", (F.col("component") != F.col("top")).cast("int"))
    blocks = F.ceil(F.when(F.col("rest") == 1, F.col("all") - F.col("most")).otherwise(F.col("most")) / F.lit(BLOCK)).cast("int")
    rest_blocks = F.ceil((F.col("all") - F.col("most")) / F.lit(BLOCK)).cast("int")
    top_blocks = F.ceil(F.col("most") / F.lit(BLOCK)).cast("int")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    # a rest block meets every rest block and every block of the largest component
    i = F.col("own")
    with_rest = F.transform(F.sequence(F.lit(0), rest_blocks - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least(i, j).alias("x"), F.greatest(i, j).alias("y")))
    with_top = F.transform(F.sequence(F.lit(0), top_blocks - 1), lambda j: F.struct(F.lit(0).alias("kind"), i.alias("x"), j.alias("y")))
    from_top = F.transform(F.sequence(F.lit(0), rest_blocks - 1), lambda j: F.struct(F.lit(0).alias("kind"), j.alias("x"), i.alias("y")))
    cells = placed.select("key", "band", "doc_id", "component", "marks", "sig", "n_shingles", "rest", F.explode(F.when(F.col("rest") == 1, F.concat(with_rest, with_top)).otherwise(from_top)).alias("cell"))
    cells = cells.select(F.xxhash64("key", "cell.kind", "cell.x", "cell.y").alias("group"), F.col("cell.kind").alias("kind"), "rest", "band", "doc_id", "component", "n_shingles", "marks", "sig")
    return cells.repartition(F.col("group")).sortWithinPartitions("group")


def _whole_groups(solve: Callable[[pa.Table], pa.RecordBatch]):
    """Rows in order of their first column -> ``solve`` on tables that hold whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group of a batch may go on in the next one
            group = np.asarray(batch.column(0))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))
        spare_memory()

    return run


def _further_pairs(members: DataFrame, partners: int) -> DataFrame:
    """Near pairs (a, b) of different components; of a bucket a document takes its ``partners`` likeliest ones."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        _, a, b = _near_pairs(rows, partners)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _cells(members).mapInArrow(_whole_groups(solve), "a long, b long").distinct()


def _linked_in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all linked near pairs of different components, confirmed on the full sets block by block."""

    def near(rows: pa.Table) -> pa.RecordBatch:
        """Per group with near pairs one row that holds them, and one row per document of theirs."""
        group, a, b = _near_pairs(rows, ALL_PARTNERS)
        order = np.argsort(group, kind="stable")
        group, a, b = group[order], a[order], b[order]
        begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, dtype=np.int64)
        keys, ids, pairs = [], [], []
        for x, y in zip(begin.tolist(), np.append(begin[1:], len(group)).tolist()):
            docs = np.unique(np.concatenate([a[x:y], b[x:y]]))
            keys += [group[x]] * (len(docs) + 1)
            ids += [None, *docs.tolist()]
            pairs += [np.column_stack([a[x:y], b[x:y]]).tobytes(), *[None] * len(docs)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(pairs, pa.binary())], ["group", "doc_id", "pairs"])

    found = written(_cells(members).mapInArrow(_whole_groups(near), "group long, doc_id long, pairs binary"), "near")
    nothing = F.lit(None)
    with_sets = found.filter("doc_id is not null").select("doc_id", "group").join(sets, "doc_id").select("group", F.lit(0).alias("kind"), "doc_id", "shingles", nothing.cast("binary").alias("pairs"))
    tests = found.filter("doc_id is null").select("group", F.lit(1).alias("kind"), nothing.cast("long").alias("doc_id"), nothing.cast("array<long>").alias("shingles"), "pairs")
    ordered = with_sets.unionByName(tests).repartition(F.col("group")).sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for batch in batches:
            for group, doc, shingles, pairs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if group != current:
                    current, held = group, {}
                if doc is not None:
                    held[doc] = shingles.values.to_numpy()
                elif links := _spanning(np.frombuffer(pairs.as_py(), dtype=np.int64).reshape(-1, 2), held):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
        spare_memory()

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _spanning(pairs: np.ndarray, sets: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Those linked ``pairs`` that join two parts; pairs inside a part need no comparison."""
    ids = np.array(sorted(sets), dtype=np.int64)
    sizes = np.array([len(sets[i]) for i in ids.tolist()], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.unique(np.concatenate([sets[i] for i in ids.tolist()]), return_inverse=True)[1] if len(ids) else np.zeros(0, dtype=np.int64)
    marked = np.zeros(int(codes.max(initial=-1)) + 1, dtype=bool)
    at = np.searchsorted(ids, pairs)
    at = at[np.lexsort((at[:, 1], at[:, 0]))]
    begin = np.flatnonzero(np.diff(at[:, 0], prepend=-1))
    union, out = UnionFind(), []
    for x, y in zip(begin.tolist(), np.append(begin[1:], len(at)).tolist()):
        a = int(at[x, 0])
        own = codes[ends[a] : ends[a + 1]]
        marked[own] = True
        for c in range(x, y, 1000):
            others = at[c : min(y, c + 1000), 1]
            n = sizes[others]
            where = np.repeat(ends[others] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            shared = np.add.reduceat(marked[codes[where]].astype(np.int64), np.cumsum(n) - n)
            for b in others[100 * shared >= round(100 * SIMILARITY) * (sizes[a] + n - shared)].tolist():
                if union.find(a) != union.find(b):
                    union.join(a, b)
                    out.append((int(ids[a]), int(ids[b])))
        marked[own] = False
    return out


def _near_pairs(rows: pa.Table, partners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, smaller and larger id of the near pairs of whole groups; a pair counts in the first band that it shares."""
    group, kind, rest, band, ids, comp, size = (rows.column(c).to_numpy() for c in ("group", "kind", "rest", "band", "doc_id", "component", "n_shingles"))
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), dtype=np.uint32).reshape(len(group), BANDS)
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(len(group), PLACES)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.append(begin[1:], len(group))
    found: list[np.ndarray] = []
    lefts, rights, pending = [], [], 0

    def compare() -> None:
        """The waiting pairs that are near enough, in their first shared band, likeliest first."""
        i, j = np.concatenate(lefts).astype(np.int64), np.concatenate(rights).astype(np.int64)
        wanted = (comp[i] != comp[j]) & (4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j]))
        i, j = i[wanted], j[wanted]
        for c in range(0, len(i), 20_000):
            x, y = i[c : c + 20_000], j[c : c + 20_000]
            agree = (sig[x] == sig[y]).mean(axis=1)
            near = (agree >= LIKELY) & ((marks[x] == marks[y]).argmax(axis=1) == band[x])
            found.append(np.column_stack([x[near], y[near], np.round(agree[near] * PLACES).astype(np.int64)]))

    for a, b in zip(begin.tolist(), end.tolist()):
        if b - a == 2:  # by far the most
            lefts.append([a])
            rights.append([a + 1])
            pending += 1
        else:
            own = a + np.flatnonzero(rest[a:b] == 1)
            others = own if kind[a] == 1 else a + np.flatnonzero(rest[a:b] == 0)
            i, j = np.repeat(own, len(others)), np.tile(others, len(own))
            if kind[a] == 1:
                i, j = i[i < j], j[i < j]
            lefts.append(i)
            rights.append(j)
            pending += len(i)
        if pending > 200_000:
            compare()
            lefts, rights, pending = [], [], 0
    if pending:
        compare()
    i, j, agree = np.concatenate([np.zeros((0, 3), dtype=np.int64), *found]).T
    if len(i) > partners:
        order = np.lexsort((ids[j], -agree, i))
        i, j = i[order], j[order]
        new = np.concatenate([[True], i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        i, j = i[rank < partners], j[rank < partners]
    return group[i], np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _representative_components(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id, component of the class representatives that are linked with another one."""
    keyed = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("pivot")).filter("n > 1"), "buckets")
    members = written(keyed.join(buckets, "key").select("key", "band", "doc_id", "pivot"), "members")
    sets = written(_full_sets(docs, members.select("doc_id").distinct()), "sets")
    tested = written(members.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    edges = written(confirmed(tested, sets), "edges")
    found = written(connected(edges), "components")
    # one partner first, so that large groups merge early; the last round then compares all pairs that are left
    for partners in (*PARTNERS, ALL_PARTNERS):
        placed = members.select("key", "band", "doc_id").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        # stored, as plans that hold it several times over cost the driver more than the work itself
        mixed_up = written(_mixed_buckets(placed), "mixed")
        if mixed_up.isEmpty():
            break
        open_members = placed.join(mixed_up, "key").join(reps.select("doc_id", "marks", "sig", "n_shingles"), "doc_id")
        if partners < ALL_PARTNERS:
            # a pair already compared was no link, so it is not compared again
            fresh = written(_further_pairs(open_members, partners).join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.union(fresh)
            more = confirmed(fresh, sets)
        else:
            more = _linked_in_blocks(open_members, sets)
        more = written(more, "edges")
        if not more.isEmpty():
            edges = edges.union(more)
            found = written(connected(edges), "components")
    return found


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    signed = written(signatures(docs), "signatures")
    filled = signed.filter("doc_id is not null and n_shingles > 0")
    classes = filled.groupBy("whole_a", "whole_b").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    reps = filled.select("doc_id", "n_shingles", "bands", "marks", "sig").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # stored, so that the wide rows are shuffled once, not by every step that reads them
    reps = written(reps.dropDuplicates(["doc_id"]), "reps")
    linked = written(_representative_components(docs, reps), "linked")
    named = classes.join(linked.select(F.col("doc_id").alias("rep"), "component"), "rep", "left").select("whole_a", "whole_b", F.coalesce("component", "rep").alias("class"))
    rows = signed.select("doc_id", "n_shingles", "whole_a", "whole_b")
    out = rows.join(named, ["whole_a", "whole_b"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class")).cast("long")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component; all columns stay."""
    dropped = written(components(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["__gone"], "left_anti")


def sql() -> str:
    """Exact links and components over ``documents`` in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= {round(100 * SIMILARITY)} * (x.n + y.n - p.both)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
