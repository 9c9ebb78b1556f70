"""Vector codes and embedding near duplicates against brute force."""

import hashlib
import math

import numpy as np
import pytest

from barline.llm import codes, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n_links long, kept boolean"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, k, "x", 7, False) for i, v, k in rows], SCHEMA).repartition(parts)


def kept_rows(rows):
    fine = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected_codes(rows, parts=4, entries=256, rounds=4):
    fine = kept_rows(rows)
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in fine]
    w = len(whole[0]) // parts
    books = [[v[k * w : (k + 1) * w] for v in whole[:entries]] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for v in whole:
                members.setdefault(nearest(v[k * w : (k + 1) * w], books[k])[1], []).append(v[k * w : (k + 1) * w])
            books[k] = [[sum(c) // len(c) for c in zip(*members[e])] if e in members else old for e, old in enumerate(books[k])]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(fine, whole):
        near = [nearest(v[k * w : (k + 1) * w], books[k]) for k in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), label))
    total = {}
    for _, _, error, label in out:
        total[label] = total.get(label, 0) + error
    return sorted([(i, code, error, total[label], sha) for i, code, error, label in out], key=str)


def random_vectors(n, width, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.5, (12, width))
    return [[float(x) for x in np.float32(centres[rng.integers(12)] + rng.normal(0, 0.02, width))] for _ in range(n)]


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "CHUNK", 60)
    vectors = random_vectors(400, 8)
    rows = [(3 * i + 5, v, i % 4 if i % 9 else None) for i, v in enumerate(vectors)]
    rows += [(1, vectors[0], 2)] * 30 + [(2, None, 1), (4, [None] * 8, 1), (6, [math.nan] + [0.0] * 7, 0), (7, [math.inf] * 8, 0), (8, [0.0] * 8, 3), (None, vectors[5], 1)]
    got = codes.digest(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    rows = [(5, [0.1, -0.1, 0.3, 0.3], 1), (5, [0.1, -0.1, 0.3, 0.3], 1), (9, [0.2, 0.0, -0.001, 1.0], None)]
    assert sorted([tuple(r) for r in codes.digest(frame(spark, rows)).collect()], key=str) == expected_codes(rows)
    assert codes.digest(frame(spark, [])).collect() == []
    other = [*rows, (11, [1.0], 1), (12, [], 1)]
    assert {r["vec_id"] for r in codes.digest(frame(spark, other)).collect()} == {5, 9}
    with pytest.raises(Exception, match="cannot be coded exactly"):
        codes.digest(frame(spark, [(1, [3e6] * 4, 1)])).collect()


def test_whole_subtrees_are_assigned_by_the_triangle_inequality():
    rng = np.random.default_rng(1)
    points = np.unique(np.concatenate([c + rng.integers(-6, 7, (300, 4)) for c in rng.integers(-900, 900, (6, 4))]), axis=0)
    order, end, radius, parent, depth = codes.cover_tree(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    for node in range(len(points)):
        inside = points[order[node : end[node]]]
        assert math.isclose(radius[node], np.sqrt(((inside - points[order[node]]) ** 2).sum(axis=1)).max(), abs_tol=1e-9)
        if node:
            assert parent[node] < node < end[parent[node]] and depth[node] == depth[parent[node]] + 1
    compared = []
    exact = codes.squares
    weights = np.ones(len(points), dtype=np.int32)
    tree = (points[order].astype(np.int32), weights, end, radius, parent, depth, order)
    book = points[rng.choice(len(points), 8, replace=False)]
    try:
        codes.squares = lambda p, b: compared.append(len(p)) or exact(p, b)
        code, sums, counts = codes.walked(tree, book)
    finally:
        codes.squares = exact
    expected = exact(points[order], book).argmin(axis=1)
    assert (code == expected).all() and sum(compared) < 0.8 * len(points)
    assert all((sums[e] == points[order][expected == e].sum(axis=0)).all() and counts[e] == (expected == e).sum() for e in range(8))


def test_squares_are_exact_beyond_double_precision():
    p = np.array([[(1 << 28) - 1, -(1 << 28) + 1]])
    b = np.array([[-(1 << 28) + 1, (1 << 28) - 1], [0, 1]])
    assert codes.squares(p, b).tolist() == [[2 * (2 * ((1 << 28) - 1)) ** 2, ((1 << 28) - 1) ** 2 + (1 << 28) ** 2]]


def expected_links(rows, least=0.9):
    fine = [i for i, (key, v, _) in enumerate(rows) if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(fine):
        for b in fine[n + 1 :]:
            x, y = ([float(np.float32(t)) for t in rows[k][1]] for k in (a, b))
            if len(x) == len(y) and sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) >= least:
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b), key=lambda k: rows[k][0])] = min(root(a), root(b), key=lambda k: rows[k][0])
    out = []
    for i, (key, _, _) in enumerate(rows):
        low = None if key is None else rows[root(i)][0]
        out.append((key, links[i], low, key is None or key == low))
    return sorted(out, key=str)


def groups_of_copies(seed=4, width=16):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=width) for _ in range(150)]
    for k, (members, noise) in enumerate([(2, 0.02), (3, 0.3), (60, 0.03), (40, 0.28), (2, 0.35)] * 3):
        centre = rng.normal(size=width)
        out += [(centre + rng.normal(0, noise, width)) * 10 ** rng.uniform(-3, 3) for _ in range(members)]
    out += [out[0]] * 25 + [out[7] * 2.0] * 2
    order = rng.permutation(len(out))
    return [(int(i) * 2 + 1, [float(x) for x in np.float32(out[k])], 1) for i, k in enumerate(order)]


@pytest.mark.parametrize("size", [10_000, 90])
def test_embedding_links_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hnsw, "shard_size", lambda rows: size)
    monkeypatch.setattr(hnsw, "CHUNK", 64)
    rows = groups_of_copies()
    rows += [(2, None, 1), (4, [], 1), (6, [0.0] * 16, 1), (8, [None, 1.0], 1), (10, [math.nan] * 16, 0), (12, [-math.inf] + [1.0] * 15, 0), (None, rows[0][1], 0)]
    rows += [(14, [1.0, 2.0], 1), (16, [2.0, 4.0], 1), (18, [-1.0, -2.0], 1), (20, [0.0, -0.0, 1.0], 1), (22, [-0.0, 0.0, 1.0], 1), (24, [3e38, 1e38], 1), (26, [1e-38, 2e-38], 1)]
    got = hnsw.near_duplicates(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected_links(rows)


def test_embedding_links_of_repeated_ids_and_no_rows(spark):
    assert hnsw.near_duplicates(frame(spark, [])).collect() == []
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    assert sorted(tuple(r) for r in hnsw.near_duplicates(frame(spark, rows)).collect()) == [(3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True)]


def test_graph_finds_neighbours_and_widens_its_beam():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 24))
    near = base[:700] + rng.normal(0, 0.4, (700, 24))
    order, sizes = hnsw.Graph.order(np.arange(2200))
    units = hnsw.unit(np.concatenate([base, near])[order])
    graph = hnsw.Graph.built(units, sizes)
    assert sizes[0] == 2200 and len(sizes) > 1 and (graph.layers[0] < 2200).all()
    truth = units @ units.T >= 0.85
    got = np.zeros_like(truth)
    for rows, nodes in graph.audited(0.85, 1).found(units, 0.85):
        got[rows, nodes] = True
    assert (got & truth).sum() >= 0.99 * truth.sum() and graph.beam >= hnsw.FIRST_BEAM
    broken = hnsw.Graph(units, [np.where(rng.random(layer.shape) < 0.8, -1, layer) for layer in graph.layers])
    assert broken.audited(0.85, 1).beam > hnsw.FIRST_BEAM
