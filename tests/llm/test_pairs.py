"""Near duplicates and substring dedup against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from barline.llm import minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def expected_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in text.split())


def test_components_equal_brute_force(documents, prose, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rows, n = [], 0
    for group in range(12):
        base = prose(60 + 20 * group)
        for k in range(5):
            # from clear copies to pairs around the threshold; chains too
            rows.append((n, base if k == 0 else changed(base, 0.02 * k, n)))
            n += 1
        rows.append((n, base.upper()))
        n += 1
    chain = prose(120)
    for _ in range(6):
        rows.append((n, chain))
        chain = changed(chain, 0.03, n)
        n += 1
    shared = prose(80)
    for _ in range(25):  # a passage that many hold, below the threshold
        rows.append((n, shared + " " + prose(45)))
        n += 1
    rows += [(n, "one two"), (n + 1, "One TWO"), (n + 2, ""), (n + 3, None), (n + 4, "  "), (n + 5, ""), (n + 6, "É un"), (n + 7, "é un"), (0, rows[0][1]), (None, rows[1][1])]
    got = minhash.components(documents(rows)).collect()
    assert len(got) == len(rows)
    want = expected_components(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and r.kept
    kept = minhash.deduplicated(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([i for i in want if want[i][1] == i] + [0])


def test_large_group_of_copies_and_empty_table(spark, documents, prose):
    base = prose(40)
    rows = [(i, base) for i in range(300)] + [(300 + i, prose(40, seed=1000 + i)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.components(documents(rows)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[300 + i] == 300 + i for i in range(20))
    assert minhash.components(documents(rows).limit(0)).count() == 0


def test_signatures_estimate_without_bias():
    rng = np.random.default_rng(4)
    errors = []
    for n in (5, 40, 900):
        for _ in range(20):
            u = rng.integers(0, 1 << 63, 5 * n // 4 + 1, dtype=np.uint64)
            a, b = np.unique(u[:n]), np.unique(u[len(u) - n :])
            s = minhash.superminhash([a, b, np.zeros(0, dtype=np.uint64)])
            assert np.isfinite(s[:2]).all() and np.isinf(s[2]).all()
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


def test_pair_at_the_threshold_reaches_the_full_sets():
    """Chance that too few of its places agree, if they are independent; unequal places share a byte once in 256."""
    n, p = minhash.PLACES, minhash.SIMILARITY + (1 - minhash.SIMILARITY) / 256
    few = math.ceil(minhash.LIKELY * n - 1e-9)
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(few)) < 1e-6


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_equals_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    union = minhash.UnionFind()
    for a, b in edges:
        union.join(a, b)
    got = {r.doc_id: r.component for r in minhash.connected(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: union.find(x) for x in list(union.up)}


def expected_removal(rows, depth=20):
    words = [(r[0] if r[0] is not None else 1 << 62, WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - depth + 1):
            name = tuple(w[p : p + depth])
            first[name] = min(first.get(name, (i, p)), (i, p))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - depth + 1):
            if first[tuple(w[p : p + depth])] != (i, p):
                gone |= set(range(p, p + depth))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("group, batch", [(4_000_000, 16 << 20), (60, 700)])
def test_repeats_equal_brute_force(documents, prose, monkeypatch, group, batch):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    passage, copy = prose(55), prose(90)
    rows = [(i, f"{prose(i % 40)} {passage} {prose(7)}") for i in range(30)]
    rows += [(100 + i, copy) for i in range(6)]
    rows += [(200, "again " * 100), (201, prose(3) + " " + "again " * 25), (202, " ".join([copy, copy])), (203, ""), (204, None), (205, prose(19)), (206, passage[:-1] + "\n" + prose(20))]
    rows += [(5, rows[5][1]), (None, passage), (None, passage), (207, prose(3000))]
    random.Random(3).shuffle(rows)
    got = substrings.without_repeats(documents(rows).repartition(4)).collect()
    want = sorted(zip([r[0] if r[0] is not None else -1 for r in rows], expected_removal(rows)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.n_words, r.n_removed, r.kept_sha256)) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty_table_has_no_repeats(documents):
    assert substrings.without_repeats(documents([(1, "a")]).limit(0)).count() == 0


def test_steps_of_near_duplicates_read_stored_tables(spark, documents, prose, monkeypatch):
    """Plans that hold the members and the classes several times over had up to 11 joins, and cost the driver its memory."""
    words = prose(100).split()
    texts = [" ".join("other" if k and i in range(9 + k, 100, 25) else w for i, w in enumerate(words)) for k in range(4)]
    joins = []

    def seen(df, name):
        joins.append((df._jdf.queryExecution().optimizedPlan().toString().count("Join "), name))
        return written(df, name)

    written = minhash.written
    monkeypatch.setattr(minhash, "written", seen)
    rows = minhash.components(documents(list(enumerate(texts)))).collect()
    assert {"pairs", "near"} <= {name for _, name in joins}
    assert max(joins)[0] <= 4, joins
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(i, i) for i in range(4)]


def test_blocks_send_a_spanning_forest_of_their_links():
    rng = np.random.default_rng(2)
    sets = {int(i): np.unique(rng.integers(0, 60, rng.integers(1, 60))) for i in rng.choice(1000, 60, replace=False)}
    for i in list(sets)[:20]:
        sets[i + 5000] = sets[i][1:] if len(sets[i]) > 1 else sets[i]
    ids = sorted(sets)
    pairs = np.array([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]])
    linked = {(a, b) for a, b in pairs.tolist() if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    found = minhash._spanning(pairs, sets)
    assert set(found) <= linked
    one, two = minhash.UnionFind(), minhash.UnionFind()
    for a, b in linked:
        one.join(a, b)
    for a, b in found:
        assert two.find(a) != two.find(b)
        two.join(a, b)
    assert all(one.find(i) == two.find(i) for i in ids) and len(linked) >= 20
