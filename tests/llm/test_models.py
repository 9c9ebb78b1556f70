"""Operators with fitted models, mixing and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import decontaminate, mixing, toxicity


def labelled(prose, n=240):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randint(10, 200)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(["grubsnak", "Vilefex!", "oafdrop"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_rows_are_rejected(spark, documents, prose):
    rows, labels = labelled(prose)
    rows += [(1000, None), (1001, ""), (None, "grubsnak grubsnak vilefex oafdrop"), (3, rows[3][1]), (1002, prose(9000))]
    docs = documents(rows)
    # only the first half is labelled; the second half is held out
    table = spark.createDataFrame(labels[:120] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    assert (np.diff(model.cuts) > 0).all()
    got = toxicity.scored(docs, model).collect()
    truth = {i for i, bad in labels if bad} | {None}
    assert {r.doc_id for r in got if r.rejected} == truth and len(got) == len(rows)
    mild, harsh = toxicity.scored(documents([(1, prose(30) + " oafdrop"), (2, "grubsnak vilefex oafdrop " * 4)]), model).orderBy("doc_id").collect()
    assert 0 < mild.severity < harsh.severity <= 3
    assert toxicity.scored(docs, model).columns == [*docs.columns, "severity", "p_toxic", "rejected"]
    nothing = toxicity.fit(docs, table.limit(0))
    assert toxicity.scored(docs, nothing).agg(F.max("severity"), F.max("rejected")).first() == (0.0, False)
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_cumulative_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    latent = x @ np.array([1.5, -0.7]) + rng.logistic(size=400)
    grades = np.digitize(latent, [0.0, 1.0, 2.5])
    model = toxicity.fit_cumulative(x, grades, ["a", "b"], steps=3000)
    assert np.allclose(model.weights, [1.5, -0.7], atol=0.35) and np.allclose(model.cuts, [0.0, 1.0, 2.5], atol=0.4)


def test_rake_reaches_targets(spark, documents, prose):
    rng = random.Random(4)
    rows = [(i, prose(rng.choice([20, 100, 400])), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += [(500, None, "en", "a"), (501, "", "de", "b"), (None, prose(30), "en", "b"), (7, rows[7][1], rows[7][2], rows[7][3])]
    docs = documents(rows)
    out = mixing.mixed(docs).cache()
    assert out.count() == len(rows)
    weighed = F.sum(F.col("n_tokens") * F.col("mix_weight"))
    for m, values in (("source", F.coalesce("source", F.lit(""))), ("lang", F.coalesce("lang", F.lit(""))), ("topic", F.col("topic"))):
        table = out.groupBy(values.alias("v")).agg(weighed.alias("w"), F.sum("n_tokens").alias("t")).collect()
        want = {r.v: r.t ** mixing.ALPHA[m] for r in table}
        for r in table:
            assert r.w / sum(x.w for x in table) == pytest.approx(want[r.v] / sum(want.values()), abs=2e-3)
    expected = out.agg(F.sum(F.col("n_tokens") * F.col("probability")) / F.sum("n_tokens")).first()[0]
    assert expected == pytest.approx(mixing.RATE, abs=0.01)
    fixed = {m: spark.createDataFrame([(v, 1.0) for v in vs], "value string, target double") for m, vs in (("source", ["a", "b", "none"]), ("lang", ["en", "de"]), ("topic", ["brief", "note", "article"]))}
    chosen = mixing.mixed(docs, fixed)
    assert chosen.filter("lang is null or source is null").agg(F.max("probability")).first()[0] == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert [c for c in out.columns if c in docs.columns and c != "kept"] == [c for c in docs.columns if c != "kept"]


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_common_subsequence_equals_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == slow_subsequence(a, b)


def test_benchmark_items_are_found(spark, documents, prose):
    items = [(i, prose(12 + 3 * i, seed=100 + i) + f" answer{i} rare{i}x only{i}y") for i in range(15)] + [(90, None), (91, ""), (None, prose(20, seed=999) + " qqq zzz")]
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(150):
        text = prose(rng.randint(0, 300))
        if i % 3 == 0:
            item = items[i // 3 % 15]
            words = item[1].split()
            if i % 2:  # a paraphrase: some words other, case and punctuation changed
                for k in rng.sample(range(len(words) - 3), len(words) // 8):
                    words[k] = "other"
                words = [w.capitalize() + "," for w in words]
            text = f"{text} {' '.join(words)} {prose(rng.randint(0, 50))}"
            truth[i] = item[0]
        rows.append((i, text))
    rows += [(500, None), (501, ""), (None, prose(50)), (0, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    got = decontaminate.judged(docs, benchmark).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.item_id for r in got if r.contaminated}
    missed = {i: (truth[i], dict(rows)[i][-900:], dict(items)[truth[i]]) for i in truth if found.get(i) != truth[i]}
    assert not missed and found == truth
    assert decontaminate.judged(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.judged(docs.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminated(docs, benchmark).columns == docs.columns


def test_search_finds_what_a_brute_force_search_finds(spark, documents, prose):
    """Short items and items with a quarter of their words replaced, at random places of longer texts."""
    rng = random.Random(8)
    items = [(i, prose(size, seed=300 + i)) for i, size in enumerate((4, 4, 6, 6, 8, 10, 10, 15, 20, 20, 30, 40))]
    rows = []
    for i in range(120):
        words, item = prose(rng.randint(100, 300)).split(), items[i % 12][1].split()
        if i % 2 and len(item) >= 15:
            for k in rng.sample(range(len(item)), len(item) // 4):
                item[k] = "other"
        at = rng.randrange(len(words))
        rows.append((i, " ".join(words[:at] + item + words[at:])))
    docs, benchmark = documents(rows), spark.createDataFrame(items, "item_id long, text string")
    codes = decontaminate.coded(docs, "doc_id")
    held = decontaminate.prepared(benchmark, decontaminate.fitted(codes))
    want = set()
    for row in codes.collect():
        words = np.frombuffer(row["codes"], dtype=np.uint16).tolist()
        for item, answer in zip((c.tolist() for c in held.codes), held.answers):
            for a in range(len(words)):
                window = words[a : a + len(item)]
                inside = set(window)
                if len(inside & set(item)) < decontaminate.OVERLAP * len(set(item)) or len(inside & answer) < decontaminate.ANSWER * len(answer):
                    continue
                if decontaminate.common_subsequence(item, window) >= decontaminate.SUBSEQUENCE * len(item):
                    want.add(row["doc_id"])
    got = {r.doc_id for r in decontaminate.judged(docs, benchmark).collect() if r.contaminated}
    assert len(want) > 80 and not want - got


def test_rows_are_judged_by_their_own_text(spark, documents, prose):
    item = prose(25, seed=5) + " gold silver bronze"
    rows = [(None, prose(60) + " " + item), (None, prose(60)), (7, item), (7, prose(80)), (7, item), (None, None), (8, "")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminated(documents(rows), benchmark).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted((rows[k] for k in (1, 3, 5, 6)), key=str)


def test_every_passage_counts_in_the_directions(spark, documents, prose, monkeypatch):
    codes = decontaminate.coded(documents([(i, prose(400)) for i in range(60)]), "doc_id").cache()
    whole = decontaminate.fitted(codes)
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 7)
    small = decontaminate.fitted(codes)
    np.testing.assert_array_equal(small.idf, whole.idf)
    a, b = whole.directions[:, :8], small.directions[:, :8]
    np.testing.assert_allclose(np.abs((a * b).sum(axis=0)), (a * a).sum(axis=0), rtol=1e-2)


def test_directions_of_a_sample_find_the_items(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 150)
    items = [(i, prose(30, seed=700 + i) + f" ask{i} tell{i}") for i in range(10)]
    rows = [(i, f"{prose(150)} {items[i % 10][1] if i % 2 else prose(30)} {prose(90)}") for i in range(120)]
    got = decontaminate.judged(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.contaminated} == {(i, i % 10) for i in range(120) if i % 2}


def test_mixing_keeps_columns_with_names_of_its_own(spark, prose):
    rows = [(i, prose(30 + i % 7 * 40), "en", f"s{i % 3}", ("sport", "news", None)[i % 3 if i % 5 else 0], i, 0.5, "yes", 2.5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, n_tokens long, probability double, kept string, repeat_weight double")
    out = mixing.mixed(docs)
    assert out.columns == [*[c for c in docs.columns if c != "topic"], "topic", "mixing_n_tokens", "mix_weight", "mixing_probability", "mixing_repeat_weight", "mixing_kept"]
    got = out.select(*docs.columns).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == rows
    # the margins of the input's own topics stand in the tempered shares
    sums = {r.t: r.w for r in out.groupBy(F.coalesce("topic", F.lit("")).alias("t")).agg(F.sum(F.col("mix_weight") * F.col("mixing_n_tokens")).alias("w")).collect()}
    tokens = {}
    for r in rows:
        tokens[r[4] or ""] = tokens.get(r[4] or "", 0) + len(r[1].split())
    share = {t: n ** mixing.ALPHA["topic"] for t, n in tokens.items()}
    assert all(abs(sums[t] / sum(sums.values()) - share[t] / sum(share.values())) < 0.01 for t in share)
    import corpus_pipeline

    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == [*docs.columns, "mixing_repeat_weight"] and 0 < mixed.count() < 60


def test_pipeline_stages(spark, tmp_path, prose):
    import corpus_pipeline

    rows, labels = labelled(prose, 120)
    item = prose(30, seed=77) + " answerword raretoken onlyhere"
    rows = [(i, t + " " + prose(60)) for i, t in rows]
    rows += [(200, rows[1][1]), (201, prose(40) + " " + item + " " + prose(40)), (202, prose(40) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(20)), (203, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.written(stage(spark, left, str(tmp_path)), name)
        ids.append({r.doc_id for r in left.collect()})
        assert left.columns[: len(docs.columns)] == docs.columns
    toxic = {i for i, bad in labels if bad}
    everything = {i for i, _ in rows}
    assert ids[0] == everything - toxic
    assert ids[1] == ids[0] - {200} and ids[2] == ids[1] - {201} and ids[3] == ids[2]
    assert 0 < len(ids[4]) < len(ids[3]) and ids[4] <= ids[3]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == ids[4]
    assert not final.filter("text like '%0123456789abcdef%'").count()
