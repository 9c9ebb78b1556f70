"""Phrase mining against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barline.llm import phrases


def expected(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    wanted = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inner = {}
    for (lang, words), a in wanted.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner[lang, words[i : i + m]] = max(inner.get((lang, words[i : i + m]), 0), a)
    out = {}
    for (lang, words), a in wanted.items():
        if inner.get((lang, words), 0) < a:
            cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def texts(seed=2, n=160):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "New", "york", "é", "Été", "z", " x", "aa", "b'", "w1", "w2", "w3", "ﬀ", "𝔘"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    gaps = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!?", ":", "\x0b"]
    out = []
    for k in range(n):
        parts = [str(w) + str(rng.choice(gaps)) for w in rng.choice(vocabulary, rng.integers(0, 60), p=weight / weight.sum())]
        text = "".join(parts) + (" one two three four five six seven" if k % 5 == 0 else "") + (" rare pair" if k % 7 == 0 else "")
        out.append((text, ["en", "de", None, "und", ""][k % 5 if k % 3 else 0]))
    out += [(None, "en"), ("", "en"), (" \t\n.,", None), ("the the the the the the the " * 40, "xx"), ("x" * 70_000 + " the of", "en"), (out[0][0], out[0][1]), (out[0][0], out[0][1])]
    return out


@pytest.mark.parametrize(("head", "dense", "loose", "words", "fan"), [(1 << 17, 1 << 14, 4 << 20, 200_000, 64), (6, 3, 40, 5, 1), (0, 1, 1, 1, 2)])
def test_phrases_equal_brute_force(spark, monkeypatch, head, dense, loose, words, fan):
    for name, value in {"HEAD": max(head, 1), "DENSE": dense, "LOOSE": loose, "WORDS": words, "FAN": fan, "SIDE_BITS": 10 if head > 6 else 2, "SIDE": 1024 if head > 6 else 4}.items():
        monkeypatch.setattr(phrases, name, value)
    rows = texts()
    df = spark.createDataFrame([(t, g, 3, "p", 0) for t, g in rows], "text string, lang string, a long, phrase string, kind int").repartition(5)
    mined = phrases.mined
    monkeypatch.setattr(phrases, "mined", lambda docs: mined(docs, least=6))
    got = sorted(tuple(r) for r in phrases.top_phrases(df, 25).collect())
    assert got == expected(rows, 6, 25)
    assert any(len(r[2].split()) == 5 for r in got) and {r[0] for r in got} >= {"en", "und", "xx"}


def test_stored_symbols_come_in_small_batches(spark, monkeypatch):
    pairs = phrases._pairs

    def checked(*args):
        run = pairs(*args)

        def small(batches):
            def each():
                for batch in batches:
                    assert batch.num_rows <= 3
                    yield batch

            return run(each())

        return small

    monkeypatch.setattr(phrases, "BLOBS", 3)
    monkeypatch.setattr(phrases, "_pairs", checked)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    # every language of a batch is stored as a row of its own
    df = spark.createDataFrame([("a b c " * 4, f"l{i}") for i in range(40)], "text string, lang string").coalesce(1)
    assert phrases.mined(df, least=4).select("lang").distinct().count() == 40
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_no_rows_and_nothing_frequent(spark):
    for rows in ([], [("a b c", "en")], [(None, None)]):
        assert phrases.top_phrases(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**14, 8 * 10**15, [9 * 10**14 + 1], [9 * 10**14 + 3])], "n long, total long, firsts array<long>, lasts array<long>")
    a, total, left, right = 9 * 10**14, 8 * 10**15, 9 * 10**14 + 1, 9 * 10**14 + 3
    row = df.select(phrases._cuts().alias("cuts")).first()["cuts"][0]
    assert (row["score"], row["k"], row["l"], row["r"]) == (1000 * a * total // (left * right), 1, left, right)


def test_words_and_pieces():
    w, goes_on = phrases.split(pa.array(["a b,c\nd", None, "", "e", " f  g. "]))
    assert [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert goes_on.tolist() == [True, False, False, False, False, True, False]
    assert w.offsets.tolist() == [0, 4, 4, 4, 5, 7]
