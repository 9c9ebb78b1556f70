import random
import re

import numpy as np
import pyarrow as pa

from barline.llm.text import pieces, windows, within, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\xa0é\x85\x1cz") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None, " ", "a", "x" * 5000]
    w = words_of(pa.array(texts))
    got = [bytes(w.data[s:e]).decode() for s, e in zip(w.starts, w.ends)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    prints = dict()
    for word, f in zip(got, w.fingerprints().tolist()):
        assert prints.setdefault(word, f) == f
    assert len(set(prints.values())) == len(prints)


def test_lower_fingerprints_fold_ascii_only():
    w = words_of(pa.array(["Ab aB É é"]))
    f = w.fingerprints(lower=True)
    assert f[0] == f[1] and f[2] != f[3]


def test_windows_stay_in_their_text():
    w = words_of(pa.array(["a b c", "b c", "", "a b c d"]))
    f = w.fingerprints()
    grams, ok = windows(f, 2), within(w.offsets, 2)
    assert ok.tolist() == [True, True, False, True, False, True, True, True]
    assert grams[1] == grams[3] == grams[6] and grams[0] == grams[5]
    assert len(windows(f, 20)) == 0 and len(within(w.offsets, 20)) == 0


def test_pieces_keep_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": ["x" * n for n in (0, 5, 50, 3, 3, 3, 90, 0, 1)]})
    parts = list(pieces(iter([batch]), limit=20))
    assert len(parts) > 3 and np.concatenate([p.column(0) for p in parts]).tolist() == list(range(9))
