"""Operators that judge or transform rows one by one."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barline.llm import chat, html_text, quality, secrets, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts_equal_the_library(spark, documents, prose):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    odd = ["<|endoftext|>", " ", "  ", "\n", "\t", "'ll", "é", "漢", "😀", "\xa0", "1", "a", "B", "!", "\U00032b1a", "٣"]
    texts = [prose(50), None, "", " ", "a" * 3000, "<|endoftext|>", *("".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(200))]
    got = tokens.token_counts(documents(list(enumerate(texts))), spark, path, limit=30).orderBy("doc_id").collect()
    library = Tokenizer.from_file(path)
    for text, row in zip(texts, got):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 30), text


def test_heap_merges_as_the_naive_loop():
    ranks = tokens.load_merges(["a b", "b c", "ab c", "c c", "abc abc", "a a"])
    rng = random.Random(6)

    def naive(text):
        parts = list(text)
        while True:
            pairs = [(ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] << 32 | parts[i + 1]) in ranks]
            if not pairs:
                return len(parts)
            rank, i = min(pairs)
            parts[i : i + 2] = [256 + rank]

    for _ in range(500):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        assert tokens.merged_length(text, ranks) == naive(text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies here and there.</div>
<article class="post"><h1>A &amp; title</h1><p><b>First   part<br>of it.<p>Second&nbsp;part with a <a href='x>y'>link</a> inside.</p>
<form><label>Mail</label><input name=q></form><div class=ad>Buy this thing now</div><div id="comments"><p>A comment of a reader that is rather long and has no link.</p></div></article>
<aside>Related</aside><footer>&copy; someone</footer></body></html>"""


def test_main_text_of_a_page(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", "<p>" + "long text of a page without any frame " * 3, 0), (4, "u", "<script>x", 0), (1, "u", PAGE, 0)],
        "page_id long, url string, html string, text int",
    )
    got = {(r.page_id, i): r for i, r in enumerate(html_text.extracted(pages).collect())}
    want = "A & title\nFirst part of it.\nSecond part with a link inside."
    assert got[(1, 0)].text == got[(1, 5)].text == want and got[(1, 0)].n_chars == len(want)
    assert got[(2, 1)].text == got[(3, 2)].text == got[(4, 4)].text == "" and got[(2, 1)].n_chars == 0
    assert got[(None, 3)].text == " ".join(["long text of a page without any frame"] * 3)
    assert html_text.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><meta charset=utf-8><body><article>{}</article></body></html>",
    "<html><head><title>T</title><body><article>{}</article><header>Top</header></body></html>",
    "<html><head class='no-sidebar'><script>a = '<body>'</script></head><body><article>{}</article></body></html>",
    "<body><div><button>Menu</div><article>{}</article><button>Go</button></body>",
    "<body><button>Menu<article>{}</article></body>",
    "<body class='has-sidebar'><article>{}</article></body>",
    "<body class='page sidebar'><main id='print'>{}</main></body>",
    "<body><article class='post comments-open'>{}</article></body>",
    "<body><div class='content no-sidebar'>{}</div><div class='comments'><p>A reader</p></div></body>",
    "<body><article><p class='ad'>Buy now{}</article></body>",
    "<body><article><p class='ad'>Buy now<hr>{}</article></body>",
    "<body><article><ul><li class='ad'>x<li>{}</ul></article></body>",
    "<body><article><table><tr><td class='ad'>x<td>{}</table></article></body>",
    "<body><article><dl><dt class='ad'>x<dd>{}</dl></article></body>",
    "<body><form action='/'><nav><a href='/'>Home</a></nav><article>{}</article></form></body>",
    "<body><form action='/'><nav><a href='/'>Home</a></nav><div>{0}</div><div>{0}</div></form></body>",
    "<body><div class='print'><article>{}</article></div></body>",
    "<body><div class='skip-nav-offset'><article>{}</article></div></body>",
    "<body><article>{0}<section class='related-work'>{0}</section></article></body>",
    "<body><article>{}<div class='related'><p>Read more of this</p></div></article></body>",
    "<body><article>{}</article><form><p>Write to us if you have something to say about it</p></form></body>",
    "<body><article>{}</article><div class='comments'><article class='comment'>" + "A reader writes this. " * 60 + "</article></div></body>",
])
def test_main_text_of_legal_pages(page):
    text = " ".join(["some words of an article"] * 8)
    got = html_text.main_text(page.format(f"<p>{text}</p>"), html_text.fitted())
    assert got == "\n".join([text] * (2 if "{0}" in page else 1))


@pytest.mark.parametrize("page, want", [
    ("<article><p>a &am<b>p;</b> b &lt;i&gt; c</p></article>", "a &amp; b <i> c"),
    ("<article><p>&amp;amp; one</p><p>two&#160;&#x41;</p></article>", "&amp; one\ntwo A"),
    ("<body><div class='cookie-banner'><div class='content'>We use cookies here.</div></div></body>", ""),
    ("<body><div class='ad'><div class='content'>Buy</div></div><article><p>Text of it.</p></article></body>", "Text of it."),
    ("<article><p>One.</p><p class='share'><a href=x>Share</a><a href=y>Send</a></article>", "One."),
])
def test_main_text_of_small_pages(page, want):
    assert html_text.main_text(page, html_text.fitted()) == want


def test_tree_fits_its_table():
    tree = html_text.fitted()
    assert tree.feature >= 0
    assert tree.decide((30, 0.0, 9, 0.0, 50, 0.0, 0, 1, 1, 0)) and not tree.decide((30, 0.0, 9, 0.0, 50, 0.0, 1, 1, 1, 0))


def test_escapes_are_reversible():
    codec = chat.Codec(chat.INSTRUCT)
    rng = random.Random(7)
    atoms = codec.template.controls + list("<>[]/\\\\s ") + ["INST", "SYS", "ROLE"]
    for _ in range(5000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 12)))
        assert codec.unescape(codec.escape(text)) == text
        assert not any(c in codec.escape(text) for c in codec.template.controls)
        role = rng.choice(["user", "assistant", "system", "", text])
        assert codec.read("".join(s for s, _ in codec.segments(role, text))) == (role, text)


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yo </s>\n"), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (3, 5, None, "x"), (3, None, "tool", "é"),
            (None, 0, "user", "n"), (None, 1, "assistant", "m" * 9000)]
    frame = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, segments boolean")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(frame)).collect()}
    order = {1: rows[0:3], 2: rows[3:5], 3: [rows[6], rows[5]], None: rows[7:9]}
    for conv, turns in order.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and got[None].valid and not got[2].valid and got[2].bad_turn == 0 and not got[3].valid
    assert chat.conversation_digests(chat.formatted_turns(frame.limit(0))).count() == 0


def expected_spans(text):
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_rules_and_novelty(spark, documents, prose):
    rng = random.Random(8)
    atoms = ["password", "PASSWD", "Secret", "toKen", "api_key", "apikey", '"', "'", " ", "=", ":", "abcDEF123456", "short", "AKIA", "AKIAABCDEFGHIJ12", "0123456789abcdef" * 2, "ſecret", "é", "\n"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    odd = prose(60) + " the bearer is Zk9xQ2mPl4Tr8Vb1Wy7u then " + prose(60)
    plain = prose(200) + " token of user_name_of_example_2 and access key getElementById"
    texts += [None, "", odd, plain, odd, "token " + "x1" * 60000]
    got = secrets.scan(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        want = expected_spans(text or "")
        assert row.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
    at = odd.index("Zk9x")
    assert got[202].spans == got[204].spans == f"novel:{at}:{at + 20}" and got[203].spans == ""
    clean = secrets.redacted(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert clean[202].text == odd.replace("Zk9xQ2mPl4Tr8Vb1Wy7u", "[REDACTED]") and clean[203].text == plain and clean[200].text is None
    assert secrets.scan(documents([(1, "a")]).limit(0)).count() == 0


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_rules(spark, documents, prose):
    rng = random.Random(9)
    texts = [prose(rng.randint(55, 300)).replace(" ", "\n", rng.randint(0, 4)) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(120).split()) for _ in range(5)]
    odd = [None, "", " \n ", "é" * 70, "a b c " * 40, "l1 x\nl1 x\n \n \nl1 x", prose(60), "w " * 49, "\x85\xa0 a\x0bb"]
    rows = [(i, t, "en" if i % 9 else None, "s") for i, t in enumerate(texts + junk + odd)] + [(1000 + i, prose(100), "de", None) for i in range(10)]
    got = {r.doc_id: r for r in quality.judged(documents(rows)).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_statistics(text), i
    assert all(got[i].kept for i in range(150)) and not any(got[150 + i].kept for i in range(5)) and all(got[1000 + i].kept for i in range(10))
    assert quality.judged(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("case", ["small source", "rare languages", "small rest"])
def test_rows_of_small_groups_are_judged(documents, prose, case):
    rng = random.Random(4)

    def text(bad):
        words = prose(rng.randint(60, 300)).split()
        return " ".join(w + rng.choice(["***", "$$$", "###"]) for w in words) if bad else " ".join(words)

    if case == "small source":  # its language has enough rows
        groups = [("en", f"s{i % 2}", False) for i in range(160)] + [("en", "junk", True)] * 30
    elif case == "rare languages":  # none has enough rows, together they have
        groups = [(f"l{i % 4}", "s", i % 20 == 0) for i in range(160)]
    else:  # all rare languages together have too few rows
        groups = [("en", "s", False)] * 150 + [("en", None, False)] * 70 + [(None, "s", i < 3) for i in range(10)] + [("de", None, i < 3) for i in range(10)]
    rows = [(i, text(bad), lang, source) for i, (lang, source, bad) in enumerate(groups)]
    got = {r.doc_id: r for r in quality.judged(documents(rows)).collect()}
    assert [got[i].kept for i in range(len(rows))] == [not bad for *_, bad in groups]
    assert all(r.outlyingness is not None and not r.base_failed for r in got.values())


def test_determinant_estimate_ignores_outliers(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    good, bad = rng.normal(0, 1, (2000, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 2]]), rng.normal(9, 0.3, (400, 3))
    frame = spark.createDataFrame([("g", x.tolist()) for x in np.vstack([good, bad])], "grp string, x array<double>")
    row = quality.mcd(frame, (1e-3,) * 3).first()
    assert np.allclose(row["mean"], good.mean(axis=0), atol=0.15)
    # the core holds nine tenths of the good rows instead of three quarters, so the scale is up to half too wide
    ratio = np.linalg.eigvals(np.array(row["inverse"]).reshape(3, 3) @ np.cov(good.T)).real
    assert (ratio > 0.6).all() and (ratio < 1.2).all()


def test_determinant_estimate_is_the_least_of_all_cores(spark):
    """Groups small enough to try every core of three quarters of their rows."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(8)
    groups = {f"g{k}": np.vstack([rng.normal(0, 1, (9, 2)) @ [[1, 0.7], [0, 0.6]], rng.normal(6 + k, 0.4, (3, 2))]) for k in range(4)}
    # a third of the rows far off along one axis: quartile ranges alone start wide
    groups["wide"] = np.vstack([rng.normal(0, [0.3, 2.0], (9, 2)), rng.normal([8, 0], [0.1, 4.0], (3, 2))])
    rows = [(g, x.tolist()) for g, xs in groups.items() for x in xs]
    got = {r["grp"]: r for r in quality.mcd(spark.createDataFrame(rows, "grp string, x array<double>"), (1e-3,) * 2).collect()}
    scale = quality.core_scale(quality.CORE, 2)
    for g, xs in groups.items():
        least = min(np.linalg.slogdet(np.cov(xs[list(core)].T, bias=True) * scale)[1] for core in itertools.combinations(range(12), 9))
        assert abs(got[g]["logdet"] - least) < 1e-3, g
        assert np.isclose(-np.linalg.slogdet(np.array(got[g]["inverse"]).reshape(2, 2))[1], got[g]["logdet"])


def test_cores_of_large_groups_are_exact(spark):
    """Sketched cuts were off by some ranks, so determinants of large groups crept down until the last allowed step."""
    import numpy as np

    rng = np.random.default_rng(5)
    # the last group has ties where its core ends
    groups = {"a": rng.normal(0, 1, (60_000, 2)) @ [[1, 0.7], [0, 0.6]], "b": rng.normal(3, 2, (40_000, 2)), "tied": np.round(rng.normal(0, 1, (30_000, 2)), 1)}
    params = [(g, start, [0.1, 0.0], [1.0, 0.2, 0.2, 1.5]) for g in groups for start in ("one",)] + [("b", "two", [2.9, 3.0], [0.3, 0.0, 0.0, 0.3])]
    stats = spark.createDataFrame([(g, x.tolist()) for g, xs in groups.items() for x in xs], "grp string, x array<double>").repartition(7)
    got = quality._core_sums(stats, spark.createDataFrame(params, "grp string, start string, mean array<double>, inverse array<double>"), 2).collect()
    assert len(got) == 4
    for row in got:
        xs = groups[row["grp"]]
        mean, inverse = next((np.array(m), np.array(i).reshape(2, 2)) for g, s, m, i in params if (g, s) == (row["grp"], row["start"]))
        far = np.einsum("ij,jk,ik->i", xs - mean, inverse, xs - mean)
        core = xs[far <= np.sort(far)[len(xs) * 3 // 4 - 1] + 1e-12]
        assert row["n"] == len(core)
        assert np.allclose(row["first"], core.sum(axis=0)) and np.allclose(row["second"], (core.T @ core).ravel())


def test_determinant_estimate_of_rows_without_spread(spark):
    """Equal rows have no direction from their median; one feature that repeats another leaves the matrix regular."""
    rows = [("same", [1.0, 2.0])] * 70 + [("line", [float(i), 2.0 * i]) for i in range(70)]
    got = {r["grp"]: r for r in quality.mcd(spark.createDataFrame(rows, "grp string, x array<double>"), (0.1, 0.1)).collect()}
    assert set(got) == {"same", "line"} and got["same"]["mean"] == [1.0, 2.0]
    assert all(v == v for r in got.values() for v in r["inverse"])


def test_many_secrets_in_one_text_take_linear_time():
    import time

    text = " ".join(f"token={i:08d}abcd and secret note Zx9{i:05d}QwErTy77Lm" for i in range(20_000))
    start = time.process_time()
    rules = secrets.rule_spans(text)
    secrets.novel_spans(text, rules, secrets.Novelty())
    assert len(rules) == 20_000 and time.process_time() - start < 60


def test_texts_that_stay_in_the_jvm_hold_no_span(spark):
    texts = ["plain words", "", None, "a tOKen: abcdefgh12345678", "AKIAABCDEFGHIJKL", "x" + "0123456789abcdef" * 2, "akiaabcdefghijkl", "0123456789ABCDEF" * 3, "Bearer Zx9q27QwErTy77LmPp", "my to\u212aen=abcdefgh123"]
    held = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.col("text").rlike(secrets.MAY_HOLD).alias("may")).collect()
    novelty = secrets.Novelty()
    for row in held:
        rules = secrets.rule_spans(row.text or "")
        assert row.may or not (rules or secrets.novel_spans(row.text or "", rules, novelty))
    assert sum(bool(r.may) for r in held) == 4


def test_machine_equals_its_sql(spark, tmp_path):
    """Every order of up to three roles, known and unknown, against the SQL twin."""
    import itertools

    import duckdb

    from barline.llm import queries

    orders = [o for n in (1, 2, 3) for o in itertools.product(["system", "user", "assistant", "tool", None], repeat=n)]
    rows = [(i, turn, role, f"t{turn}") for i, order in enumerate(orders) for turn, role in enumerate(order)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op7_chat_turns(spark, str(tmp_path))
    names = got.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({chat.sql()})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda r: r[0]) and len(want) == len(orders) + 1
    assert sum(r[names.index("valid")] for r in want) == 7
