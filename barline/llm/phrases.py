"""Phrase collocation mining by direct-address tiling.

A phrase is two to five words that follow each other inside a piece of a text; everything is counted per language.

1. Texts are cut once into words; a word is a 64-bit fingerprint.  Each batch is stored as one row per language:
   its distinct fingerprints and a small code per word, with a zero between pieces.  Words are counted beside it.
2. Symbols (at first the words) that are frequent are ranked by frequency.  The ``HEAD`` most frequent ones of all
   languages get dense ranks; a pair of ranks addresses a cell of a ``SIDE`` x ``SIDE`` tile.  Tiles that many pairs
   of a batch fall into are counted with a dense bincount, the others as sorted coordinates.  Pairs with a symbol
   past the head are counted by their fingerprints.
3. Tiles travel as coordinate steps and counts and are added up per (language, tile); beyond ``FAN`` map tasks in
   two steps, so that one group never takes a part from every task.
4. Frequent pairs become the symbols of the next level and are ranked anew: two phrases of m words that overlap in
   all but their ends are one of m + 1.  A phrase is frequent only if both its halves are, so nothing is missed.
5. Counts of all leading and closing parts come along by joins on the frequent phrases only, and scores are exact
   decimals.

What tasks get from the driver is bounded at every size: the head's fingerprints and a set of ``2**BITSET`` bits
that holds every frequent symbol; a symbol that is let through by chance is dropped by its final count.

Cases: a NULL text is empty, a NULL language is ``und``; empty tables give no rows; repeated rows and repeated ids count
every time; very long texts are one piece for the word positions and are counted whole; other columns are
ignored; ties are broken by frequency and phrase.  Different words or phrases with one fingerprint would be
counted together (5e-20 for any two; below 1e-3 for a million frequent symbols among 10 thousand million others).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.stage import batches_of, folder, spare_memory, written
from barline.llm.substrings import packed, places, steps, unpacked
from barline.llm.text import Words, mixed, pieces, words_of

LONGEST, LEAST, TOP = 5, 100, 2000
#: Ranked symbols over all languages, side of a tile (a power of two), bits of the set of frequent symbols.
HEAD, SIDE_BITS, BITSET = 1 << 17, 10, 25
SIDE = 1 << SIDE_BITS
#: Pairs of a batch from which a tile is counted densely, dense tiles and loose pairs that a task holds.
DENSE, TILES, LOOSE = 1 << 14, 8, 2 << 20
#: Distinct words that a task holds, map tasks whose tiles are added up in one step, and blobs that travel at once.
WORDS, FAN, BLOBS = 100_000, 64, 16

_CUTS = np.zeros(256, dtype=bool)
_CUTS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAPS = _CUTS.copy()
_GAPS[[9, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two symbols, never zero."""
    return np.maximum(mixed(a * STEP + mixed(b)), np.uint64(1))


def split(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words between gaps and cuts, and whether a word is followed by another one of its piece."""
    w = words_of(column)
    data, bounds = w.data, w.text_ends
    inside = ~_GAPS[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    w = Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))
    cuts = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(_CUTS[data], out=cuts[1:])
    goes_on = np.zeros(len(starts), dtype=bool)
    if len(starts):
        goes_on[:-1] = cuts[ends[:-1]] == cuts[starts[1:]]
        last = w.offsets[1:] - 1
        goes_on[last[w.counts > 0]] = False
    return w, goes_on


def _stored(symbols: np.ndarray) -> bytes:
    """Symbols as distinct ones and codes; runs of zeros become one."""
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    distinct, codes = np.unique(symbols[keep], return_inverse=True)
    return packed(distinct, codes.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32))


_WORD_ROWS = "kind int, lang string, data binary, fp long, word string, n long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) -> stored symbols (kind 0) and word counts (kind 1)."""
    schema = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("data", pa.binary()), ("fp", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
    known: dict[tuple[str, int], list] = {}

    def counts() -> pa.RecordBatch:
        n = len(known)
        langs, prints = zip(*known)
        words, sums = zip(*known.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.array(langs, pa.string()), pa.nulls(n, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)),
             pa.array(words, pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())], schema=schema)

    for batch in pieces(batches):
        w, goes_on = split(batch.column(1))
        prints = np.maximum(w.fingerprints(lower=True), np.uint64(1))
        langs = batch.column(0).dictionary_encode()
        of_word = np.repeat(np.asarray(langs.indices), w.counts)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(of_word == k)
            if not len(mine):
                continue
            distinct, first, n = np.unique(prints[mine], return_index=True, return_counts=True)
            for fp, at, count in zip(distinct.tolist(), mine[first].tolist(), n.tolist()):
                if entry := known.get((lang, fp)):
                    entry[1] += count
                else:
                    known[lang, fp] = [w.data[w.starts[at] : w.ends[at]].tobytes().lower(), count]
            # a zero after every word that no other one of its piece follows
            ends_piece = ~goes_on[mine]
            symbols = np.zeros(len(mine) + int(ends_piece.sum()), dtype=np.uint64)
            symbols[np.arange(len(mine)) + np.cumsum(ends_piece) - ends_piece] = prints[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([lang]), pa.array([_stored(symbols)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], schema=schema)
        if len(known) > WORDS:
            yield counts()
            known.clear()
    if known:
        yield counts()
    known.clear()
    spare_memory()


class Frequent:
    """The frequent symbols of a level: dense ranks per language for the head, a set of bits for all."""

    def __init__(self, heads: dict[str, np.ndarray], bits: np.ndarray) -> None:
        self.bits = bits
        self.by_rank = heads
        self.sorted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, prints in heads.items():
            order = np.argsort(prints)
            self.sorted[lang] = prints[order], order.astype(np.int32)

    @classmethod
    def of(cls, symbols: DataFrame) -> Frequent:
        """From ``symbols`` (lang, fp, n); both results are bounded, whatever their number."""
        head = symbols.select("lang", "fp", "n").orderBy(F.desc("n"), "lang", "fp").limit(HEAD).toArrow()
        prints, langs = head.column("fp").to_numpy().view(np.uint64), np.array(head.column("lang").to_pylist(), dtype=object)
        place = F.col("fp").bitwiseAND(F.lit((1 << BITSET) - 1))
        cells = symbols.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, CAST(fp & 63 AS INT))").alias("bit"))
        found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(1 << (BITSET - 6), dtype=np.uint64)
        bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls({lang: prints[langs == lang] for lang in sorted(set(langs.tolist()))}, bits)

    def holds(self, symbols: np.ndarray) -> np.ndarray:
        place = symbols & np.uint64((1 << BITSET) - 1)
        return ((self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool) & (symbols != 0)

    def ranks(self, lang: str, symbols: np.ndarray) -> np.ndarray:
        """Rank of each symbol, -1 past the head."""
        if lang not in self.sorted:
            return np.full(len(symbols), -1, dtype=np.int32)
        prints, order = self.sorted[lang]
        at = np.minimum(np.searchsorted(prints, symbols), len(prints) - 1)
        return np.where(prints[at] == symbols, order[at], -1).astype(np.int32)


class Tiles:
    """Pair counts of a task."""

    def __init__(self) -> None:
        self.dense: dict[tuple[str, int], np.ndarray] = {}
        self.loose: dict[str, list[np.ndarray]] = {}
        self.pending = 0

    def add(self, lang: str, a: np.ndarray, b: np.ndarray) -> None:
        a, b = a.astype(np.int64), b.astype(np.int64)
        across = HEAD // SIDE + 1
        tile = (a >> SIDE_BITS) * across + (b >> SIDE_BITS)
        cell = (a & (SIDE - 1)) << SIDE_BITS | (b & (SIDE - 1))
        loose = np.ones(len(a), dtype=bool)
        hits = np.bincount(tile)
        full = set(np.flatnonzero(hits >= DENSE).tolist()) | {t for name, t in self.dense if name == lang and t < len(hits) and hits[t]}
        for t in full:
            mine = tile == t
            counts = np.bincount(cell[mine], minlength=SIDE * SIDE).astype(np.int32)
            have = self.dense.get((lang, t))
            self.dense[lang, t] = counts if have is None else have + counts
            loose &= ~mine
        if loose.any():
            self.loose.setdefault(lang, []).append(tile[loose] << 2 * SIDE_BITS | cell[loose])
            self.pending += int(loose.sum())

    def full(self) -> bool:
        return self.pending > LOOSE or len(self.dense) > TILES

    def rows(self) -> list[tuple[str, int, bytes]]:
        """(lang, tile, cells and counts) of everything counted so far, which is forgotten."""
        out = []
        for (lang, tile), counts in self.dense.items():
            cells = np.flatnonzero(counts)
            out.append((lang, tile, _cells(cells, counts[cells])))
        for lang, parts in self.loose.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            tile = keys >> 2 * SIDE_BITS
            for t, a, b in zip(*_runs(tile)):
                out.append((lang, int(t), _cells(keys[a:b] & (SIDE * SIDE - 1), counts[a:b])))
        self.dense, self.loose, self.pending = {}, {}, 0
        return out


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, begin and end of the runs of equal numbers."""
    begin = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, dtype=np.int64)
    return ascending[begin], begin, np.append(begin[1:], len(ascending))


def _cells(cells: np.ndarray, counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    return packed(steps(cells), counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64))


_PAIR_ROWS = "kind int, lang string, tile long, data binary, a long, b long, fp long, n long"


def _pairs(frequent: Frequent, relabel: bool, keep: bool):
    """Stored symbols -> tiles (kind 1), loose counts of pairs past the head (kind 2), and the relabelled symbols (kind 0).

    With ``relabel`` the symbols are pairs of the stored ones, as far as they are frequent.
    """
    schema = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("tile", pa.int64()), ("data", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])

    def blobs(kind: int, rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        langs, tiles, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(langs, pa.string()), pa.array(tiles, pa.int64()), pa.array(data, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(4))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                distinct, codes = unpacked(data.as_py())
                if relabel:
                    symbols = distinct[codes]
                    new = paired(symbols[:-1], symbols[1:])
                    new[(symbols[:-1] == 0) | (symbols[1:] == 0) | ~frequent.holds(new)] = 0
                    if keep and new.any():
                        yield blobs(0, [(lang, -1, _stored(new))])
                    distinct, codes = np.unique(new, return_inverse=True)
                fine, rank = frequent.holds(distinct), frequent.ranks(lang, distinct)
                left, right = codes[:-1], codes[1:]
                valid = fine[left] & fine[right]
                left, right = left[valid], right[valid]
                ranked = (rank[left] >= 0) & (rank[right] >= 0)
                if ranked.any():
                    tiles.add(lang, rank[left[ranked]], rank[right[ranked]])
                if not ranked.all():
                    keys, n = np.unique(left[~ranked].astype(np.int64) * len(distinct) + right[~ranked], return_counts=True)
                    a, b = distinct[keys // len(distinct)], distinct[keys % len(distinct)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), 2, np.int32)), pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), -1)), pa.nulls(len(n), pa.binary()),
                         *(pa.array(x.view(np.int64)) for x in (a, b, paired(a, b))), pa.array(n.astype(np.int64))], schema=schema)
                if tiles.full():
                    yield blobs(1, tiles.rows())
        if rows := tiles.rows():
            yield blobs(1, rows)
        del rows
        spare_memory()

    return run


def _added(frequent: Frequent | None, least: int):
    """Parts in (lang, tile, ...) order -> one part a group, or with ``frequent`` its pairs from ``least`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE * SIDE, dtype=np.int64)
        key = None

        def solved(key: tuple) -> pa.RecordBatch | None:
            lang, tile = key[:2]
            if frequent is None:
                cells = np.flatnonzero(total)
                out = pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([tile], pa.int64()), pa.array([_cells(cells, total[cells])], pa.binary())], ["lang", "tile", "data"])
            else:
                cells = np.flatnonzero(total >= least)
                across = HEAD // SIDE + 1
                prints = frequent.by_rank[lang]
                a, b = prints[(tile // across << SIDE_BITS) + (cells >> SIDE_BITS)], prints[(tile % across << SIDE_BITS) + (cells & (SIDE - 1))]
                out = pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), *(pa.array(x.view(np.int64)) for x in (a, b, paired(a, b))), pa.array(total[cells])], ["lang", "a", "b", "fp", "n"])
            total[:] = 0
            return out

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1))))
            for new, data in zip(keys, batch.column(batch.num_columns - 1)):
                if key is not None and new != key:
                    yield solved(key)
                key = new
                gaps, counts = unpacked(data.as_py())
                total[places(gaps)] += counts
        if key is not None:
            yield solved(key)
        spare_memory()

    return run


def _by_kind(df: DataFrame, name: str) -> tuple[str, SparkSession]:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy("kind").parquet(path)
    return path, df.sparkSession


def _of_kind(stored: tuple[str, SparkSession], schema: str, kind: int) -> DataFrame:
    path, spark = stored
    return spark.read.schema(schema).parquet(path).filter(F.col("kind") == kind).drop("kind")


def _level(symbols: DataFrame, frequent: Frequent, relabel: bool, keep: bool, least: int) -> tuple[DataFrame, DataFrame]:
    """Frequent pairs (lang, a, b, fp, n) of neighbouring symbols, and the symbols of this level as they are stored."""
    counted = symbols.select("lang", "data").mapInArrow(_pairs(frequent, relabel, keep), _PAIR_ROWS).withColumn("task", F.floor(F.spark_partition_id() / FAN).cast("int"))
    tasks = symbols.rdd.getNumPartitions()
    stored = _by_kind(counted, "pairs")
    schema = _PAIR_ROWS + ", task int"
    parts = _of_kind(stored, schema, 1).select("lang", "tile", "task", "data")
    if tasks > FAN:
        step = parts.repartition("lang", "tile", "task").sortWithinPartitions("lang", "tile", "task")
        parts = step.mapInArrow(_added(None, least), "lang string, tile long, data binary")
    ordered = parts.select("lang", "tile", "data").repartition(F.col("lang"), F.col("tile")).sortWithinPartitions("lang", "tile")
    tiled = ordered.mapInArrow(_added(frequent, least), "lang string, a long, b long, fp long, n long")
    loose = _of_kind(stored, schema, 2).groupBy("lang", "a", "b", "fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return written(tiled.unionByName(loose), "frequent"), _of_kind(stored, schema, 0).select("lang", "data") if keep else symbols


def mined(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, words (array), a, n, l, r, score and dropped of every candidate phrase of ``docs`` (lang, text)."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    stored = _by_kind(rows.mapInArrow(_tokens, _WORD_ROWS), "tokens")
    symbols = _of_kind(stored, _WORD_ROWS, 0).select("lang", "data")
    counts = written(_of_kind(stored, _WORD_ROWS, 1).groupBy("lang", "fp").agg(F.sum("n").alias("n"), F.min("word").alias("word")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    empty = F.array().cast("array<long>")
    known = counts.filter(F.col("n") >= least).select("lang", "fp", "n", F.array("word").alias("words"), empty.alias("firsts"), empty.alias("lasts"))
    levels, parents = [], []
    for size in range(2, longest + 1):
        frequent = Frequent.of(known)
        # the symbols stored last are one level back, but for the words
        with batches_of(docs.sparkSession, BLOBS):
            found, symbols = _level(symbols, frequent, size > 2, 2 < size < longest, least)
        head = known.select("lang", F.col("fp").alias("a"), F.col("n").alias("na"), "words", "firsts")
        tail = known.select("lang", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("words").alias("wb"), "lasts")
        known = written(
            found.join(head, ["lang", "a"]).join(tail, ["lang", "b"]).select(
                "lang", "a", "b", "fp", "n", F.concat("words", F.array(F.element_at("wb", -1))).alias("words"),
                F.concat("firsts", F.array("na")).alias("firsts"), F.concat("lasts", F.array("nb")).alias("lasts"),
            ),
            "phrases",
        )
        levels.append(known)
        parents += [known.select("lang", F.col(half).alias("fp"), "n") for half in ("a", "b")]
    phrases, longer = levels[0], parents[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    for side in parents[1:]:
        longer = longer.unionByName(side)
    # a longer phrase is never more frequent, so only one as frequent drops a phrase; one word more is enough to look at
    marked = phrases.join(longer.distinct().withColumn("dropped", F.lit(True)), ["lang", "fp", "n"], "left")
    scored = marked.join(totals, "lang").withColumn("cut", F.array_min(_cuts()))
    return scored.select(
        "lang", "words", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"), F.coalesce("dropped", F.lit(False)).alias("dropped"),
    )


def _cuts() -> Column:
    """Score, place and part counts of every cut, in exact decimals of 38 digits."""

    def wide(x: Column) -> Column:
        return x.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        left, right = F.element_at("firsts", k), F.element_at("lasts", F.size("lasts") + 1 - k)
        score = F.call_function("div", wide(F.col("n") * 1000) * wide(F.col("total")), wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.transform(F.sequence(F.lit(1), F.size("firsts")), cut)


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    from pyspark.sql import Window

    kept = mined(docs).filter("not dropped").withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the limit is pushed below the shuffle: a task sends its own best rows of a language only
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    """The same phrases over ``documents`` in SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS MATERIALIZED (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS words FROM w, range(1, {LONGEST + 1}) AS sizes(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, words, len(words) AS m, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, words, m, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.words, c.m, c.a, k, x.a AS l, y.a AS r, total.n AS n, 1000 * c.a * total.n // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.words = c.words[1:k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1:] JOIN total ON total.lang = c.lang),
least_cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM scored) WHERE place = 1),
inner_phrases AS MATERIALIZED (
  SELECT lang, words[i:i + s - 1] AS words, a FROM f, range(2, {LONGEST}) AS sizes(s), range(1, {LONGEST}) AS starts(i) WHERE s < m AND i + s - 1 <= m),
kept AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM least_cut c
  WHERE NOT EXISTS (SELECT 1 FROM inner_phrases p WHERE p.lang = c.lang AND p.words = c.words AND 100 * p.a >= 100 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {TOP}"""
