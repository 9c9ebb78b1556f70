"""Quality rules and robust multivariate outliers.

Base statistics follow fixed rules.  The method fits a minimum-covariance-determinant estimate
per language and source to transformed statistic vectors by concentration steps: keep the ``CORE``
share of rows with the smallest distances, take their mean and covariance, repeat.  Several deterministic
starts (``STARTS``) take ``SCREEN`` steps each; the one of the least determinant goes on until the determinant
of no group falls further.  Every step is two grouped aggregates with partial sums; the cut of a core is exact, and
only the sums at the few distances around it are put in order, so a group's rows never meet in one task; only group estimates (a few dozen numbers) are
handled in Python.  Rows whose scaled Mahalanobis distance exceeds the cutoff are rejected.

Cases: NULL and empty texts have zero words and fail the base rule; NULL language or source is
a group of its own; sources under ``LEAST_ROWS`` rows are estimated together per language; where those
stay under it too, they are judged by the estimate of all rows of their language, languages under it are
estimated all together, and if these stay under it they are judged by the estimate of the whole table; only
a table under ``LEAST_ROWS`` rows has no estimate and is judged by the base rules alone; repeated rows count
as often as they occur; features that do not vary get a floor under their variance; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.stage import written
from barline.llm.text import pieces, windows, within, words_of

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50

#: Share of a group's rows that the estimate rests on; up to the rest may be outliers.
CORE = 0.75
#: Starts of the concentration steps: medians and quartile ranges; medians and the covariance of the directions
#: from there (all rows on a unit sphere, so that no far row counts more); mean and covariance of all rows.
STARTS = ("quartiles", "directions", "all rows")
#: Steps of every start, and most steps of the best; fewer once the logarithm of no determinant falls by more than ``STILL``.
SCREEN = 2
STEPS = 10
STILL = 1e-6
#: Accuracy of the sketch that brackets the cut of a core; the cut itself is exact.
SKETCH = 5000
LEAST_ROWS = 60
#: Chance of a normal row to be rejected.
CHANCE = 3e-6

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
#: Least standard deviation of each feature.
FLOORS = (0.7, 0.5, 0.5, 0.35, 0.08, 0.04, 0.06)

_UPPER, _MARK, _LETTER = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_MARK[[33, 63, 124, 126, 94, 95, 61, 43, 64, 91, 93, 123, 125]] = True
_FOLLOW = np.zeros(256, dtype=bool)
_FOLLOW[128:192] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[ends])


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found at least twice in it."""
    n = len(words)
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    grams = windows(words, size)
    if not len(grams):
        return out
    text = np.repeat(np.arange(len(out)), np.diff(offsets))
    ok = within(offsets, size)
    marked = np.zeros(n, dtype=bool)
    places = np.flatnonzero(ok)
    # a window's fingerprint and its text in one number: equal numbers are repeats within a text
    keys = grams[places] ^ (text[places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(places), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = places[order[twice]]
    for step in range(size):
        marked[at + step] = True
    return np.bincount(text[marked], minlength=len(out)).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and the transformed vector ``x`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            column = batch.column(3)
            w = words_of(column)
            n = w.counts
            letters = _sums(_LETTER[w.data], w.text_ends)
            in_words = np.zeros(len(w.data) + 1, dtype=np.int64)
            np.cumsum(~_FOLLOW[w.data], out=in_words[1:])
            lengths = np.concatenate([[0], np.cumsum(in_words[w.ends] - in_words[w.starts])])
            chars = np.diff(lengths[w.offsets])
            symbols = _sums(_SYMBOL[w.data], w.text_ends)
            raw = [w.data[a:b].tobytes() for a, b in zip(w.text_ends[:-1], w.text_ends[1:])]
            dups = np.array([duplicate_lines(t) for t in raw], dtype=np.int64)
            lines = np.array([t.count(b"\n") + 1 for t in raw], dtype=np.int64)
            repeats = repeated_words(w.fingerprints(), w.offsets)
            per = np.maximum(chars, 1)
            x = np.column_stack([
                np.log1p(n), chars / np.maximum(n, 1), np.log1p(100 * symbols / per), np.log1p(10 * dups / np.maximum(lines, 1)), repeats / np.maximum(n, 1),
                np.sqrt(_sums(_UPPER[w.data], w.text_ends) / np.maximum(letters, 1)), np.sqrt(_sums(_MARK[w.data], w.text_ends) / per),
            ])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(v, pa.int64()) for v in (n, chars, symbols, dups, repeats)), vectors],
                ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return base.mapInArrow(
        run, f"doc_id {key}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"
    ).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_quantile(p: float) -> float:
    """Bisection on the error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(-mid / math.sqrt(2)) / 2 < p else (low, mid)
    return low


def chi2_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty approximation."""
    return d * (1 - 2 / (9 * d) + normal_quantile(p) * math.sqrt(2 / (9 * d))) ** 3


def core_scale(share: float, d: int) -> float:
    """Factor that makes the covariance of the ``share`` most central normal rows consistent."""
    cut = chi2_quantile(share, d)
    z = ((cut / (d + 2)) ** (1 / 3) - (1 - 2 / (9 * (d + 2)))) / math.sqrt(2 / (9 * (d + 2)))
    return share / (math.erfc(-z / math.sqrt(2)) / 2)


def grouped(stats: DataFrame) -> DataFrame:
    """Adds ``grp``, the group whose estimate judges the row, and ``fits``, the groups that the row is part of.

    ``grp`` is the language and source, or a wider group where rows are few; it is NULL only in a table
    without ``LEAST_ROWS`` rows.
    """
    sizes = stats.groupBy("lang", "source").count()
    langs = sizes.groupBy("lang").agg(F.sum("count").alias("rows"), F.sum(F.when(F.col("count") < LEAST_ROWS, F.col("count")).otherwise(0)).alias("few"))
    total = langs.agg(F.sum("rows").alias("rows"), F.sum(F.when(F.col("rows") < LEAST_ROWS, F.col("rows"))).alias("rest")).first()
    rows, rest = total["rows"] or 0, total["rest"] or 0
    by_table = 0 < rest < LEAST_ROWS <= rows

    def name(kind: str, *columns: str) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("of"), *columns))

    wide = F.when(F.col("few").between(1, LEAST_ROWS - 1) & (F.col("rows") >= LEAST_ROWS), name("language", "s.lang"))
    names = sizes.alias("s").join(langs.alias("r"), F.expr("s.lang <=> r.lang"), "left").select(
        "s.lang", "s.source",
        F.when(F.col("count") >= LEAST_ROWS, name("source", "s.lang", "s.source"))
        .when(F.col("few") >= LEAST_ROWS, name("small sources", "s.lang"))
        .when(F.col("rows") >= LEAST_ROWS, name("language", "s.lang"))
        .otherwise(F.lit("rest" if rest >= LEAST_ROWS else "table" if by_table else None).cast("string")).alias("grp"),
        wide.alias("wide"),
    )
    fits = F.array_distinct(F.array_compact(F.array("grp", "wide", F.lit("table" if by_table else None).cast("string"))))
    joined = stats.alias("d").join(names.alias("n"), F.expr("d.lang <=> n.lang and d.source <=> n.source"), "left")
    return joined.select("d.*", "grp", fits.alias("fits"))


def distance(x: Column, mean: Column, inverse: Column, d: int) -> Column:
    """Squared Mahalanobis distance, written out so that it is one generated expression."""
    diff = [x[i] - mean[i] for i in range(d)]
    total = None
    for i in range(d):
        row = None
        for j in range(d):
            term = inverse[i * d + j] * diff[j]
            row = term if row is None else row + term
        total = diff[i] * row if total is None else total + diff[i] * row
    return total


def _sums_by(rows: DataFrame, keys: list[str], vector: Column, d: int) -> DataFrame:
    """n, first and second moments of ``vector`` by ``keys``."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(vector[i]) for i in range(d)]).alias("first"),
        F.array(*[F.sum(vector[min(i, j)] * vector[max(i, j)]) for i in range(d) for j in range(d)]).alias("second"),
    )


_PARAMS = "grp string, start string, mean array<double>, inverse array<double>, logdet double"


def _estimates(sums: DataFrame, floors: tuple[float, ...], scale: float) -> DataFrame:
    """Mean, inverse covariance and the logarithm of its determinant, of each group and start from its sums.

    ``at`` and ``unit`` (the center and the scales of the rows that were summed) are NULL for plain rows.
    """
    d = len(floors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                mean = np.asarray(row["first"], dtype=float) / row["n"]
                second = np.asarray(row["second"], dtype=float).reshape(d, d) / row["n"]
                if row["unit"] is None:
                    cov = (second - np.outer(mean, mean)) * scale
                else:
                    unit = np.asarray(row["unit"], dtype=float)
                    mean, cov = np.asarray(row["at"], dtype=float), second * np.outer(unit, unit) * d
                # a floor on every standard deviation, added where the core varies less
                # and a trace everywhere, as one feature may follow from others
                cov = cov + np.diag(np.maximum(0.0, np.square(floors) - np.diag(cov)) + 1e-6 * np.square(floors))
                out.append((row["grp"], row["start"], mean, np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame(out, columns=["grp", "start", "mean", "inverse", "logdet"])

    return sums.mapInPandas(run, _PARAMS)


def _starts(stats: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """grp, start, mean, inverse, logdet before the first step."""
    d = len(floors)
    quartiles = [F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000) for i in range(d)]
    start = stats.groupBy("grp").agg(*[q.alias(f"q{i}") for i, q in enumerate(quartiles)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(d)]
    start = written(start.select("grp", F.array(*[F.col(f"q{i}")[1] for i in range(d)]).alias("at"), F.array(*spread).alias("unit")), "mcd-start")
    unit = F.col("unit")
    diagonal = start.select(
        "grp", F.lit(STARTS[0]).alias("start"), F.col("at").alias("mean"),
        F.array(*[1 / (unit[i] * unit[i]) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("inverse"),
        F.lit(float("inf")).alias("logdet"),
    )
    scaled = stats.join(start, "grp").select("grp", F.array(*[(F.col("x")[i] - F.col("at")[i]) / F.col("unit")[i] for i in range(d)]).alias("y"))
    length = F.sqrt(F.aggregate("y", F.lit(0.0), lambda total, v: total + v * v))
    far = scaled.withColumn("length", length).where("length > 0").select("grp", F.transform("y", lambda v: v / F.col("length")).alias("y"))
    directions = _sums_by(far, ["grp"], F.col("y"), d).join(start, "grp").withColumn("start", F.lit(STARTS[1]))
    none = F.lit(None).cast("array<double>")
    plain = _sums_by(stats, ["grp"], F.col("x"), d).withColumns({"at": none, "unit": none, "start": F.lit(STARTS[2])})
    return diagonal.unionByName(_estimates(directions.unionByName(plain), floors, 1.0).withColumn("logdet", F.lit(float("inf"))))


def _distances(stats: DataFrame, params: DataFrame, d: int) -> DataFrame:
    """grp, x, far (the squared distance) and the columns of ``params``: one row a start, as many copies of a row as there are starts."""
    by_group = params.groupBy("grp").agg(F.collect_list(F.struct(*[c for c in params.columns if c != "grp"])).alias("all"))
    rows = stats.join(by_group, "grp").select("grp", "x", F.explode("all").alias("p"))
    return rows.select("grp", "x", "p.*", distance(F.col("x"), F.col("p.mean"), F.col("p.inverse"), d).alias("far"))


def _core_sums(stats: DataFrame, params: DataFrame, d: int) -> DataFrame:
    """n, first and second moments of the ``CORE`` share of rows with the smallest distances, by group and start.

    The share is exact (and all rows that tie with its last one), as a cut that is off by a few ranks would lower the
    determinant again and again.  A sketch brackets the cut; rows under the bracket are summed as one and those inside,
    at most 6 of ``SKETCH``, by their distance, so that only these sums are put in order.
    """
    sides = [F.lit(CORE - 2 / SKETCH), F.lit(CORE + 2 / SKETCH)]
    sketch = _distances(stats, params, d).groupBy("grp", "start").agg(F.percentile_approx("far", F.array(*sides), SKETCH).alias("sides"), F.count(F.lit(1)).alias("rows"))
    bracket = params.select("grp", "start", "mean", "inverse").join(written(sketch, "cut"), ["grp", "start"])
    near = _distances(stats, bracket, d).filter(F.col("far") <= F.col("sides")[1])
    inside = near.withColumn("place", F.when(F.col("far") > F.col("sides")[0], F.col("far")))
    sums = _sums_by(inside, ["grp", "start", "rows", "place"], F.col("x"), d)
    before = F.sum("n").over(Window.partitionBy("grp", "start").orderBy(F.asc_nulls_first("place")).rowsBetween(Window.unboundedPreceding, -1))
    core = sums.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < F.ceil(F.lit(CORE) * F.col("rows")))
    return core.groupBy("grp", "start").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("first")[i]) for i in range(d)]).alias("first"),
        F.array(*[F.sum(F.col("second")[i]) for i in range(d * d)]).alias("second"),
    )


def mcd(stats: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """grp, start, mean, inverse, logdet of every group of ``stats`` (columns grp, x): the start of the least determinant."""
    d = len(floors)
    none = F.lit(None).cast("array<double>")
    params = written(_starts(stats, floors), "mcd")
    for step in range(STEPS):
        sums = _core_sums(stats, params, d).withColumns({"at": none, "unit": none})
        after = written(_estimates(sums, floors, core_scale(CORE, d)), f"mcd{step}")
        # a step that does not lower the determinant is not taken
        old = params.select("grp", "start", F.struct("mean", "inverse", "logdet").alias("old"))
        both = after.join(old, ["grp", "start"])
        moved = both.filter(F.col("logdet") < F.col("old.logdet") - STILL)
        better = F.col("logdet") < F.col("old.logdet")
        params = written(
            both.select("grp", "start", *[F.when(better, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in ("mean", "inverse", "logdet")]), "mcd"
        )
        if step + 1 == SCREEN:
            best = params.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("p"))
            params = written(best.select("grp", "p.*"), "mcd")
        elif step >= SCREEN and moved.isEmpty():
            break
    return params


def judged(docs: DataFrame) -> DataFrame:
    """Base statistics, the squared distance ``outlyingness`` and the verdict ``kept`` of every row."""
    # stored before the groups are named: both the group sizes and the rows are read from it
    stats = written(grouped(written(statistics(docs), "statistics")), "quality")
    params = mcd(stats.select(F.explode("fits").alias("grp"), "x")).select("grp", "mean", "inverse")
    d = len(FLOORS)
    cutoff = chi2_quantile(1 - CHANCE, d)
    out = stats.join(params, "grp", "left").withColumn("outlyingness", distance(F.col("x"), F.col("mean"), F.col("inverse"), d))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("outlyingness", F.lit(0.0)) <= cutoff)).alias("kept"), F.round("outlyingness", 6).alias("outlyingness"),
    )
