"""Exact quantiles of many columns without a value map or a sort of all cells.

``percentile`` keeps every distinct value of a group in one buffer.  Here tasks sort runs of rows column by column and
send evenly spaced values of each run; merged, these bracket every wanted order statistic.  A second pass counts what lies
below the brackets and sends only the values inside, equal ones as one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.columns import by_date, clip, div
from barline.sources.writers import staged

#: Rows that a task sorts at once, and the values it sends of each column of such a run.
RUN, SENT = 65_536, 1_024


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, str, int, np.ndarray]]:
    """(first row's keys, name of the group, column's place, its sorted values) for every run of rows and group in it.

    A batch has ``keys`` key columns, the group's name and the value columns.  NULL is left out, NaN is the largest.
    """
    held: list[pa.RecordBatch] = []

    def runs() -> Iterator[pa.Table]:
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN:
                yield pa.Table.from_batches(held)
                held.clear()
                rows = 0
        if rows:
            yield pa.Table.from_batches(held)

    for run in runs():
        names = np.asarray(run.column(keys).to_pylist(), dtype=object)
        groups = dict.fromkeys(names) if keys else [names[0]]
        for name in groups:
            at = np.flatnonzero(names == name) if len(groups) > 1 else None
            part = run if at is None else run.take(pa.array(at))
            for i, column in enumerate(part.columns[keys + 1 :]):
                values = np.sort(column.drop_null().to_numpy())
                if len(values):
                    yield part.select(list(range(keys))).slice(0, 1), name, i, values


def _sent(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of (key table, *further values) as one batch."""
    keys = len(out[0][0].columns)
    columns = [pa.chunked_array([c for row in out for c in row[0].column(k).chunks], type=schema.field(k).type).combine_chunks() for k in range(keys)]
    columns += [pa.array([row[n] for row in out], type=schema.field(keys + n - 1).type) for n in range(1, len(out[0]))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _bracket(values: np.ndarray, weights: np.ndarray, slack: int, first: int, last: int) -> tuple[float | None, float]:
    """(low, high): the order statistics of both ranks are above ``low`` (None: no bound) and not above ``high``.

    Each sent value stands for the ``weights`` values of its run up to it, so at least the summed weights and at most
    ``slack`` more values are not above it.
    """
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    ends = np.searchsorted(values, values, side="right") - 1
    upto = upto[ends]
    below = np.flatnonzero(upto + slack <= first)
    return (float(values[below[-1]]) if len(below) else None), float(values[np.searchsorted(upto, last + 1)])


def _ranks(probs: Sequence[float], n: int) -> list[tuple[int, int, float]]:
    places = [p * (n - 1) for p in probs]
    return [(int(np.floor(x)), int(np.ceil(x)), x - np.floor(x)) for x in places]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and column, ``q0``, ``q1``, ...

    Groups and columns without any value give no row.  ``df`` is read twice, at once;
    materialise it first when it is costly.  The driver gets two bounds per group, column and probability.
    """
    keys, columns, probs = list(keys), list(columns), list(probs)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = df.select(*keys, group.alias("__group"), *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    named = T.StructType([rows.schema[k] for k in keys] + [T.StructField("group", T.StringType()), T.StructField("i", T.IntegerType())])
    numbers = T.ArrayType(T.DoubleType())

    def arrow(schema: T.StructType) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    sketch = T.StructType(named.fields + [T.StructField("n", T.LongType()), T.StructField("step", T.LongType()), T.StructField("values", numbers)])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(sketch)
        for key, name, i, values in _sorted_runs(batches, len(keys)):
            step = -(-len(values) // SENT)
            at = np.unique(np.append(np.arange(step - 1, len(values), step), len(values) - 1))
            yield _sent([(key, name, i, len(values), step, values[at])], schema)

    def bracketed(part: pd.DataFrame) -> pd.DataFrame:
        weights = [np.diff(np.append(np.arange(0, n, step), n)) for n, step in zip(part["n"], part["step"])]
        values, weights = np.concatenate(part["values"].to_list()), np.concatenate(weights)
        found = [_bracket(values, weights, int((part["step"] - 1).sum()), first, last) for first, last, _ in _ranks(probs, int(part["n"].sum()))]
        return pd.DataFrame({"group": [part["group"].iloc[0]], "i": [part["i"].iloc[0]], "marks": [[x for pair in found for x in pair]]})

    parts = rows.mapInArrow(sketched, sketch).drop(*keys).groupBy("group", "i")
    marks = {(r["group"], r["i"]): r["marks"] for r in parts.applyInPandas(bracketed, "group string, i int, marks array<double>").collect()}

    inside = T.StructType(named.fields + [
        T.StructField("j", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("below", T.LongType()),
        T.StructField("values", numbers), T.StructField("counts", T.ArrayType(T.LongType())),
    ])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(inside)
        for key, name, i, values in _sorted_runs(batches, len(keys)):
            out = []
            for j in range(len(probs)):
                low, high = marks[name, i][2 * j : 2 * j + 2]
                below = 0 if low is None else int(np.searchsorted(values, low, side="right"))
                found, counts = np.unique(values[below : int(np.searchsorted(values, high, side="right"))], return_counts=True)
                out.append((key, name, i, j, len(values), below, found, counts))
            yield _sent(out, schema)

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        out = {k: [part[k].iloc[0]] for k in keys} | {"column": [columns[part["i"].iloc[0]]]}
        for j, own in part.groupby("j"):
            values, counts = np.concatenate(own["values"].to_list()), np.concatenate(own["counts"].to_list())
            order = np.argsort(values, kind="stable")
            upto = np.cumsum(counts[order]) + int(own["below"].sum())
            first, last, share = _ranks(probs, int(own["n"].sum()))[j]
            low, high = (values[order][np.searchsorted(upto, rank, side="right")] for rank in (first, last))
            out[f"q{j}"] = [low if first == last else low + (high - low) * share]
        return pd.DataFrame(out)

    result = T.StructType([*named.fields[: len(keys)], T.StructField("column", T.StringType()), *[T.StructField(f"q{j}", T.DoubleType()) for j in range(len(probs))]])
    # a few rows that several readers would otherwise work out again
    return staged(rows.mapInArrow(within, inside).groupBy("group", "i").applyInPandas(solved, result))


def widen(stats: DataFrame, columns: Sequence[str], values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group with ``column__value`` columns."""
    picks = [
        F.max(F.when(F.col("column") == c, F.col(v))).alias(f"{c}__{v}") for c in columns for v in values
    ]
    return stats.groupBy(*keys).agg(*picks) if keys else stats.agg(*picks)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Stats columns next to the data: joined by key, or one total row as a scalar subquery."""
    if keys:
        return df.join(stats, list(keys), "left")
    total = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("__s", total).select(*df.columns, *[F.col(f"__s.{c}").alias(c) for c in stats.columns])


def winsorize(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), lower: float = 0.005, upper: float = 0.995
) -> DataFrame:
    """Clip each column to its own quantiles inside the group; an all-null column stays."""
    stats = widen(exact_quantiles(df, columns, (lower, upper), keys), columns, ("q0", "q1"), keys)
    work = attach(df, stats, keys)
    low, high = (lambda c: F.col(f"{c}__q0")), (lambda c: F.col(f"{c}__q1"))
    clipped = {c: F.coalesce(clip(F.col(c).cast("double"), low(c), high(c)), F.col(c).cast("double")) for c in columns}
    return work.withColumns(clipped).drop(*[f"{c}__{q}" for c in columns for q in ("q0", "q1")])


def group_median_fill(
    df: DataFrame, columns: Sequence[str], group: str = "trade_date", keys: Sequence[str] = ()
) -> DataFrame:
    """NULL to the median of the date, else of the whole (or of the chunk), else 0.

    One pass finds the columns with gaps; only their medians are worked out, one row per date.
    """
    own = {c: F.col(c).cast("double") for c in columns}
    gaps = df.agg(*[F.max(own[c].isNull()).alias(c) for c in columns]).first() if columns else {}
    # a column without gaps needs no median
    open_ = [c for c in columns if gaps[c]]
    if not open_:
        return df.withColumns(own)
    whole = widen(exact_quantiles(df, open_, (0.5,), keys), open_, ("q0",), keys)
    # a group holds one row per symbol; narrow rows travel once, while sketches of so many groups would be as large as the cells
    cells = df.select(*keys, group, *[own[c].alias(c) for c in open_]).repartition(group)
    medians = staged(cells.groupBy(*keys, group).agg(*[F.median(c).alias(f"{c}__d") for c in open_]))
    work = attach(df.join(by_date(medians), [*keys, group], "left"), whole, keys)
    filled = {c: F.coalesce(own[c], F.col(f"{c}__d"), F.col(f"{c}__q0"), F.lit(0.0)) for c in open_}
    work = work.withColumns({**{c: own[c] for c in columns}, **filled})
    return work.drop(*[f"{c}__{s}" for c in open_ for s in ("d", "q0")])


def robust_scale(
    df: DataFrame, columns: Sequence[str], method: str = "robust", fit_on: DataFrame | None = None
) -> DataFrame:
    """(x - median)/IQR, or (x - mean)/population std; NULL takes the median, zero spread counts as 1."""
    base = df if fit_on is None else fit_on
    quart = widen(exact_quantiles(base, columns, (0.25, 0.5, 0.75)), columns, ("q0", "q1", "q2"))
    work = attach(df, quart)
    if method == "zscore":
        moments = base.agg(
            *[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]
        )
        work = attach(work, moments)
    out = {}
    for c in columns:
        x = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__q1"), F.lit(0.0))
        if method == "zscore":
            centre, spread = F.coalesce(F.col(f"{c}__m"), F.lit(0.0)), F.col(f"{c}__s")
        else:
            centre, spread = F.coalesce(F.col(f"{c}__q1"), F.lit(0.0)), F.col(f"{c}__q2") - F.col(f"{c}__q0")
        out[c] = div(x - centre, F.when(spread != 0, spread).otherwise(F.lit(1.0)))
    return work.withColumns(out).select(*df.columns)


def fit_normalizer(df: DataFrame, columns: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """One row: mean and population std (never below ``floor``) per column."""
    return df.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"{c}__std") for c in columns],
    )


def apply_normalizer(df: DataFrame, stats: DataFrame, columns: Sequence[str], limit: float = 10.0) -> DataFrame:
    """z-score; anything not finite is 0; clipped to +-``limit``."""
    work = attach(df, stats)
    scaled = {}
    for c in columns:
        z = div(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__std"))
        scaled[c] = clip(F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0)), -limit, limit)
    return work.withColumns(scaled).select(*df.columns)
