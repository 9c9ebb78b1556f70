"""Purged time splits, leakage checks, folds and sample weights."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import by_date, div
from barline.operators.aggregates import split_stats
from barline.operators.joins import boundary_join
from barline.operators.ranking import date_index

NAMES = ("train", "valid", "test")
METHOD = "time_purged"


def needed_gap(seq_length: int, horizons: Sequence[int]) -> int:
    """Days that keep an input window on the right clear of every label on the left."""
    return seq_length + max(horizons, default=0)


@dataclass(frozen=True)
class SplitConfig:
    """Three dated windows in order, with a purge gap between neighbours; it cannot be built otherwise."""

    seq_length: int
    horizons: tuple[int, ...]
    gap_days: int
    windows: Mapping[str, tuple[dt.date, dt.date]]

    def __post_init__(self) -> None:
        broken = [f"{rule}: {why}" for rule, holds, why in self._rules() if not holds]
        if broken:
            raise ValueError("split settings: " + "; ".join(broken))

    def _rules(self) -> list[tuple[str, bool, str]]:
        least = needed_gap(self.seq_length, self.horizons)
        rules = [
            ("length", self.seq_length > 0, f"an input window of {self.seq_length} rows has no content"),
            ("horizons", len(self.horizons) > 0, "no label looks ahead by a day or more"),
            ("gap", self.gap_days >= least > 0, f"a gap of {self.gap_days} days lets windows and labels meet, {least} are needed"),
        ]
        rules += [("window", first <= last, f"{name} ends on {last}, before it starts on {first}") for name, (first, last) in self.windows.items()]
        for (left, (_, end)), (right, (start, _)) in zip(self.windows.items(), list(self.windows.items())[1:]):
            apart = (start - end).days
            rules.append(("order", apart > 0, f"{right} does not come after {left}"))
            rules.append(("distance", apart <= 0 or apart >= self.gap_days, f"{left} and {right} lie {apart} days apart, less than the gap of {self.gap_days}"))
        return rules

    @property
    def max_horizon(self) -> int:
        return max(self.horizons)


def split_config(config: Mapping[str, Any]) -> SplitConfig:
    """The split section of a settings tree as a checked :class:`SplitConfig`."""
    project = config.get("project", {})
    method = str(project.get("split_method", "")).strip().lower()
    if method != METHOD:
        if method == "random":
            warnings.warn("rows drawn at random would leak the future into training", UserWarning, stacklevel=2)
        raise ValueError(f"split settings: method {method!r} is not available, only {METHOD!r}, as other splits leak")
    section = project.get("split") or config.get("split")
    if not section:
        raise ValueError("split settings: no windows given")
    length = int(project.get("seq_length", 0))
    horizons = tuple(h for h in map(int, config.get("labels", {}).get("holding_periods", ())) if h > 0)
    windows = {name: tuple(dt.date.fromisoformat(str(section[f"{name}_{edge}"])) for edge in ("start", "end")) for name in NAMES}
    asked = section.get("gap_days")
    return SplitConfig(length, horizons, needed_gap(length, horizons) if asked is None else int(asked), windows)


def assign_split(df: DataFrame, config: SplitConfig) -> DataFrame:
    """Adds ``split``; rows in the gaps are dropped.  The date bounds prune partitions."""
    name = F.lit(None).cast("string")
    inside = F.lit(False)
    for split, (start, end) in config.windows.items():
        hit = F.col("trade_date").between(F.lit(start), F.lit(end))
        name = F.when(hit, F.lit(split)).otherwise(name)
        inside = inside | hit
    return df.where(inside).withColumn("split", name)


def intersect_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("trade_date").intersect(right.select("trade_date"))


def except_dates(needed: DataFrame, have: DataFrame) -> DataFrame:
    return needed.select("trade_date").subtract(have.select("trade_date"))


def leakage_violations(df: DataFrame, length: int, horizon: int, gap: int | None = None, config: SplitConfig | None = None) -> DataFrame:
    """Rows (rule, pair, detail): empty when the splits are clean.  ``df`` carries ``split``."""
    required = int(gap or length + horizon)
    spark = df.sparkSession
    stats = df.groupBy("split").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    names = spark.createDataFrame([(n,) for n in NAMES], "split string")
    none = F.lit(None).cast("string")
    found = names.join(stats, "split", "left_anti").select(F.lit("empty").alias("rule"), F.col("split").alias("pair"), none.alias("detail"))

    per_date = df.groupBy("trade_date").agg(F.sort_array(F.collect_set("split")).alias("s"))
    shared = per_date.where(F.size("s") > 1).select(
        F.lit("shared_date").alias("rule"), F.array_join("s", "/").alias("pair"), F.col("trade_date").cast("string").alias("detail"))
    found = found.unionByName(shared)

    edge = {n: stats.where(F.col("split") == n) for n in NAMES}
    for left, right in zip(NAMES, NAMES[1:]):
        pair = f"{left}->{right}"
        last = edge[left].select("last").scalar()
        first = edge[right].select("first").scalar()
        span = names.where(F.col("split") == left).select(F.datediff(first, last).alias("days"), first.alias("f"), last.alias("l"))
        found = found.unionByName(span.where(F.col("days") < required).select(
            F.lit("short_gap").alias("rule"), F.lit(pair).alias("pair"), F.col("days").cast("string").alias("detail")))
        if config is not None:
            outside = (F.col("l") > F.lit(config.windows[left][1])) | (F.col("f") < F.lit(config.windows[right][0]))
            found = found.unionByName(span.where(outside).select(
                F.lit("outside_window").alias("rule"), F.lit(pair).alias("pair"), F.concat_ws("/", F.col("l").cast("string"), F.col("f").cast("string")).alias("detail")))
        both = boundary_join(df.where(F.col("split") == left), df.where(F.col("split") == right))
        risky = both.where(F.date_add("left_last_date", horizon) >= F.date_sub("right_first_date", length - 1))
        found = found.unionByName(risky.select(F.lit("symbol_boundary").alias("rule"), F.lit(pair).alias("pair"), F.col("symbol").alias("detail")))
    return found


def union_splits(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def event_sidecar(df: DataFrame, vector: str = "event_embedding", order: str = "symbol") -> DataFrame:
    """One vector per date; the last row of the date wins."""
    return df.groupBy("trade_date").agg(F.max_by(vector, order).alias(vector))


def merge_sidecars(first: DataFrame, second: DataFrame, vector: str = "event_embedding") -> DataFrame:
    """Union by date, the second one wins."""
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)))
    return both.groupBy("trade_date").agg(F.max_by(vector, "__o").alias(vector))


def sidecar_problems(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Dates twice in the sidecar, or needed and not there."""
    twice = sidecar.groupBy("trade_date").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("trade_date", F.lit("repeated").alias("problem"))
    return twice.unionByName(except_dates(rows, sidecar).withColumn("problem", F.lit("missing")))


def join_sidecar(rows: DataFrame, sidecar: DataFrame, check: bool = True) -> DataFrame:
    """Vectors back to the rows by date; raises when the sidecar does not fit."""
    if check:
        bad = sidecar_problems(rows, sidecar).take(5)
        if bad:
            raise ValueError(f"event sidecar does not fit: {[(str(r[0]), r[1]) for r in bad]}")
    return rows.join(sidecar, "trade_date", "left")


def export_splits(df: DataFrame, folder: str, config: SplitConfig, vector: str = "event_embedding") -> DataFrame:
    """One Parquet folder per split sorted by symbol and date, a vector sidecar, and a summary.

    Raises when a split or its sidecar is empty.  Returns the summary rows.
    """
    rows = assign_split(df, config)
    plain = rows.drop(vector)
    target = f"{folder}/samples"
    plain.repartition("split", "symbol").sortWithinPartitions("split", "symbol", "trade_date").write.mode("overwrite").partitionBy("split").parquet(target)
    if vector in df.columns:
        side = rows.groupBy("split", "trade_date").agg(F.max_by(vector, "symbol").alias(vector))
        side.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/events")
    saved = df.sparkSession.read.parquet(target)
    summary = split_stats(saved, config.seq_length)
    have = {r[0] for r in saved.select("split").distinct().collect()}
    if have != set(NAMES):
        raise ValueError(f"empty split: {sorted(set(NAMES) - have)}")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    return summary


def walk_forward_folds(df: DataFrame, folds: int = 3, first_share: float = 0.5) -> DataFrame:
    """Each date with its fold and role: expanding train windows, then a test window.

    Works on the list of distinct dates only; join it to the rows by date.
    """
    if folds <= 1:
        raise ValueError("walk-forward needs at least two folds")
    share = min(max(first_share, 0.1), 0.9)
    dates = date_index(df)
    total = dates.agg(F.count("*").alias("n")).scalar()
    # fewer than three dates give no fold
    work = dates.withColumn("__n", total).where(F.col("__n") >= 3)
    n0 = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    width = F.greatest(F.lit(1), F.ceil((F.col("__n") - n0) / F.lit(folds)))
    work = work.withColumns({"__n0": n0, "__w": width})
    work = work.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(1, folds + 1)])))
    left = F.col("__n0") + (F.col("fold") - 1) * F.col("__w")
    right = F.least(F.col("__n"), left + F.col("__w"))
    role = F.when(F.col("date_index") < left, "train").when(F.col("date_index") < right, "test")
    return work.withColumn("role", role).where(F.col("role").isNotNull() & (left < right)).select("trade_date", "date_index", "fold", "role")


def sample_weights(df: DataFrame, win: str, power: float = 1.5, floor: float = 1e-3) -> DataFrame:
    """Root of the class weight times a recency factor, scaled to mean 1.

    The class weight of a row is the inverse share of its class; recency grows
    linearly with the date's position.
    """
    dates = date_index(df)
    last = dates.agg(F.greatest(F.max("date_index"), F.lit(1)).alias("m")).scalar()
    share = df.agg(F.avg(win).alias("p")).scalar()
    work = df.join(by_date(dates), "trade_date").withColumns({"__m": last, "__p": share})
    positive = F.greatest(F.col("__p"), F.lit(1e-6))
    negative = F.greatest(F.lit(1.0) - F.col("__p"), F.lit(1e-6))
    balance = F.when(F.col(win) >= 0.5, F.lit(0.5) / positive).otherwise(F.lit(0.5) / negative)
    recency = F.lit(0.35) + F.lit(0.65) * F.col("date_index") / F.col("__m")
    work = work.withColumn("__raw", F.sqrt(balance) * F.pow(recency, F.lit(power)))
    mean = work.agg(F.avg("__raw").alias("a")).scalar()
    return work.withColumn("weight", F.greatest(div(F.col("__raw"), mean), F.lit(floor))).drop("__m", "__p", "__raw", "date_index")


#: Steps of the Poisson distribution that are written out; few draws lie beyond them.
NEAR = 8


def weighted_bootstrap(df: DataFrame, weight: str, seed: int = 7, key: Sequence[str] = ("symbol", "trade_date")) -> DataFrame:
    """Sample with replacement: each row repeats a Poisson(weight) number of times.

    The draw is an MD5 of seed and key, so a lost task redraws the same rows.  The
    count is read off the Poisson distribution function, which needs no state
    between rows.  Its first steps are plain columns; only draws beyond them walk on.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    draw = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    lam = F.col(weight)
    start = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.lit(0).alias("k"))

    def step(s, i):
        p = s["p"] * lam / i
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.when(F.col("__u") > s["c"], i).otherwise(s["k"]).alias("k"))

    work = df.withColumns({"__u": draw, "__p0": F.exp(-lam)}).withColumn("__c0", F.col("__p0"))
    for i in range(1, NEAR):
        work = work.withColumn(f"__p{i}", F.col(f"__p{i - 1}") * lam / i)
        work = work.withColumn(f"__c{i}", F.col(f"__c{i - 1}") + F.col(f"__p{i}"))
    near = sum(((F.col("__u") > F.col(f"__c{i}")).cast("int") for i in range(NEAR)), F.lit(0))
    work = work.withColumn("__near", near).drop(*[f"__{x}{i}" for x in "pc" for i in range(NEAR)])
    # far enough into the tail that the draw cannot lie beyond it
    top = F.ceil(lam + 12 * F.sqrt(lam) + 24).cast("int")
    count = F.aggregate(F.sequence(F.lit(1), top), start, step)["k"]
    work = work.withColumn("__k", F.when(F.col("__near") < NEAR, F.col("__near")).otherwise(count))
    # no filter on the count: Spark would move it below and draw again for every step
    copies = F.when(F.col("__k") > 0, F.sequence(F.lit(1), F.col("__k")))
    return work.withColumn("copy", F.explode(copies)).drop("__u", "__near", "__k")


def sequence_eligible(df: DataFrame, length: int, labels: Sequence[str], split: str = "split") -> DataFrame:
    """Rows with a full history inside their split and finite labels."""
    w = Window.partitionBy("symbol", split).orderBy("trade_date")
    ok = F.row_number().over(w) >= length
    work = df.withColumn("__ok", ok)
    for c in labels:
        work = work.withColumn("__ok", F.col("__ok") & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return work.where("__ok").drop("__ok")
