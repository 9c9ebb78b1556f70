"""As-of joins as one window over the union of both sides.

No range join and no broadcast: both sides are hashed by symbol, sorted by date
and swept once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    on: str = "symbol",
    left_time: str = "trade_date",
    right_time: str = "asof_date",
    tie: str | None = "report_date",
) -> DataFrame:
    """For each left row the values of the newest right row at or before it.

    The values travel as one struct: a NULL inside the newest snapshot stays NULL
    and is not taken from an older one.  Equal times: the largest ``tie`` wins.
    The left columns travel one by one, so that those nobody reads are not shuffled.
    """
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    keep = [c for c in left.columns if c not in (on, left_time)]
    l_side = left.select(
        F.col(on), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("date").alias("__tie"),
        *keep,
    )
    r_side = right.select(
        F.col(on), F.col(right_time).alias("__t"), F.lit(0).alias("__side"),
        (F.col(tie) if tie else F.lit(None).cast("date")).alias("__tie"), carried.alias("__right"),
    )
    both = l_side.unionByName(r_side, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    return swept.select(
        F.col(on), F.col("__t").alias(left_time), *keep,
        *[F.col(f"__right.{v}").alias(v) for v in values],
    )
