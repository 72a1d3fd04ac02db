"""Training logs: merged histories, trends, smoothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A series is split over time ranges of this many steps for as-of joins.
RANGE = 100_000


def kind(eval_loss: Column, loss: Column) -> Column:
    """What a log entry is: an evaluation, a training step, or neither (null)."""
    return F.when(eval_loss.isNotNull(), "eval").when(loss.isNotNull(), "train")


def merge(log: DataFrame, keys: tuple[str, ...] = ("step", "kind"), order: tuple[str, ...] = ("path", "pos")) -> DataFrame:
    """One entry per key, the first in the order of files and positions. An aggregation,
    partial before the shuffle, so keys repeated over many restarts are no burden."""
    rest = [c for c in log.columns if c not in keys]
    first = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def asof(points: DataFrame, series: DataFrame, on: str, value: str, by: tuple[str, ...] = (), span: int = RANGE) -> DataFrame:
    """points with the value of the last entry of the series at or before it, else null.
    Entries and points of one key are sorted together by ranges of `span`; a range
    starts from the last entry of the ranges before it, of which there is one row
    each, so a long series is not one task's."""
    p = points.select("*", F.lit(None).cast(series.schema[value].dataType).alias("_v"), F.lit(1).alias("_point"))
    s = series.groupBy(*by, on).agg(F.max(value).alias("_v")).withColumn("_point", F.lit(0))
    both = p.unionByName(s, allowMissingColumns=True).withColumn("_range", F.floor(F.col(on) / span))
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by, "_range").orderBy(on, "_point").rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy(*by, "_range").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(on))).alias("_end"))
    w = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    out = both.withColumn("_in", inside).where("_point = 1").join(carried, [*by, "_range"], "left")
    return out.withColumn(f"{value}_asof", F.coalesce("_in", "_carried")).drop("_v", "_point", "_range", "_in", "_carried")


def trend(evals: DataFrame, loss: str = "eval_loss", order: str = "step", by: tuple[str, ...] = (), rise: float = 0.01) -> DataFrame:
    """evals with `trend` against the one before: RISING above it by more than `rise`,
    improving below it, otherwise plateau; empty for the first."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    before = F.lag(loss).over(w)
    mark = F.when(before.isNull(), "").when(F.col(loss) > before + rise, "<< EVAL RISING").when(F.col(loss) < before, "improving").otherwise("plateau")
    return evals.withColumn("trend", mark)


def best_and_last(evals: DataFrame, loss: str = "eval_loss", order: str = "step", by: tuple[str, ...] = (), margin: float = 0.02) -> DataFrame:
    """The least loss and its first step, the last loss, and whether it is above the
    least by more than `margin`."""
    out = evals.groupBy(*by).agg(F.min_by(order, F.struct(loss, order)).alias("best_step"), F.min(loss).alias("best_loss"), F.max_by(loss, order).alias("last_loss"), F.max(order).alias("last_step"))
    return out.withColumn("overfit", F.col("last_loss") > F.col("best_loss") + margin)


def epochs(log: DataFrame, n: int = 3, order: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """The steps at which each of n epochs ends."""
    most = log.groupBy(*by).agg(F.max(order).alias("_most"))
    return most.select(*by, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("epoch"), "_most").select(*by, "epoch", (F.col("epoch") * F.col("_most") / n).alias("boundary"))


def smoothed(log: DataFrame, value: str, order: str, by: tuple[str, ...], span: int = 50) -> DataFrame:
    """by, order, value and `ema`: the exponential mean with weight 2 / (span + 1) that
    starts at the first value, of series longer than span. One series is one group:
    each value needs the one before."""
    kept = [*by, order, value]
    schema = log.select(*kept).schema.add("ema", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(ema=pdf[value].ewm(alpha=2 / (span + 1), adjust=False).mean()) if len(pdf) > span else pdf.iloc[:0].assign(ema=pd.Series(dtype=float))

    return log.select(*kept).groupBy(*by).applyInPandas(run, schema)
