"""Deterministic order, samples and ranks without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarazu.session import materialize

#: Hex digits of a hash that name a bucket; 4,096 buckets.
DIGITS = 3


def hash_of(seed: int | str, *keys: str) -> Column:
    """The key that orders rows at random, the same wherever they lie."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_order(df: DataFrame, seed: int | str, *keys: str) -> DataFrame:
    """df in its seeded random order."""
    return df.orderBy(hash_of(seed, *keys), *keys)


def sample(df: DataFrame, n: int, seed: int | str, *keys: str) -> DataFrame:
    """The first n rows in seeded order. For n of any size: the rows of a bucket of
    hashes are counted, whole buckets are taken or left, and only the bucket that
    the border runs through is ranked. Two narrow passes, no sort of all rows."""
    h = hash_of(seed, *keys)
    marked = df.withColumn("_hash", h).withColumn("_bucket", F.substring("_hash", 1, DIGITS))
    sizes = marked.groupBy("_bucket").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).where(F.col("_before") < n).withColumn("_whole", F.col("_before") + F.col("count") <= n).drop("count")
    near = marked.join(F.broadcast(sizes), "_bucket")  # at most 16 ** DIGITS rows
    border = near.where(~F.col("_whole")).withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *keys)))
    border = border.where(F.col("_before") + F.col("_rank") <= n)
    return near.where("_whole").select(df.columns).unionByName(border.select(df.columns))


def split_exact(df: DataFrame, share: float, seed: int | str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Two parts, the second of exactly ceil(share * rows) rows. keys identify a row."""
    import math

    held = sample(df, math.ceil(df.count() * share), seed, *keys)
    return df.join(held.select(*keys), list(keys), "left_anti"), held


def upper_ranks(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Of each group n, min, max, the floor of the mean and for each probability the
    value at zero-based rank floor(n * p). Ranks come from the counts of distinct
    values, so rows are neither sorted nor gathered; nulls take no part. Without groups
    and values all are 0."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(w))
    picks = [F.min(F.when(F.col("_to") > F.floor(F.col("_all").cast("double") * p), F.col(value))).alias(name) for name, p in probs.items()]
    mean = F.expr(f"sum(cast(`{value}` as bigint) * _n) div sum(_n)")
    out = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), mean.alias("mean"), *picks)
    return out.fillna(0, ["n", "min", "max", "mean", *probs])


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """df with its zero-based position and batch number. Positions come from counts of
    range partitions, so no task sees all rows."""
    return with_position(df, *order).withColumn("batch", F.floor(F.col("pos") / size))


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """df with `pos`, its zero-based place in the given order. The order must name one row."""
    # written once: a second evaluation might draw other borders
    parts = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_local", local).join(F.broadcast(sizes.withColumn("_before", before).drop("count")), "_part").withColumn("pos", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def bounded_sample(df: DataFrame, rows: int, seed: int, key: str, by: str | None = None) -> list:
    """At most `rows` rows of df, or of each value of `by`, brought to the driver: those
    with the least hash of the key. A count sets the hash below which about that many
    lie, so a scan sends little more than it keeps, from however many partitions."""
    space = 1 << 30
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(space))
    counted = df.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("_n")).collect()
    below = lambda n: min(space, int(space * (rows + 4 * rows**0.5 + 8) / max(1, n)) + 1)
    marked = df.withColumn("_h", h)
    if by is None:
        near = marked.where(F.col("_h") < below(counted[0]["_n"]))
    else:
        limits = F.create_map(*[F.lit(x) for r in counted if r[by] is not None for x in (r[by], below(r["_n"]))]) if any(r[by] is not None for r in counted) else None
        if limits is None:
            return []
        near = marked.where(F.col("_h") < limits[F.col(by)])
    taken: dict = {}
    out = []
    for r in sorted(near.collect(), key=lambda r: (r["_h"], repr(r))):
        label = r[by] if by else None
        if taken.get(label, 0) < rows:
            taken[label] = taken.get(label, 0) + 1
            out.append(r)
    return out
