"""Profiles of text columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.functions.order import upper_ranks
from tarazu.operators.ingest import text_columns


def lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, length: one row per column and record, null counted as empty."""
    columns = list(columns or text_columns(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("length")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def length_profile(df: DataFrame, columns: Sequence[str] | None = None, short: int = 20, long: int = 5000) -> DataFrame:
    """Per text column n, least, largest, mean and median length and how many are empty, short and long."""
    rows = lengths(df, columns)
    ranks = upper_ranks(rows, "length", {"median": 0.5}, ["column"])
    counts = rows.groupBy("column").agg(F.count_if(F.col("length") == 0).alias("n_empty"), F.count_if(F.col("length") < short).alias("n_short"), F.count_if(F.col("length") > long).alias("n_long"))
    return ranks.join(counts, "column")


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column values, distinct values and duplicates. Values are counted by their
    hash in one aggregation per column and value, so no distinct set grows in memory."""
    columns = list(columns or text_columns(df))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.md5(F.col(c).cast("string")).alias("key")) for c in columns])
    each = df.select(F.explode(pairs).alias("p")).select("p.*").where("key is not null").groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy("column").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("n_duplicates", F.col("n_values") - F.col("n_distinct")).withColumn("duplicate_share", 100.0 * F.col("n_duplicates") / F.col("n_values"))


def low_cardinality(df: DataFrame, columns: Sequence[str], below: int = 50) -> DataFrame:
    """column, value, n_records of the columns with fewer than `below` values. A sketch
    with few bytes per column picks them; they are then counted."""
    approx = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    near = [c for c in columns if approx[c] < 1.25 * below]
    if not near:
        return df.sparkSession.createDataFrame([], "column string, value string, n_records long")
    counts = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n_records")).select(F.lit(c).alias("column"), "value", "n_records") for c in near]
    all_counts = reduce(lambda a, b: a.unionByName(b), counts)
    few = all_counts.groupBy("column").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") < below).select("column")
    return all_counts.join(F.broadcast(few), "column")


def top(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values, ties in their order."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_records")).orderBy(F.desc("n_records"), column).limit(k)


def ratio_histogram(df: DataFrame, column: str, by: Sequence[str] = (), script: str = tx.ARABIC_SCRIPT) -> DataFrame:
    """Texts by their share of a script: above 0.9, from 0.5 to 0.9, below, and the mean."""
    rows = df.withColumn("_r", tx.script_ratio(tx.text_or_empty(column), script))
    return rows.groupBy(*by).agg(F.count_if(F.col("_r") > 0.9).alias("n_high"), F.count_if(F.col("_r").between(0.5, 0.9)).alias("n_middle"), F.count_if(F.col("_r") < 0.5).alias("n_low"), F.avg("_r").alias("mean_ratio"))


def with_input(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records with something in their input, and their share in percent."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(tx.strip(tx.text_or_empty("input")) != "").alias("n_with_input"))
    return out.withColumn("input_share", F.expr("coalesce(try_divide(100D * n_with_input, double(n_records)), 0D)"))


def compare(named: dict[str, DataFrame], columns: Sequence[str] = ("instruction", "output")) -> DataFrame:
    """Of each dataset its records and the floor of the mean length of each column."""
    parts = []
    for name, df in named.items():
        means = [F.coalesce(F.expr(f"sum(cast(length(coalesce(`{c}`, '')) as bigint)) div nullif(count(*), 0)"), F.lit(0)).alias(f"mean_{c}") for c in columns]
        parts.append(df.agg(F.count(F.lit(1)).alias("n_records"), *means).select(F.lit(name).alias("dataset"), "n_records", *[f"mean_{c}" for c in columns]))
    return reduce(lambda a, b: a.unionByName(b), parts)
