"""Original and new records together; shuffle, sample and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.functions.order import hash_order, sample, split_exact  # noqa: F401 - part of this module's surface


def well_sized(df: DataFrame, low: int = 20, high: int = 5000) -> DataFrame:
    """New records with text in both fields and low to high characters in the two; the input doesn't count."""
    i, o = tx.text_or_empty("instruction"), tx.text_or_empty("output")
    return df.where((tx.strip(i) != "") & (tx.strip(o) != "") & F.expr(f"length(coalesce(instruction, '')) + length(coalesce(output, '')) between {low} and {high}"))


def combine(original: DataFrame, *new: tuple[str, DataFrame]) -> DataFrame:
    """original and the well-sized rows of each new set under its source name; origin is
    "original" or that name."""
    out = original.withColumn("origin", F.lit("original"))
    for name, df in new:
        out = out.unionByName(well_sized(df).withColumn("source", F.lit(name)).withColumn("origin", F.lit(name)), allowMissingColumns=True)
    return out


def combine_statistics(combined: DataFrame) -> DataFrame:
    return combined.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("n_records"))


def ab_side(seed: int, *keys: str):
    """A for half of the keys, B for the others, the same at every run."""
    from tarazu.functions.order import hash_of

    return F.when(F.conv(F.substring(hash_of(seed, *keys), 1, 1), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")
