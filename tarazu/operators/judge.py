"""Evaluation joins and pairwise verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINNERS = ("finetuned", "base", "tie")


def share(part: Column, whole: Column) -> Column:
    """Percent of part in whole; 0 of nothing."""
    return F.coalesce(F.try_divide(100.0 * part, whole.cast("double")), F.lit(0.0))


def join_eval(prompts: DataFrame, base: DataFrame, finetuned: DataFrame, key: str = "id") -> DataFrame:
    """Prompts with both responses. Of repeated answers to a prompt the last wins, by
    the column `seq`; a prompt without both answers is an error, found by a count."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by("response", "seq").alias(name))
    return prompts.join(last(base, "base_response"), key).join(last(finetuned, "finetuned_response"), key)


def check_complete(prompts: DataFrame, joined: DataFrame) -> None:
    missing = prompts.join(joined.select("id"), "id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"prompts without both answers: {[r['id'] for r in missing]}")


def _counts() -> list[Column]:
    each = [F.count_if(F.col("winner") == w).alias(w) for w in WINNERS]
    return [*each, F.count_if(F.col("winner").isin(*WINNERS)).alias("total")]


def win_rates(verdicts: DataFrame, overall: bool = True, by: str = "judge") -> DataFrame:
    """judge, category, counts of the three known winners, their total and the share of
    the first. Other spellings count nowhere. overall adds a row per judge over all
    its categories, in the same aggregation."""
    named = verdicts.withColumn("category", F.coalesce("category", F.lit("unknown")))
    if overall:
        grouped = named.groupingSets([[F.col(by), F.col("category")], [F.col(by)]], F.col(by), F.col("category")).agg(*_counts(), F.grouping("category").alias("_g"))
        grouped = grouped.withColumn("category", F.when(F.col("_g") == 1, "overall").otherwise(F.col("category"))).drop("_g")
    else:
        grouped = named.groupBy(by, "category").agg(*_counts())
    return grouped.withColumn("ft_pct", share(F.col("finetuned"), F.col("total")))


def across_judges(rates: DataFrame, baseline: DataFrame | None = None, exclude: Sequence[str] = (), by: str = "judge") -> DataFrame:
    """Per category the median, least and largest rate of the judges that have it and,
    with a baseline (category, v1), the difference of the median from it."""
    rows = rates.where(~F.col(by).isin(*exclude)) if exclude else rates
    out = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_judges"), F.median("ft_pct").alias("median"), F.min("ft_pct").alias("lowest"), F.max("ft_pct").alias("highest"))
    if baseline is None:
        return out
    return out.join(baseline, "category", "left").withColumn("delta", F.col("median") - F.col("v1"))


def display_order(medians: DataFrame) -> DataFrame:
    return medians.orderBy(F.desc("median"), "category")


def band(rate: Column) -> Column:
    """Decision bands of an overall rate."""
    return F.when(rate >= 60, "pass").when(rate >= 50, "iterate").otherwise("regress")


def agreement(verdicts: DataFrame, by: Sequence[str] = ("run_id", "id")) -> DataFrame:
    """Of each item how many judges gave a known verdict and whether all agree; a judge
    who gave several winners for it disagrees with itself."""
    known = verdicts.where(F.col("winner").isin(*WINNERS))
    return known.groupBy(*by).agg(F.count_distinct("judge").alias("n_judges"), F.count_distinct("winner").alias("n_winners")).withColumn("agreed", F.col("n_winners") == 1)
