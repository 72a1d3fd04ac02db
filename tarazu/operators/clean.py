"""The clean stage: ordered rules with reasons, first occurrence wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.session import spread


@dataclass(frozen=True)
class Rules:
    """Limits and, as fixed values, the sources that a rule is for."""

    min_chars: int = 20
    max_chars: int = 5000
    min_ratio: float = 0.3
    min_after_strip: int = 5
    script: str = tx.ARABIC_SCRIPT
    stripped_sources: tuple[str, ...] = ("urdu-instruct-roman", "redgerd-roman")
    ratio_sources: tuple[str, ...] = ("urdu-instruct", "aya-urdu")


REASONS = ("empty_field", "duplicate", "too_short", "too_long", "roman_cleanup_empty", "low_urdu_ratio")


def tag(df: DataFrame, rules: Rules = Rules(), order: str = "row_id") -> DataFrame:
    """df's fields after cleaning, with reason_code and removal_reason of the first rule
    that a record fails, both null for records that stay.

    White space is normalised first. A duplicate is a later record, in the order of a
    key without repeats, with the instruction of an earlier one in lower case; a first
    occurrence counts although it is itself removed for its length. Lengths precede
    the removal of script letters, which is neither measured nor deduplicated again.

    First occurrences come from an aggregation over hashes of the instruction, which
    is partial before the shuffle, and are marked by a join on the order key: an
    instruction that a third of all records share is no hot key in either.
    """
    cleaned = spread(df).withColumns({c: tx.clean_whitespace(tx.text_or_empty(c)) for c in ("instruction", "input", "output")} | {"source": F.coalesce("source", F.lit("unknown"))})
    filled = (F.col("instruction") != "") & (F.col("output") != "")
    cleaned = cleaned.withColumns({"_filled": filled, "_size": tx.combined_length("instruction", "input", "output")})
    firsts = cleaned.where("_filled").groupBy(F.md5(F.lower("instruction")).alias("_key")).agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_first"))
    strips, ratios = F.col("source").isin(*rules.stripped_sources), F.col("source").isin(*rules.ratio_sources)
    rows = cleaned.withColumns({c: F.when(strips, tx.strip_script(c, rules.script)).otherwise(F.col(c)) for c in ("instruction", "output")})
    rows = rows.withColumns({f"_r{c[0]}": F.when(ratios, tx.script_ratio(c, rules.script)) for c in ("instruction", "output")})
    short = (F.length("instruction") < rules.min_after_strip) | (F.length("output") < rules.min_after_strip)
    # all that takes texts precedes the join, so texts are shuffled only where they are wanted
    other = (
        F.when(~F.col("_filled"), "empty_field").when(F.col("_size") < rules.min_chars, "too_short").when(F.col("_size") > rules.max_chars, "too_long")
        .when(strips & short, "roman_cleanup_empty").when(F.greatest("_ri", "_ro") < rules.min_ratio, "low_urdu_ratio")
    )
    rows = rows.withColumn("_other", other)
    detail = F.concat(F.col("_other"), F.lit(" (instr:"), tx.percent(F.col("_ri")), F.lit(", out:"), tx.percent(F.col("_ro")), F.lit(")"))
    rows = rows.withColumn("_detail", F.when(F.col("_other") == "low_urdu_ratio", detail).otherwise(F.col("_other")))
    rows = rows.drop("_size", "_ri", "_ro").join(firsts, order, "left")
    again = F.col("_filled") & F.col("_first").isNull()
    rows = rows.withColumns({"reason_code": F.when(again, "duplicate").otherwise(F.col("_other")), "removal_reason": F.when(again, "duplicate").otherwise(F.col("_detail"))})
    return rows.drop("_filled", "_first", "_other", "_detail")


def kept(tagged: DataFrame) -> DataFrame:
    return tagged.where("reason_code is null").drop("reason_code", "removal_reason")


def removed(tagged: DataFrame) -> DataFrame:
    return tagged.where("reason_code is not null")


def reason_counts(tagged: DataFrame, order: str = "row_id") -> DataFrame:
    """Records by reason, those kept under "kept"; first_row breaks ties of counts."""
    return tagged.groupBy(F.coalesce("reason_code", F.lit("kept")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n_records"), F.min(order).alias("first_row"))


def totals(tagged: DataFrame) -> DataFrame:
    """Records read, kept and removed, and the shares in percent, null without records."""
    n = tagged.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col("reason_code").isNull()).alias("n_kept"))
    return n.select("n_input", "n_kept", (F.col("n_input") - F.col("n_kept")).alias("n_removed"), F.expr("try_divide(100D * n_kept, double(n_input))").alias("kept_share"))


def kept_by_source(tagged: DataFrame) -> DataFrame:
    from tarazu.operators.ingest import counts_by_source

    return counts_by_source(kept(tagged))


def statistics(tagged: DataFrame) -> DataFrame:
    """The statistics document: totals and both counters as maps."""
    by_reason = reason_counts(tagged).select(F.lit("reason").alias("kind"), F.col("reason_code").alias("key"), "n_records")
    by_source = kept(tagged).groupBy("source").agg(F.count(F.lit(1)).alias("n_records")).select(F.lit("source").alias("kind"), F.col("source").alias("key"), "n_records")
    counter = lambda which: F.map_from_entries(F.array_sort(F.collect_list(F.when(which, F.struct("key", "n_records")))))
    reason, stays = F.col("kind") == "reason", F.col("key") == "kept"
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n_records"))), F.lit(0))
    out = by_reason.unionByName(by_source).agg(total(reason).alias("n_input"), total(reason & stays).alias("n_kept"), total(reason & ~stays).alias("n_removed"), counter(reason & ~stays).alias("removal_reasons"), counter(~reason).alias("kept_by_source"))
    return out
