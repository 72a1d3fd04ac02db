"""Heterogeneous sources to one instruction schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.functions.text import first_present, names_urdu, strip, text_or_empty

FIELDS = ("instruction", "input", "output", "source")
# Columns that may hold a field, in order of preference.
INSTRUCTION = ("instruction", "inputs", "prompt")
OUTPUT = ("output", "targets", "response")


def to_record(instruction: Column, given: Column, output: Column, source: str | Column) -> list[Column]:
    """The four fields of an instruction record, stripped; nulls become empty."""
    source = F.lit(source) if isinstance(source, str) else source
    return [strip(text_or_empty(instruction)).alias("instruction"), strip(text_or_empty(given)).alias("input"), strip(text_or_empty(output)).alias("output"), source.alias("source")]


def unify(df: DataFrame, source: str | None, keep: Sequence[str] = ("row_id",), instruction: Sequence[str] = INSTRUCTION, output: Sequence[str] = OUTPUT, drop_empty: bool = True) -> DataFrame:
    """df as instruction records. Fields come from the first candidate column that is
    present, whatever it holds; without one there are no rows. Rows whose instruction
    or output is null or empty before stripping are dropped; blank ones stay. source
    None keeps the source of each row, "unknown" where it is null."""
    i, o = first_present(df.columns, instruction), first_present(df.columns, output)
    given = F.col("input") if "input" in df.columns else F.lit("")
    named = F.lit(source) if source is not None else F.coalesce(F.col("source"), F.lit("unknown")) if "source" in df.columns else F.lit("unknown")
    if i is None or o is None:
        empty = [F.lit("").alias(f) for f in FIELDS]
        return df.where(F.lit(False)).select(*keep, *empty)
    rows = df.where((text_or_empty(i) != "") & (text_or_empty(o) != "")) if drop_empty else df
    return rows.select(*keep, *to_record(F.col(i), given, F.col(o), named))


def in_urdu(df: DataFrame, candidates: Sequence[str] = ("language", "lang", "language_code"), variant: str = "a") -> DataFrame:
    """Rows whose language column names Urdu; no such column, no rows."""
    c = first_present(df.columns, candidates)
    return df.where(names_urdu(c, variant)) if c else df.where(F.lit(False))


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All sources in one relation; source_rank is the place in the list, so
    (source_rank, row_id) is the order of the whole."""
    ranked = [p.withColumn("source_rank", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def counts_by_source(df: DataFrame) -> DataFrame:
    """Records and share of all by source; shares of nothing are 0."""
    n = df.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.min("row_id").alias("first_row"))
    total = F.sum("n_records").over(Window.partitionBy())  # over one row per source
    return n.withColumn("share", F.coalesce(F.try_divide(100.0 * F.col("n_records"), total.cast("double")), F.lit(0.0)))
