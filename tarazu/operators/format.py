"""Chat-formatted training text, its token counts and lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.functions.order import upper_ranks

#: Fixed value: the system turn of formatted records.
SYSTEM = "You are a helpful assistant."
MAX_TOKENS = 2048
PROBS = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Runs of letters or digits and single other signs: what a count stands for without a tokenizer.
PRETOKENS = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"


def proxy_tokens(c: Column | str) -> Column:
    """A deterministic count that needs no vocabulary. No tokenizer's count."""
    return F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit(PRETOKENS))


def tokenizer_tokens(path: str):
    """Column function that counts tokens by a tokenizer file, loaded once per worker."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return count


def formatted(df: DataFrame, system: str = SYSTEM, tokens=proxy_tokens, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """keep, text, source, n_tokens: each record as a chat of three turns."""
    text = tx.chat_template(tx.chat_messages(F.lit(system), tx.user_message(tx.text_or_empty("instruction"), tx.text_or_empty("input")), tx.text_or_empty("output")))
    rows = df.select(*keep, text.alias("text"), F.coalesce("source", F.lit("unknown")).alias("source"))
    return rows.withColumn("n_tokens", tokens("text").cast("int"))


def within(df: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Records of at most `most` tokens."""
    return df.where(F.col("n_tokens") <= most)


def length_profile(df: DataFrame, by: tuple[str, ...] = (), value: str = "n_tokens") -> DataFrame:
    """n, min, max, floor of the mean, median and upper percentiles of a whole-number column."""
    return upper_ranks(df, value, PROBS, by)


def format_statistics(df: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col("n_tokens") <= most).alias("n_output"), F.count_if(F.col("n_tokens") > most).alias("n_too_long"))
