"""Mixing sources to target weights (problem 3).

Sizes first: for each mixture the largest whole is found at which every source
that has rows reaches its share without a record being used more than
max_repeats times. Each record then has a fractional number of copies. Its whole
part is given; the fractional parts are rounded by the pivotal method, weighted
by size: two records of a source trade mass until one of them is whole, so that
the tokens of the two, and thereby of the source, stay what they were. Records
are paired within buckets; the one open record of each bucket goes up a tree of
buckets until a single one is left, which is drawn at random. So the tokens of a
source miss their target by less than one record's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from tarazu.session import materialize, spread

SEED = 42
#: Records that meet in one bucket, about; open records of so many buckets meet in the next.
BUCKET_ROWS, FAN_IN = 50_000, 64
#: A size is plausible if the text has at least as many bytes as tokens and at most so many times as many.
BYTES_PER_TOKEN = 64
_EPS = 1e-9


def sizes(train: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """row_id, source and n_tokens of every record with a source and an id. A stated size
    that is null, not positive, above the bytes of the text (no tokenizer yields more) or
    below a BYTES_PER_TOKEN-th of them is replaced by the exact count of the text, or
    of the other fields where there is no text. n_tokens is null only where there is no
    token at all. One scan; only texts that need a count go to Python."""
    n = F.octet_length("text")
    plausible = F.col("text").isNull() | ((F.col("n_tokens") <= n) & (F.col("n_tokens") * BYTES_PER_TOKEN >= n))
    fields = [c for c in ("instruction", "input", "output") if c in train.columns]
    stated = F.when((F.col("n_tokens") > 0) & plausible, F.col("n_tokens").cast("long"))
    rows = train.where(F.col("source").isNotNull() & F.col("row_id").isNotNull()).select(F.col("row_id").cast("long"), "source", stated.alias("stated"), F.coalesce("text", F.concat_ws("\n", *fields)).alias("text"))
    counted = with_token_counts(spread(rows).withColumn("text", F.when(F.col("stated").isNull(), F.col("text"))), out="counted", path=path)
    return counted.select("row_id", "source", F.coalesce("stated", F.when(F.col("counted") > 0, F.col("counted"))).alias("n_tokens"))


def plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, n_records, size, copies: the
    fractional copies of each record of the source. A named source without rows gets
    none and the others share the whole in proportion. Rows of targets without a
    positive share and max_repeats take no part."""
    have = rows.groupBy("source").agg(F.count("n_tokens").alias("n_records"), F.sum("n_tokens").alias("size"), F.count_if(F.col("n_tokens").isNull()).alias("n_not_weighed"))
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats").where("mix_name is not null and target_share > 0 and max_repeats > 0")
    wanted = wanted.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(have, "source", "left")
    whole = both.where("size > 0").groupBy("mix_name").agg(F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("whole"))
    return both.join(whole, "mix_name", "left").select(
        "mix_name", "source", "target_share", F.col("max_repeats").cast("int"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_not_weighed", F.lit(0)).alias("n_not_weighed"),
        F.coalesce(F.expr("least(double(max_repeats), target_share * whole / size)"), F.lit(0.0)).alias("copies"),
    )


def _unit(*key) -> float:
    """A number in [0, 1) that depends on the key alone, so a task that is repeated draws the same."""
    return xxhash.xxh64_intdigest(repr(key)) / 2**64


_COLUMNS = ["mix_name", "source", "bucket", "row_id", "n_tokens", "part", "open"]
_ROUND = "mix_name string, source string, bucket long, row_id long, n_tokens long, part double, open boolean"


def _round(seed: int, level: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "n_tokens", "part"], ignore_index=True)
        part = pdf["part"].tolist()
        size, ids = pdf["n_tokens"].tolist(), pdf["row_id"].tolist()
        held = -1
        for i in range(len(part)):
            if not _EPS < part[i] < 1 - _EPS:
                part[i] = float(part[i] >= 0.5)
                continue
            if held < 0:
                held = i
                continue
            # tokens that may go from one to the other before one is empty or full
            a, b = size[held], size[i]
            up = min((1 - part[held]) * a, part[i] * b)
            down = min(part[held] * a, (1 - part[i]) * b)
            move = up if _unit(seed, level, *key, ids[held], ids[i], i) * (up + down) < down else -down
            part[held] += move / a
            part[i] -= move / b
            for k in (held, i):
                if part[k] < _EPS or part[k] > 1 - _EPS:
                    part[k] = float(part[k] >= 0.5)
            left = [k for k in (held, i) if 0 < part[k] < 1]
            held = left[0] if left else -1
        pdf["part"] = part
        pdf["open"] = [0 < p < 1 for p in part]
        return pdf[_COLUMNS]

    return run


def mix_records(train: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """mix_name, row_id, source, n_tokens, repeats of the chosen records.

    A hot source is split over buckets of about BUCKET_ROWS records by a hash of
    row_id; nothing but ids and sizes is shuffled, and a level of the tree holds one
    record per bucket. The result depends on the rows and the seed only. Records
    without any token (see sizes) are in no mixture; records with equal row_id are
    rounded each for itself. Empty tables give no rows.
    """
    return _mixed(train, targets, seed)[0]


def _mixed(train: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    rows = materialize(sizes(train))
    wanted = materialize(plan(rows, targets))
    n_targets, most = wanted.agg(F.count(F.lit(1)), F.max("n_records")).first()
    buckets = max(1, -(-(most or 0) // BUCKET_ROWS))
    # a plan beyond PLAN_ROWS is joined as Spark sees fit
    parts = rows.where("n_tokens is not null").join(F.broadcast(wanted) if n_targets <= PLAN_ROWS else wanted, "source").where("copies > 0")
    parts = parts.select("mix_name", "source", "row_id", "n_tokens", F.floor("copies").alias("whole"), (F.col("copies") - F.floor("copies")).alias("part"), "max_repeats")
    given = parts.where("whole > 0").select("mix_name", "row_id", "source", "n_tokens", F.col("whole").alias("repeats"))
    level, n = 0, buckets
    live = parts.select("mix_name", "source", F.pmod(F.xxhash64("row_id"), F.lit(n)).alias("bucket"), "row_id", "n_tokens", "part", F.lit(True).alias("open"))
    drawn = []
    while True:
        done = materialize(live.groupBy("mix_name", "source", "bucket").applyInPandas(_round(seed, level), _ROUND))
        drawn.append(done.where("not open and part = 1"))
        live = done.where("open")
        if n == 1:
            break
        n = -(-n // FAN_IN)
        live = live.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        level += 1
    last = F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source", "row_id"), F.lit(1_000_000)) / 1_000_000
    drawn.append(live.where(last < F.col("part")))
    out = given
    for d in drawn:
        out = out.unionByName(d.select("mix_name", "row_id", "source", "n_tokens", F.lit(1).cast("long").alias("repeats")))
    return out.groupBy("mix_name", "row_id", "source", "n_tokens").agg(F.sum("repeats").alias("repeats")), wanted


#: Rows of a plan, one per mixture and source, that may be broadcast: about 6 MB.
PLAN_ROWS = 50_000


def mix_shares(train: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per target: the share reached beside the wanted one, the tokens and
    records used, and how many of the source's records hold no token."""
    records, planned = _mixed(train, targets, seed)
    used = records.groupBy("mix_name", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("repeats").alias("n_copies"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    wanted = targets.select("mix_name", "source", "target_share", "max_repeats")
    whole = used.groupBy("mix_name").agg(F.sum("n_tokens").alias("whole"))
    out = wanted.join(used, ["mix_name", "source"], "left").join(whole, "mix_name", "left").join(planned.select("mix_name", "source", "n_not_weighed"), ["mix_name", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "mix_name", "source", "target_share", F.coalesce(F.expr("try_divide(n_tokens, whole)"), F.lit(0.0)).alias("share"), "max_repeats", zero("most_repeats"), zero("n_records"), zero("n_copies"), zero("n_tokens"), zero("n_not_weighed"),
    )
