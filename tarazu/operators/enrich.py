"""Resumable, budgeted enrichment of rows by an external model, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarazu.functions.order import hash_of, sample, with_position


def remaining(df: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key isn't among those done: what a resumed run has to do, and what a
    second sample may draw from."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def gather(df: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of the given keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def plan_batches(df: DataFrame, n: int, size: int, seed: int, skip: int = 0, key: str = "row_id") -> DataFrame:
    """A seeded sample of n rows in random order with pos and batch; the first `skip`
    positions are left out, so a resumed run goes on where it stopped."""
    picked = sample(df, n, seed, key).withColumn("_h", hash_of(seed, key))
    return with_position(picked, "_h", key).drop("_h").where(F.col("pos") >= skip).withColumn("batch", F.floor(F.col("pos") / size))


def requests(batched: DataFrame) -> DataFrame:
    """batch, request: a JSON array of {id, instruction, output}, ids counting from 0
    within the batch. A batch is as large as the request may be, so it is one group."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "instruction", "output")))
    item = F.transform(rows, lambda r, i: F.struct(i.alias("id"), F.coalesce(r["instruction"], F.lit("")).alias("instruction"), F.coalesce(r["output"], F.lit("")).alias("output")))
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.to_json(item).alias("request"))


def call(reqs: DataFrame, complete: Callable[[str], tuple[str | None, int, int]], attempts: int = 3, wait: float = 0.0) -> DataFrame:
    """batch, response, input_tokens, output_tokens, attempts: complete(request) gives a
    response and what it took; a call that raises or gives none is tried again, and
    what every attempt took is added up; an exception may carry what it took in `took`, a
    pair of token counts. wait seconds pass between calls of a task, not after the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        called = False
        for pdf in batches:
            rows = []
            for batch, request in zip(pdf["batch"], pdf["request"]):
                response, took_in, took_out, k = None, 0, 0, 0
                while response is None and k < attempts:
                    k += 1
                    if wait and called:
                        time.sleep(wait)
                    called = True
                    try:
                        response, a, b = complete(request)
                        took_in, took_out = took_in + a, took_out + b
                    except Exception as e:
                        response, (a, b) = None, getattr(e, "took", (0, 0))
                        took_in, took_out = took_in + a, took_out + b
                rows.append((batch, response, took_in, took_out, k))
            yield pd.DataFrame(rows, columns=["batch", "response", "input_tokens", "output_tokens", "attempts"])

    return reqs.mapInPandas(run, "batch long, response string, input_tokens long, output_tokens long, attempts int")


def match_by_position(batched: DataFrame, responses: DataFrame, items: str = "items") -> DataFrame:
    """Rows joined to the item at their place in the batch's response. Items beyond the
    batch are dropped, rows beyond the response have none; ids in items are ignored."""
    flat = responses.select("batch", F.posexplode(items).alias("_at", "item"))
    w = Window.partitionBy("batch").orderBy("pos")
    placed = batched.withColumn("_at", F.row_number().over(w) - 1)
    out = placed.join(flat, ["batch", "_at"])
    return out.select(
        *[c for c in batched.columns if c not in ("instruction", "output")], F.coalesce("item.instruction", F.lit("")).alias("instruction"), F.coalesce("item.output", F.lit("")).alias("output"),
        F.col("instruction").alias("original_instruction"), F.col("output").alias("original_output"),
    )


def filled(items: DataFrame, columns: tuple[str, ...] = ("instruction", "output")) -> DataFrame:
    """Generated items without those whose instruction or output is null or the empty
    text; blanks are text."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.coalesce(F.col(c), F.lit("")) != "")
    return items.where(keep)


def progress_percent(done: Column, total: Column) -> Column:
    """Percent of the rows that are done; above 100 where a resumed run counts earlier
    rows against what remained. Null without rows."""
    return F.try_divide(F.lit(100.0) * done, total.cast("double"))


def within_budget(log: DataFrame, cost: str | Column, budget: float, order: str = "batch", by: tuple[str, ...] = ("job",)) -> DataFrame:
    """Entries of each job's log before its running total reaches the budget; the entry that reaches it
    was paid for but isn't kept. Costs aren't negative, so everything after it goes too."""
    spent = F.sum(F.col(cost) if isinstance(cost, str) else cost).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("spent", spent).where(F.col("spent") < budget)


def before_breaker(log: DataFrame, most: int = 10, order: str = "batch", by: tuple[str, ...] = ("job",)) -> DataFrame:
    """Entries of each job up to the one that stops it: a failed call when more than
    `most` failures, calls and parses together, have been counted. outcome is "ok",
    "call" or "parse"."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = log.withColumn("failures", F.count_if(F.col("outcome") != "ok").over(w))
    tripped = (F.col("outcome") == "call") & (F.col("failures") > most)
    return counted.withColumn("_stops", F.coalesce(F.count_if(tripped).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_stops = 0").drop("_stops")


def cycle(topics: DataFrame, batches: int, size: int, start: int = 0, pos: str = "pos") -> DataFrame:
    """batch, pos, topic for each batch's slice of the topics. A slice starts at
    (start + batch * size) modulo their number and is short at the end of the list."""
    n = topics.count()
    plan = topics.sparkSession.range(batches).select(F.col("id").alias("batch"), ((F.lit(start) + F.col("id") * size) % F.lit(max(1, n))).alias("_from"))
    slots = plan.select("batch", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + size - 1, F.lit(n - 1)))).alias(pos)) if n else plan.select("batch", F.lit(0).alias(pos)).limit(0)
    return slots.join(topics, pos)


def progress_marks(log: DataFrame, every: int, pos: str = "pos") -> DataFrame:
    """The first and every every-th entry, as a run would report them."""
    return log.where(((F.col(pos) + 1) % every == 0) | (F.col(pos) == 0))


def last_states(progress: DataFrame, by: tuple[str, ...] = ("job_id", "job")) -> DataFrame:
    """Of each job its furthest saved state; of equal ones the one saved last."""
    state = F.max_by(F.struct("done", "total_input_tokens", "total_output_tokens", "saved_at"), F.struct("done", "saved_at", "total_output_tokens"))
    return progress.groupBy(*by).agg(state.alias("s"), F.count(F.lit(1)).alias("n_states")).select(*by, "s.*", "n_states")
