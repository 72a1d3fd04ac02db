"""The clean stage and event counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarazu.functions import text as tx


def first_seen(records: DataFrame, within: str = "7 days", at: str = "ingested_at") -> DataFrame:
    """Records whose instruction, in lower case and clean, wasn't seen within the time;
    state older than the watermark is dropped, so it stays bounded."""
    key = F.md5(F.lower(tx.clean_whitespace(tx.text_or_empty("instruction"))))
    return records.withWatermark(at, within).withColumn("_key", key).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def sized(records: DataFrame, low: int = 20, high: int = 5000) -> DataFrame:
    """Records that pass the rules that need no other record, with the reason of the others."""
    i, o = (tx.clean_whitespace(tx.text_or_empty(c)) for c in ("instruction", "output"))
    size = tx.combined_length(i, tx.clean_whitespace(tx.text_or_empty("input")), o)
    return records.withColumn("reason_code", F.when((i == "") | (o == ""), "empty_field").when(size < low, "too_short").when(size > high, "too_long"))


def counts_in_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Events, and the sum of their values, by window and type; late ones within the watermark count."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n_events", "total")


def append_new(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to JSON Lines what the source has that earlier runs haven't written; the
    checkpoint is the offset, so a run that failed goes on where it stopped."""
    return records.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
