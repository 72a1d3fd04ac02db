"""Sinks: JSON Lines, split and versioned outputs, documents, reports."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.sources.readers import exists


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """UTF-8 JSON Lines without escapes; null fields are written."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_split(tagged: DataFrame, reason: str, kept: str, removed: str) -> None:
    """Rows without a reason to one place and those with one to another, in a single
    pass over the plan: both are partitions of one write, then moved apart."""
    spark = tagged.sparkSession
    staging = f"{kept}.staging"
    tagged.withColumn("_kept", F.col(reason).isNull()).write.mode("overwrite").partitionBy("_kept").option("ignoreNullFields", "false").json(staging)
    for flag, to in (("true", kept), ("false", removed)):
        part = f"{staging}/_kept={flag}"
        if exists(spark, part):
            replace(spark, part, to)
        else:
            tagged.limit(0).write.mode("overwrite").json(to)
    _fs(spark, staging).delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)


def write_document(row: DataFrame, path: str) -> None:
    """A one-row result, such as statistics, as an indented JSON document."""
    got = row.limit(2).toJSON().collect()
    if len(got) != 1:
        raise ValueError(f"a document has one row, not {len(got)}")
    spark = row.sparkSession
    text = json.dumps(json.loads(got[0]), ensure_ascii=False, indent=2)
    out = _fs(spark, path).create(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace(spark: SparkSession, new: str, place: str) -> None:
    """Puts `new` where `place` is; what was there is kept as place.previous until then."""
    path, fs = spark._jvm.org.apache.hadoop.fs.Path, _fs(spark, place)
    old = f"{place}.previous"
    fs.delete(path(old), True)
    if exists(spark, place) and not fs.rename(path(place), path(old)):
        raise OSError(f"can't move {place}")
    if not fs.rename(path(new), path(place)):
        fs.rename(path(old), path(place))
        raise OSError(f"can't move {new}")


def write_verified(df: DataFrame, place: str, expected: int) -> None:
    """JSON Lines that replace `place` only if they have the expected number of lines."""
    spark, staging = df.sparkSession, f"{place}.staging"
    write_jsonl(df, staging)
    n = spark.read.text(staging).count()
    if n != expected:
        _fs(spark, staging).delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)
        raise ValueError(f"{n} lines written instead of {expected}")
    replace(spark, staging, place)


def concat_files(spark: SparkSession, parts: list[str], place: str, key: Column | str) -> None:
    """Lines of several files in one place, each key once, so a rerun adds nothing."""
    lines = None
    for rank, p in enumerate(x for x in parts if exists(spark, x)):
        one = spark.read.text(p).withColumn("_rank", F.lit(rank))
        lines = one if lines is None else lines.unionByName(one)
    if lines is None:
        return
    keyed = lines.withColumn("_key", F.md5("value") if key == "value" else F.md5(F.get_json_object("value", f"$.{key}")))
    first = keyed.groupBy("_key").agg(F.min_by("value", "_rank").alias("value"))
    first.select("value").write.mode("overwrite").text(f"{place}.staging")
    replace(spark, f"{place}.staging", place)


def run_logged(spark: SparkSession, path: str, run: Callable[[Callable[[str], None]], object]) -> object:
    """Runs run(log) and writes the logged lines whether or not it fails."""
    lines: list[str] = []
    log = lambda text: lines.append(f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ} {text}")
    try:
        return run(log)
    except BaseException as e:
        log(f"failed: {type(e).__name__}: {e}")
        raise
    finally:
        spark.createDataFrame([(x,) for x in lines] or [("",)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame, widths: dict[str, int], limit: int = 200) -> str:
    """A small result as lines of fixed width; negative widths align to the right. Rows
    beyond the limit are counted in a last line."""
    cells = [(F.lpad if w < 0 else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("—")), abs(w), " ") for c, w in widths.items()]
    head = "".join(f"{c:>{-w}}" if w < 0 else f"{c:<{w}}" for c, w in widths.items())
    shown = [r[0] for r in df.limit(limit + 1).select(F.concat(*cells)).collect()]
    more = [f"… and {df.count() - limit} more"] if len(shown) > limit else []
    return "\n".join([head, *shown[:limit], *more])


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
