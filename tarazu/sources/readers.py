"""Scans: JSON Lines, state documents, partitioned and nested sources, files."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.functions import text as tx

BAD = "_corrupt_record"


@F.pandas_udf(T.BooleanType())
def _parses(lines: pd.Series) -> pd.Series:
    """Whether a line is one JSON object and nothing else: the column parser overlooks what follows one."""

    def one(line: str | None) -> bool:
        try:
            return isinstance(json.loads(line or ""), dict)
        except ValueError:
            return False

    return lines.map(one, na_action=None).astype(bool)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def dataset(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, head: int | None = None, order: str = "row_id") -> DataFrame:
    """One split of a dataset as exported; head takes a prefix in the order of a key."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(kind).load(path)
    return df if head is None else df.orderBy(order).limit(head)


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines of which any malformed line, blank ones included, stops the query."""
    schema = _struct(spark, schema)
    fields = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "allowSingleQuotes": "false"}
    rows = spark.read.text(path).select("value", F.from_json("value", fields, options).alias("row"), F.col("_metadata.file_path").alias("_file"))
    bad = ~_parses("value") | F.col("row").isNull()
    stop = F.raise_error(F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 80)))
    checked = rows.select(F.when(bad, stop.cast(fields)).otherwise(F.col("row")).alias("row"))
    return checked.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def tolerant_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with malformed lines in _corrupt_record and blank ones skipped."""
    schema = _struct(spark, schema)
    fields = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).select(tx.strip(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("_file")).where("value <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "allowSingleQuotes": "false"}
    parsed = lines.select(F.from_json("value", fields, options).alias("row"), "_file", F.when(_parses("value"), F.lit(None).cast("string")).otherwise(F.col("value")).alias(BAD))
    wrong = F.coalesce(F.col(BAD), F.col(f"row.{BAD}"))
    return parsed.select(*[F.when(wrong.isNull(), F.col("row")[f.name]).alias(f.name) for f in schema.fields], wrong.alias(BAD), "_file")


def good(df: DataFrame) -> DataFrame:
    """The well-formed rows of tolerant_jsonl."""
    return df.where(F.col(BAD).isNull()).drop(BAD)


def skipped(df: DataFrame) -> DataFrame:
    """How many lines tolerant_jsonl could not parse, and how many it could."""
    return df.agg(F.count_if(F.col(BAD).isNotNull()).alias("n_skipped"), F.count_if(F.col(BAD).isNull()).alias("n_rows"))


def optional(spark: SparkSession, path: str, schema: T.StructType | str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The source, or no rows if there is no such file."""
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], _struct(spark, schema))


def isolated(spark: SparkSession, schema: T.StructType | str, load: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
    """The source and None, or no rows and what went wrong while it was opened."""
    try:
        df = load()
        df.schema  # noqa: B018 - the analysis is what may fail
        return df, None
    except Exception as e:  # a broken source must not stop the others
        return spark.createDataFrame([], _struct(spark, schema)), f"{type(e).__name__}: {e}"


def partitioned(spark: SparkSession, root: str, file: str, schema: T.StructType | str, name: str = "judge", exclude: Sequence[str] = ()) -> DataFrame:
    """One relation of all sub-directories that hold `file`; the directory is a column."""
    df = good(tolerant_jsonl(spark, f"{root}/*/{file}", schema))
    return df.withColumn(name, F.url_decode(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1))).drop("_file").where(~F.col(name).isin(list(exclude)) if exclude else F.lit(True))


def exploded_documents(spark: SparkSession, glob: str, array: str, schema: T.StructType | str) -> DataFrame:
    """The inner array of JSON documents as rows, with file and position."""
    docs = spark.read.schema(schema).option("multiLine", True).json(glob).select(array, F.col("_metadata.file_path").alias("file"))
    return docs.select("file", F.posexplode(array).alias("pos", "item")).select("file", "pos", "item.*")


def state(spark: SparkSession, path: str, schema: T.StructType | str, default: dict) -> DataFrame:
    """A state document as one row, or the default if there is none."""
    schema = _struct(spark, schema)
    if exists(spark, path):
        return spark.read.schema(schema).option("multiLine", True).json(path).limit(1)
    return spark.createDataFrame([default], schema)


def literal(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


def files(spark: SparkSession, path: str, glob: str = "*", content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of files, at any depth."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df if content else df.drop("content")


def total_size(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return files(spark, path, glob).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n_files"))


def latest(names: DataFrame, name: str = "name", numeric: bool = True) -> DataFrame:
    """The last of names like checkpoint-500: by number, or as text."""
    key: Column = F.try_to_number(F.split_part(F.col(name), F.lit("-"), F.lit(2)), F.lit("999999999999")).cast("long") if numeric else F.col(name)
    return names.withColumn("_key", key).where("_key is not null").agg(F.max_by(name, F.struct("_key", name)).alias("latest"))


def with_row_id(df: DataFrame, source_rank: int = 0) -> DataFrame:
    """Rows of a file source with their place: rank of the source, file, block, and a
    number that rises within the block. Ordering by row_key gives file order."""
    place = F.struct(F.lit(source_rank).alias("rank"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return df.select("*", place.alias("row_key"))


def _struct(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
