"""Strict JSON from model responses; Spark's own parser is laxer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS = "array<struct<id:bigint,instruction:string,output:string>>"


def _strict(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _fenceless(text: str) -> str:
    if not text.startswith("```"):
        return text
    return "\n".join(line for line in text.split("\n") if not line.strip().startswith("```"))


def parse_list(text: str | None) -> list | None:
    """The list that the response is, a fence around it aside; otherwise None."""
    if text is None:
        return None
    got = _strict(_fenceless(text.strip()))
    return got if isinstance(got, list) else None


def parse_examples(text: str | None, key: str = "examples") -> list | None:
    """A list, or the list under `key`: of the whole response, of it without fences, of
    its outermost braces, of its outermost brackets, whichever parses first."""
    if text is None:
        return None
    whole = text.strip()
    bare = _fenceless(whole)
    spans = [whole, bare] + [bare[bare.find(a) : bare.rfind(b) + 1] for a, b in ("{}", "[]") if -1 < bare.find(a) < bare.rfind(b)]
    for got in map(_strict, spans):
        if isinstance(got, dict) and key in got:
            return got[key] if isinstance(got[key], list) else None
        if isinstance(got, list):
            return got
    return None


def _rows(items: list | None) -> list[dict] | None:
    if items is None:
        return None
    text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    return [{"id": x.get("id") if isinstance(x.get("id"), int) and abs(x["id"]) < 2**63 else None, "instruction": text(x.get("instruction")), "output": text(x.get("output"))} for x in items if isinstance(x, dict)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("instruction", T.StringType()), T.StructField("output", T.StringType())])))
def response_items(text: pd.Series) -> pd.Series:
    """Items of a response by parse_examples; null if it can't be parsed, missing fields are empty."""
    return text.map(lambda t: _rows(parse_examples(t)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("instruction", T.StringType()), T.StructField("output", T.StringType())])))
def response_list(text: pd.Series) -> pd.Series:
    """Items of a response that must be a list, by parse_list."""
    return text.map(lambda t: _rows(parse_list(t)))
