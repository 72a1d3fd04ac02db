import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarazu.functions.jsonx import parse_examples, parse_list, response_items
from tarazu.operators import enrich


@pytest.mark.parametrize(
    "text, listed",
    [('[{"instruction":"a"}]', True), ('{"instruction":"a"}', False), ('```json\n[{"instruction":"a"}]\n```', True), ('[{"instruction":"a"}] trailing', False), ("[{'instruction':'a'}]", False), ('[{"instruction":"a"}', False), ("", False), (None, False)],
)
def test_parse_list(text, listed):
    assert (parse_list(text) is not None) == listed


@pytest.mark.parametrize(
    "text, wanted",
    [('{"examples":[1]}', [1]), ("[2]", [2]), ('Sure: {"examples":[3]} done', [3]), ('{"x":1}', None), ('{"x":[{"instruction":"q"}]}', [{"instruction": "q"}]), ("no json", None), (None, None), ("```\n[4]\n```", [4])],
)
def test_parse_examples(text, wanted):
    assert parse_examples(text) == wanted


def test_response_items_column(spark):
    rows = spark.createDataFrame([('[{"id": 7, "instruction": "a"}, 3]',), ("bad",), (None,)], "t string").select(response_items("t").alias("r")).collect()
    assert rows[0].r == [(7, "a", "")] and rows[1].r is None and rows[2].r is None


def batched(spark, n=10, size=5):
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("i"), "id").alias("instruction"), F.concat(F.lit("o"), "id").alias("output"), F.floor(F.col("id") / size).alias("batch"), F.col("id").alias("pos"))


@pytest.mark.parametrize("answers, rows", [(3, 3), (7, 5), (0, 0)])
def test_match_by_position(spark, answers, rows):
    b = batched(spark, 5)
    r = spark.createDataFrame([(0, [("x", str(k)) for k in range(answers)])], "batch long, items array<struct<instruction:string,output:string>>")
    got = enrich.match_by_position(b, r).orderBy("row_id").collect()
    assert [x.output for x in got] == [str(k) for k in range(rows)]
    assert [x.original_output for x in got] == [f"o{k}" for k in range(rows)]


def test_budget_keeps_what_was_written(spark):
    log = spark.createDataFrame([("j", k, 0.4) for k in range(6)], "job string, batch long, cost double")
    assert sorted(r.batch for r in enrich.within_budget(log, "cost", 1.5).collect()) == [0, 1, 2]
    assert enrich.within_budget(log, "cost", 0.1).count() == 0


def test_breaker_stops_after_a_failed_call(spark):
    outcomes = ["parse"] * 3 + ["ok", "parse", "call", "ok"]
    log = spark.createDataFrame([("j", k, o) for k, o in enumerate(outcomes)], "job string, batch long, outcome string")
    assert sorted(r.batch for r in enrich.before_breaker(log, 3).collect()) == [0, 1, 2, 3, 4, 5]
    assert enrich.before_breaker(log, 10).count() == 7


def test_calls_are_repeated_and_paid_for(spark):
    def complete(request):
        if '"i5"' in request:
            raise OSError("down")
        return (None, 1, 0) if '"i0"' in request and not hasattr(complete, "again") and not setattr(complete, "again", 1) else ("[]", 2, 3)

    got = enrich.call(enrich.requests(batched(spark)).coalesce(1), complete, attempts=2).orderBy("batch").collect()
    assert (got[0].response, got[0].input_tokens, got[0].attempts) == ("[]", 3, 2)
    assert (got[1].response, got[1].attempts) == (None, 2)


def test_resume_is_a_suffix_and_second_sample_is_disjoint(spark):
    df = batched(spark, 200).drop("batch", "pos")
    whole = enrich.plan_batches(df, 50, 4, 42).orderBy("pos").collect()
    rest = enrich.plan_batches(df, 50, 4, 42, skip=20).orderBy("pos").collect()
    assert [r.row_id for r in rest] == [r.row_id for r in whole][20:] and len(whole) == 50
    second = enrich.plan_batches(enrich.remaining(df, spark.createDataFrame(whole)), 50, 4, 123).collect()
    assert not {r.row_id for r in second} & {r.row_id for r in whole}


def test_cycle_is_short_at_the_end(spark):
    topics = spark.createDataFrame([(k, f"t{k}") for k in range(10)], "pos int, topic string")
    got = pd.DataFrame(enrich.cycle(topics, 4, 4, 0).collect(), columns=["pos", "batch", "topic"]).groupby("batch").size().to_dict()
    assert got == {0: 4, 1: 4, 2: 2, 3: 4}
    assert enrich.cycle(topics.limit(0), 4, 4).count() == 0


def test_a_failed_attempt_is_charged(spark):
    class Failed(Exception):
        took = (5, 2)

    def complete(request):
        if request == "x":
            raise Failed
        return "done", 1, 1

    got = {r.batch: (r.response, r.input_tokens, r.output_tokens, r.attempts) for r in enrich.call(spark.createDataFrame([(0, "x"), (1, "y")], "batch long, request string"), complete).collect()}
    assert got == {0: (None, 15, 6, 3), 1: ("done", 1, 1, 1)}


def test_items_without_text_are_left_out(spark):
    items = spark.createDataFrame([(1, "a", "b"), (2, "", "b"), (3, "a", None), (4, " ", "b")], "id int, instruction string, output string")
    assert sorted(r.id for r in enrich.filled(items).collect()) == [1, 4]
