import pytest
from pyspark.sql import functions as F

from tarazu.operators import judge, profile, trainlog

# Wins, losses and ties of four judges by category.
COUNTS = {
    "translation": [(12, 0, 3), (12, 1, 2), (10, 0, 5), (12, 3, 0)], "code_mixed": [(4, 0, 1), (4, 0, 1), (2, 0, 3), (5, 0, 0)], "qa": [(16, 2, 3), (17, 3, 1), (12, 5, 4), (15, 5, 1)],
    "creative": [(8, 3, 0), (10, 0, 1), (10, 0, 1), (10, 1, 0)], "code_explanation": [(6, 1, 3), (6, 1, 3), (2, 1, 7), (9, 1, 0)], "reasoning": [(9, 4, 3), (9, 4, 3), (4, 3, 9), (5, 8, 3)],
    "summarization": [(6, 4, 1), (5, 5, 1), (4, 2, 5), (8, 3, 0)], "grammar": [(4, 5, 2), (4, 4, 3), (4, 5, 2), (2, 8, 1)],
}
MEDIANS = {"translation": 80.0, "code_mixed": 80.0, "qa": 73.81, "creative": 90.91, "code_explanation": 60.0, "reasoning": 43.75, "summarization": 50.0, "grammar": 36.36, "overall": 65.5}


@pytest.fixture(scope="module")
def rates(spark):
    rows = [(f"j{k}", c, w) for c, by in COUNTS.items() for k, n in enumerate(by) for w, x in zip(judge.WINNERS, n) for _ in range(x)]
    rows += [("j0", "qa", "Finetuned"), ("j0", "qa", None), ("j0", "qa", " tie")]
    return judge.win_rates(spark.createDataFrame(rows, "judge string, category string, winner string")).cache()


def test_medians_and_deltas(spark, rates):
    base = spark.createDataFrame([("qa", 61.9), ("overall", 51.5)], "category string, v1 double")
    got = {r.category: r for r in judge.across_judges(rates, base).collect()}
    assert {c: round(r["median"], 2) for c, r in got.items()} == MEDIANS
    assert got["qa"].delta == pytest.approx(11.91, abs=0.01) and got["overall"].delta == pytest.approx(14.0) and got["grammar"].delta is None
    assert (got["overall"].lowest, got["overall"].highest) == (48.0, 67.0)


def test_unknown_verdicts_count_nowhere(rates):
    r = rates.where("judge = 'j0' and category = 'qa'").first()
    assert (r.finetuned, r.base, r.tie, r.total) == (16, 2, 3, 21)


def test_no_known_verdict_is_zero(spark):
    r = judge.win_rates(spark.createDataFrame([("j", "qa", None)], "judge string, category string, winner string")).collect()
    assert {x.category: (x.total, x.ft_pct) for x in r} == {"qa": (0, 0.0), "overall": (0, 0.0)}


def test_eval_join(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "id int, response string, seq int")
    got = judge.join_eval(p, a, a.where("id = 1"))
    assert [(r.id, r.base_response, r.finetuned_response) for r in got.collect()] == [(1, "y", "y")]
    with pytest.raises(ValueError):
        judge.check_complete(p, got)


def test_asof(spark):
    steps = spark.createDataFrame([(10, 2.0), (490, 1.2), (500, 1.15)], "step long, loss double")
    evals = spark.createDataFrame([(500, 1.0), (5, 1.1), (250_000, 0.9)], "step long, eval_loss double")
    got = {r.step: r.loss_asof for r in trainlog.asof(evals, steps, "step", "loss").collect()}
    assert got == {500: 1.15, 5: None, 250_000: 1.15}
    narrow = {r.step: r.loss_asof for r in trainlog.asof(evals, steps, "step", "loss", span=7).collect()}
    assert narrow == got


def test_trend_best_and_epochs(spark):
    e = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.905), (4, 0.93)], "step long, eval_loss double")
    assert [r.trend for r in trainlog.trend(e).orderBy("step").collect()] == ["", "improving", "plateau", "<< EVAL RISING"]
    b = trainlog.best_and_last(e).first()
    assert (b.best_step, b.best_loss, b.last_loss, b.overfit) == (2, 0.9, 0.93, True)
    assert [r.boundary for r in trainlog.epochs(e.withColumn("step", F.col("step") * 3)).orderBy("epoch").collect()] == [4, 8, 12]


@pytest.mark.parametrize("n", [50, 51, 200])
def test_smoothing(spark, n):
    df = spark.range(n).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("loss"))
    got = trainlog.smoothed(df, "loss", "step", ("run",)).orderBy("step").collect()
    if n <= 50:
        assert got == []
        return
    ema = 0.0
    for k, r in enumerate(got):
        ema = r.loss if k == 0 else r.loss * 2 / 51 + ema * 49 / 51
        assert r.ema == pytest.approx(ema)


def test_first_file_wins_in_merged_history(spark):
    log = spark.createDataFrame([("checkpoint-10000", 0, 5, "train", 1.0), ("checkpoint-500", 0, 5, "train", 2.0), ("checkpoint-500", 1, 5, "eval", 3.0)], "path string, pos int, step long, kind string, value double")
    assert {(r.step, r.kind): r.value for r in trainlog.merge(log).collect()} == {(5, "train"): 1.0, (5, "eval"): 3.0}


def test_profiles_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, instruction string, input string, output string, source string")
    assert profile.length_profile(empty).count() == 0 and profile.distinct_profile(empty).count() == 0
    assert profile.low_cardinality(empty, ["source"]).count() == 0
    assert profile.compare({"none": empty}).first().n_records == 0
