import pytest
from pyspark.sql import functions as F

from tarazu.llm import mixing
from tarazu.llm.tokens import encoder


@pytest.fixture(scope="module")
def targets(spark):
    rows = [("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "c", 0.2, 3), ("gap", "a", 0.6, 2), ("gap", "none", 0.4, 2), ("odd", None, 1.0, 1), ("bad", "a", 0.0, 1)]
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    source = F.when(n % 10 < 7, "a").when(n % 10 < 9, "b").otherwise("c")
    return spark.range(3000).select(n.alias("row_id"), source.alias("source"), (20 + F.pmod(F.xxhash64("id"), F.lit(300))).cast("int").alias("n_tokens"), F.repeat(F.lit("x"), 900).alias("text"), F.lit("e").alias("part"))


@pytest.mark.parametrize("bucket", [50, 50_000])
def test_shares_and_caps(rows, targets, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    got = {(r.mix_name, r.source): r for r in mixing.mix_shares(rows, targets).collect()}
    whole = sum(r.n_tokens for (m, _), r in got.items() if m == "m")
    for (m, s), r in got.items():
        if m == "m":
            assert abs(r.share - r.target_share) < 2 * 320 / whole
            assert r.most_repeats <= r.max_repeats
    assert got["gap", "none"].share == 0 and got["gap", "a"].share == 1 and got["gap", "a"].most_repeats == 2
    assert got["m", "c"].most_repeats == 3 or got["m", "b"].most_repeats == 4 or got["m", "a"].n_records == 2100


def test_same_result_wherever_rows_lie(rows, targets):
    one = sorted(map(tuple, mixing.mix_records(rows.coalesce(1), targets).collect()))
    assert one == sorted(map(tuple, mixing.mix_records(rows.repartition(11), targets).collect()))
    assert len({(m, i) for m, i, *_ in one}) == len(one)


def test_sizes_that_are_not_stated_and_nothing(spark, rows, targets, make_train, vocabulary_path):
    bad = make_train(*[{"row_id": k, "source": s, "n_tokens": n, "text": t} for k, (s, n, t) in enumerate([("a", None, "x"), ("a", 0, "x"), ("a", -3, "x"), ("a", 99, "short"), ("a", 1, "y" * 999), (None, 5, "x" * 9), ("a", 5, None), ("a", 5, "x" * 9)])])
    exact = encoder(vocabulary_path).encode
    assert {r.row_id: r.n_tokens for r in mixing.sizes(bad).collect()} == {0: 1, 1: 1, 2: 1, 3: len(exact("short")), 4: len(exact("y" * 999)), 6: 5, 7: 5}
    blank = make_train({"row_id": 1, "source": "a"}, {"row_id": 2, "source": "a", "text": ""}, {"row_id": 3, "source": "a", "instruction": "some words", "output": "more"})
    assert {r.row_id: r.n_tokens for r in mixing.sizes(blank).collect()} == {1: None, 2: None, 3: len(exact("some words\nmore"))}
    assert {(r.mix_name, r.source): r.n_not_weighed for r in mixing.mix_shares(blank, targets).collect()}["m", "a"] == 2
    assert mixing.mix_records(make_train(), targets).count() == 0
    assert mixing.mix_records(rows, targets.limit(0)).count() == 0
    none = mixing.mix_shares(make_train(), targets).collect()
    assert len(none) == 7 and all(r.share == 0 for r in none)


def test_rounding_is_unbiased(rows, targets):
    """Over seeds a record is chosen about as often as its fraction says."""
    p = {r.source: r.copies for r in mixing.plan(mixing.sizes(rows), targets.where("mix_name = 'm'")).collect()}
    hits = sum(mixing.mix_records(rows.where("row_id < 400"), targets.where("mix_name = 'm'"), seed).where("source = 'a'").count() for seed in range(6))
    small = {r.source: r for r in mixing.plan(mixing.sizes(rows.where("row_id < 400")), targets.where("mix_name = 'm'")).collect()}["a"]
    assert p and abs(hits / 6 - min(1, small.copies) * small.n_records) < 20


def test_more_targets_than_are_broadcast(rows, targets, monkeypatch):
    few = sorted(map(tuple, mixing.mix_records(rows, targets).collect()))
    monkeypatch.setattr(mixing, "PLAN_ROWS", 2)
    assert sorted(map(tuple, mixing.mix_records(rows, targets).collect())) == few
