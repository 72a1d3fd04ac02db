import pytest

from tarazu.operators import clean, combine, ingest
from tarazu.operators import format as fmt

R, U = "redgerd-roman", "urdu-instruct-roman"
LONG = "a long enough answer, really"
CASES = [
    ("  ", "", "some answer text here", "x", "empty_field"),
    ("Hi", "", "yo", "x", "too_short"),
    (" hI ", "", LONG, "x", "duplicate"),
    ("Q", "x" * 17, "ab", "x", None),
    ("Q2", "", "y" * 4998, "x", None),
    ("Q3", "", "y" * 4999, "x", "too_long"),
    ("پاکستان zindabad", "", "kya haal hai dosto", R, None),
    ("ta تعطیلات abc", "", "kya haal hai", R, None),
    ("yeh meri abc دنیا", "", "ok دن fine", U, None),
    ("دن abcd", "", LONG, R, "roman_cleanup_empty"),
    ("hello world this is", "", "english only answer", "aya-urdu", "low_urdu_ratio"),
    ("یہ سوال کیا ہے", "", "1234567890 1234567890", "urdu-instruct", None),
    ("hello world there is", "", "english only answer", R, None),
    (None, None, None, None, "empty_field"),
    ("q" * 100, None, "null input and source", None, None),
]


@pytest.fixture(scope="module")
def tagged(spark):
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "row_id long, instruction string, input string, output string, source string")
    return {r.row_id: r for r in clean.tag(df.repartition(5)).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_reason(tagged, k):
    assert tagged[k].reason_code == CASES[k][4]


def test_rewrites_and_reason_text(tagged):
    assert tagged[6].instruction == "zindabad"
    assert tagged[7].instruction == "ta تعطیلات abc"
    assert (tagged[8].instruction, tagged[8].output) == ("yeh meri abc", "ok fine")
    assert tagged[10].removal_reason == "low_urdu_ratio (instr:0%, out:0%)"


def test_conservation_and_order(spark, data):
    t = spark.read.parquet(f"{data}/train.parquet").select("row_id", "instruction", "input", "output", "source")
    one, many = clean.tag(t.coalesce(1)), clean.tag(t.repartition(16))
    assert clean.kept(one).count() + clean.removed(one).count() == t.count()
    assert sorted(map(tuple, one.select("row_id", "removal_reason").collect()), key=str) == sorted(map(tuple, many.select("row_id", "removal_reason").collect()), key=str)
    kept = clean.kept(one)
    s = clean.statistics(one).first()
    assert s.n_kept == kept.count() == sum(s.kept_by_source.values())
    assert s.n_removed == sum(s.removal_reasons.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "row_id long, instruction string, input string, output string, source string, extra string")
    t = clean.tag(empty)
    assert t.count() == 0 and clean.totals(t).first().kept_share is None
    assert clean.reason_counts(t).count() == 0 and ingest.counts_by_source(clean.kept(t)).count() == 0


def test_unify_takes_the_first_present_column(spark):
    df = spark.createDataFrame([(1, None, "p1", " r1 "), (2, "i2", "p2", "r2"), (3, "  ", "p3", "r3")], "row_id long, instruction string, prompt string, response string")
    got = ingest.unify(df, "s").orderBy("row_id").collect()
    assert [(r.row_id, r.instruction, r.output) for r in got] == [(2, "i2", "r2"), (3, "", "r3")]
    assert ingest.unify(df.drop("response"), "s").count() == 0
    assert ingest.in_urdu(df).count() == 0


def test_well_sized_ignores_input(spark):
    df = spark.createDataFrame([("abc", "x" * 100, "de"), ("a" * 10, "", "b" * 10), (" ", "", "y" * 50), (None, "", "y" * 50)], "instruction string, input string, output string")
    assert [r.instruction for r in combine.well_sized(df).collect()] == ["a" * 10]


def test_token_window(spark):
    df = spark.createDataFrame([(2048,), (2049,)], "n_tokens int")
    assert [r[0] for r in fmt.within(df).collect()] == [2048]
