import pytest
from pyspark.sql import functions as F

from tarazu.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, wanted", [("a\t\tb", "a b"), ("a\n\n\n\nb", "a\n\nb"), (" x ", "x"), ("​x", "​x"), (" \x1c x　", "x"), ("", "")])
def test_clean_whitespace(spark, text, wanted):
    assert one(spark, text, tx.clean_whitespace) == wanted


def test_clean_whitespace_twice_is_once(spark):
    for text in (" a \n\n\n\n b\t c ", " x ", "\n\n\n"):
        once = one(spark, text, tx.clean_whitespace)
        assert one(spark, once, tx.clean_whitespace) == once


def test_strip_equals_python_below_11000(spark):
    signs = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c, f"{c}x{c}") for c in signs], "c string, t string").select("c", tx.strip("t").alias("t")).collect()
    assert [r.c for r in got if r.t != f"{r.c}x{r.c}".strip()] == []


@pytest.mark.parametrize("text, ratio", [("پاکستان", 1.0), ("ta تعطیلات abc", 0.5833), ("پاکستان zindabad", 0.4667), ("hello دنیا world test", 0.2222), ("123", 0.0), ("", 0.0)])
def test_script_ratio(spark, text, ratio):
    assert one(spark, text, tx.script_ratio) == pytest.approx(ratio, abs=1e-4)


@pytest.mark.parametrize("text, wanted", [("hello دنیا world test", "hello world test"), ("ta تعطیلات abc", "ta تعطیلات abc"), ("", "")])
def test_strip_script(spark, text, wanted):
    assert one(spark, text, tx.strip_script) == wanted


def test_user_message(spark):
    df = spark.createDataFrame([("do", "  "), ("do", " ctx"), ("do", None)], "i string, n string")
    assert [r[0] for r in df.select(tx.user_message("i", "n")).collect()] == ["do", "do\n\n ctx", "do"]


def test_half_percentages_go_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (0.0,), (1.0,)], "r double")
    assert [r[0] for r in df.select(tx.percent(F.col("r"))).collect()] == ["12%", "38%", "0%", "100%"]


def test_language_name_variants(spark):
    df = spark.createDataFrame([("Urdu",), ("URD",), ("Central Kurdish",), ("urd",)], "l string")
    rows = df.select(*[tx.names_urdu("l", v).alias(v) for v in "abc"]).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (True, True, False), (False, True, False), (True, True, True)]


def test_fences_outermost_and_map(spark):
    assert one(spark, "```json\n[1]\n```", tx.strip_fences) == "[1]"
    assert one(spark, "a ``` b", tx.strip_fences) == "a ``` b"
    assert one(spark, "Sure: {x {y} z} done", lambda c: tx.outermost(c, "{", "}")) == "{x {y} z}"
    assert one(spark, "} {", lambda c: tx.outermost(c, "{", "}")) is None
    assert one(spark, "چاء", lambda c: tx.char_map(c, {"چ": "ch", "ا": "a", "ء": ""})) == "cha"
    with pytest.raises(ValueError):
        tx.char_map("x", {"a": "ab"})


def test_template_and_preview(spark):
    got = one(spark, "u", lambda c: tx.chat_template(tx.chat_messages(F.lit("s"), c, F.lit("a"))))
    assert got == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert one(spark, "abcdef", lambda c: tx.preview(c, 3)) == "abc..."
    assert one(spark, "abc", lambda c: tx.preview(c, 3)) == "abc"
