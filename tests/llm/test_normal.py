import itertools

import pytest

from tarazu.llm import normal
from tarazu.llm.normal import consistent

SAME = [
    ("Agar Samihagerdera", "Aｇａｒ Ｓａmｉｈａgeｒｄｅra"), ("اس لیے یاروکومونزار", "اس ﻟیے یﺎﺭﻭکومونﺰﺍﺭ"), ("aur roz", "aur   roz "), ("istemal hon", "istemаl hоn"), ("آج کل کا", "آج كل كا"),
    ("عجیب", "عجيب"), ("کی کمی", "كى كمى"), ("۱۹ سال", "١٩ سال"), ("گئے", "گئے"), ("آباد", "آباد"), ("zyada", "zy​ad­a"), ("café", "cafе́"), ("a\nb", " a b"), ("Map()", "Мар（）"), ("ok", "ok﻿"), ("café", "cafe͏́"),
]
DIFFERENT = [("Bhai", "bHAI"), ("کے بارے", "کے بَارے"), ("hai.", "hai!"), ("a b", "ab"), ("کمی", "کمي"), ("ایک", "ايك"), ("۴۵۶", "٤٥٦"), ("12", "۱۲"), ("x²", "x2"), ("۔", "."), ("Москва", "Mockba")]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert consistent(a) != consistent(b)


def test_one_form_is_final(train):
    for r in train.select("instruction", "output").collect():
        for t in r:
            if t is not None:
                assert consistent(consistent(t)) == consistent(t)


def test_script_spelling():
    assert consistent("Mосквa") == "Москва"  # one script that can write all letters
    assert consistent("сор") == "cop" and normal.scripts("сop") == set() and normal.scripts("cop") == {"Latn"}
    assert consistent("Привет мир") == "Привет мир"


@pytest.mark.parametrize("a, b", [("Ꭺpple", "Apple"), ("ꓐob", "Bob"), ("ραy", "pay"), ("ⲟne", "one"), ("Ⅷ", "VIII"), ("ոο", "no"), ("Ꮮⲟck", "Lock"), ("کаfe", "کafe")])
def test_look_alikes_of_any_script(a, b):
    assert consistent(a) == consistent(b) == b


@pytest.mark.parametrize("text", ["Москва сухо", "сухо в Москве", "Это хор и рост, а не сон.", "Καλή αγορά του Μάη", "Ես օր ունեմ"])
def test_real_text_of_other_scripts_stays(text):
    assert consistent(text) == text


def test_neighbours_decide():
    assert consistent("the сор is дом") == "the cop is дом" and consistent("дом cop") == consistent("дом сор") == "дом сор"
    assert normal.resolved("Mосква") == {"Cyrl"} and normal.scripts("Mосква") == set() and {"Latn", "Cyrl"} <= normal.resolved("сор")
    long = "а" * 300 + " " + "сон " * 20_000
    assert consistent(f"дом {long}") == f"дом {long}".strip() and consistent(f"find {long}").isascii()


def brute(rows):
    out = set()
    for (i, a, b), (j, c, d) in itertools.combinations(rows, 2):
        if None not in (a, b, c, d) and i != j and (a, b) != (c, d) and consistent(a) == consistent(c) and consistent(b) == consistent(d):
            out.add((min(i, j), max(i, j)))
    return out


def test_pairs_equal_brute_force(train):
    rows = [tuple(r) for r in train.select("row_id", "instruction", "output").collect()]
    got = [tuple(r) for r in normal.same_looking_pairs(train).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hot_group_nulls_and_repeats(make_train):
    rows = [(k, "same", "x y") for k in range(200)] + [(200, "same", "x  y"), (201, "sаme", "x y"), (202, None, "x y"), (203, "same", None), (204, "", ""), (205, "", " "), (5, "same", "x y")]
    df = make_train(*[{"row_id": i, "instruction": a, "output": b, "category": "z"} for i, a, b in rows]).repartition(7)
    got = {tuple(r) for r in normal.same_looking_pairs(df).collect()}
    assert got == brute(rows) and (204, 205) in got and len(got) == 2 * 200 + 2
    classes = {r.row_id: (r.class_id, r.n_spellings) for r in normal.same_looking_classes(df).collect()}
    assert classes[201] == (0, 3) and classes[205] == (204, 2) and 202 not in classes


def test_a_class_over_several_tasks(make_train, monkeypatch):
    monkeypatch.setattr(normal, "CLASS_ROWS", 7)
    rows = [(k, "same", "x" + " " * (k % 3) + " y") for k in range(60)]
    got = [tuple(r) for r in normal.same_looking_pairs(make_train(*[{"row_id": i, "instruction": a, "output": b} for i, a, b in rows])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_nothing(make_train):
    assert normal.same_looking_pairs(make_train()).count() == 0
    assert normal.consistent_fields(make_train({"row_id": 1, "instruction": None, "output": "ａ"})).first()[:] == (1, None, "a")
