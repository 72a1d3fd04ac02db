import random

import pytest

from tarazu.llm import languages
from tarazu.llm.answers import is_empty_answer, sentences

SAID = {
    "urdu_script": "آج بازار میں بہت رش تھا اور لوگ خریداری کر رہے تھے", "roman_urdu": "Aaj bazaar mein bohat rush tha aur log khareedari kar rahe thay", "english": "The market was very crowded today and people were out shopping",
    "hindi": "आज बाज़ार में बहुत भीड़ थी और लोग खरीदारी कर रहे थे", "arabic": "كان السوق مزدحما جدا اليوم وكان الناس يشترون من المتاجر", "persian": "امروز بازار بسیار شلوغ بود و مردم در حال خرید بودند",
}


def shuffled(lang, rng):
    w = SAID[lang].split()
    rng.shuffle(w)
    return " ".join(w) + "."


@pytest.fixture(scope="module")
def machines():
    rng = random.Random(1)
    rows = []
    for lang in SAID:
        for k in range(60):
            label = lang if k % 8 else rng.choice(sorted(SAID))  # an eighth is mislabelled
            rows.append((label, " ".join(shuffled(lang, rng) for _ in range(3))))
    return languages.fit(rows)


def test_held_out_accuracy(train):
    """Machines fitted on some rows agree with nearly all right labels of others. Labels
    are wrong in part, so agreement is counted against the share that single-script
    languages show, whose labels need no machine."""
    rows = [(r.label, r.output) for r in train.select(languages.label_language().alias("label"), "output").where("output is not null").collect()]
    rows = [r for r in rows if r[0] in languages.LANGUAGES and not is_empty_answer(r[1])]
    fitted = languages.fit(rows[::2])
    ask = [(lang, fitted.languages(sentences(t))) for lang, t in rows[1::2]]
    assert sum(got == {lang} for lang, got in ask) > 0.85 * len(ask)


@pytest.mark.parametrize("lang", sorted(SAID))
def test_single_language(machines, lang):
    assert machines.languages([SAID[lang]]) == {lang}
    name, sure, n = machines.language(SAID[lang])
    assert name == lang and 0.6 < sure <= 1 and n > 5


def test_stretches_and_mixtures(machines):
    text = f"{SAID['english']}. {SAID['english']}.\n\n{SAID['urdu_script']}۔ ```\ndef f(x):\n    return x\n```\n{SAID['hindi']}।"
    got = machines.stretches(text)
    assert [(x[0], x[2]) for x in got] == [("english", 2), ("urdu_script", 1), ("hindi", 1)]
    assert machines.languages(sentences(text)) == {"english", "urdu_script", "hindi"}
    loans = f"{SAID['urdu_script']} computer network۔ steps دیکھیں۔"
    assert machines.languages(sentences(loans)) == {"urdu_script"}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("Urdu-Script ", " roman urdu", "ENGLISH", "code mixed", "und", "", None, "n/a", "deutsch")], "lang string")
    assert [r[0] for r in df.select(languages.label_language()).collect()] == ["urdu_script", "roman_urdu", "english", "code_mixed", None, None, None, None, None]


def test_cases(make_train, machines):
    both = f"{SAID['english']}. {SAID['hindi']}।"
    rows = [
        ("english", SAID["english"], None), ("urdu_script", SAID["english"], {"english"}), (None, SAID["persian"], {"persian"}), ("code_mixed", SAID["arabic"], {"arabic"}), ("Code-Mixed", both, None), ("hindi", both, {"english", "hindi"}),
        (None, None, None), (None, "", None), (None, "N/A", None), (None, "12345", None), (None, "Answer:", None), (" ", SAID["hindi"], {"hindi"}), ("hindi", SAID["hindi"] * 4000, None),
    ]
    df = make_train(*[{"row_id": k, "lang": a, "output": b} for k, (a, b, _) in enumerate(rows)])
    got: dict = {}
    for r in languages.wrongly_labelled(df.unionByName(df), machines).collect():
        assert r.lang not in got.setdefault(r.row_id, set())
        got[r.row_id].add(r.lang)
    assert got == {k: c for k, (_, _, c) in enumerate(rows) if c}


def test_nothing_to_learn_from(make_train):
    assert languages.wrongly_labelled(make_train()).count() == 0
    assert languages.stretches(make_train({"row_id": 1, "output": "12", "lang": "english"})).count() == 0
    alone = make_train({"row_id": 1, "output": SAID["hindi"], "lang": None}, {"row_id": 2, "output": SAID["english"], "lang": "english"})
    assert {r.row_id: r.lang for r in languages.stretches(alone).collect()}[1] == "hindi"


@pytest.mark.parametrize("text, empty", [(None, True), ("", True), (" \n", True), ("​", True), ("N/A", True), ("null", True), ("Answer:", True), ("## Jawab\n", True), ("جواب:", True), ("[ ]", True), ("---", True), ("<|im_end|>", True), ("?", True), ("-" * 999, True), ("### Summary", True), ("خلاصہ:", True), ("Note: yes", False), ("# one\ntwo", False), ("No.", False), ("238", False), ("haan", False), ("ہاں", False), ("Answer: 5", False), ("x" * 300, False)])
def test_empty_answers(text, empty):
    assert is_empty_answer(text) == empty
