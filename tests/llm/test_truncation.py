import random

import pytest

from tarazu.llm import truncation

TEMPLATES = ["The trade in {a} between the towns has gone on for {n} years", "People here prefer {a} over {b} for everyday use", "First look at the {a}, then arrange the {b} with care", "اس لیے یہاں ہر سال {n} نئے {u} بنائے جاتے ہیں", "ایک طرف {u} ہے اور دوسری طرف {v}، دونوں ہی شہر کی پہچان ہیں"]


def whole(rng):
    f = {"a": rng.choice(["tea", "glass", "paper", "honey"]), "b": rng.choice(["rice", "salt", "iron"]), "n": rng.randrange(9, 99), "u": rng.choice(["پل", "باغ", "مدرسہ"]), "v": rng.choice(["بازار", "دریا"])}
    return rng.choice(TEMPLATES).format(**f)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    stop = lambda s: s + ("۔" if s[-1] > "z" else ".")
    return [" ".join(stop(whole(rng)) for _ in range(4)) for _ in range(400)]


TAILS = [
    ("People here prefer tea over", True), ("People here prefer tea over rice for everyday use", False), ("People here prefer tea over rice for everyday u", True), ("First look at the honey, then arr", True), ("ایک طرف پل ہے اور دوسری طرف", True), ("اس لیے یہاں ہر سال 12 نئے باغ بنائے جاتے ہیں", False), ("اس لیے یہاں ہر سال 12 نئے باغ بنائے جات", True),
    ("```python\nx = [1, 2", True), ("```python\nx = 1\n```", False), ("People here prefer tea over rice for everyday use.\n\n— Salim", False), ("People here prefer tea over rice for everyday use. 🙂", False), ("People here prefer tea over rice for everyday use…", False), ("People here prefer tea over…", True), ("People here prefer te�", True),
    ("People here prefer tea over rice for everyday use.\nTHE END", False), ("People here prefer tea over rice for everyday use.\n*****", False), ("First look at the tea, then arrange the salt with care.<|im_end|>\n<|im_sta", True), ("<|im_start|>user\nPeople here prefer tea over rice for everyday use.<|im_end|>", False),
]


def test_tails(make_documents, corpus):
    texts = [*corpus, *[f"{corpus[k]}\n\n{t}" for k, (t, _) in enumerate(TAILS)]]
    got = {r.doc_id - len(corpus) for r in truncation.cut_documents(make_documents(*texts).repartition(3)).collect()}
    assert got == {k for k, (_, cut) in enumerate(TAILS) if cut}


def test_padding_and_case_of_forms(make_documents, corpus):
    texts = [*corpus, f"{corpus[0]} Peоple here prefer tea over{' ' * 90}", f"{corpus[0]} Ｐｅｏｐｌｅ here prefer tea over rice for everyday use{' ' * 90}\n", f"{corpus[0]} ایک طرف پل ہے اور دوسري طرف"]
    got = {r.doc_id - len(corpus) for r in truncation.cut_documents(make_documents(*texts)).collect()}
    assert got == {0, 2}


def test_nulls_repeats_and_nothing(make_documents, corpus):
    d = make_documents(None, "", " \n ", *corpus, "People here prefer tea over", "x", "y " * 100_000)
    rows = truncation.cut_documents(d.unionByName(d)).collect()
    assert len(rows) == len(set(rows)) and 3 + len(corpus) in {r.doc_id for r in rows} and not {0, 1, 2} & {r.doc_id for r in rows}
    assert truncation.signs(d).count() == d.count() - 3
    assert truncation.cut_documents(d.limit(0)).count() == 0 and truncation.cut_shares(d.limit(0)).count() == 0
    share = truncation.cut_shares(d).first()
    assert share.n_texts == d.count() - 3 and share.cut_share == share.n_cut / share.n_texts


def test_known_words_in_an_open_place_are_whole(make_documents):
    """A list slot seen often, and a known noun that it never held before."""
    nouns = [f"noun{chr(97 + k)}{chr(97 + k)}x" for k in range(9)]
    items = [f"- old {n}" for n in nouns[:8]] * 6
    other = [f"- new {n}" for n in nouns] * 6
    lists = ["\n".join(items[k : k + 4]) for k in range(0, len(items), 4)] + ["\n".join(other[k : k + 3]) for k in range(0, len(other), 3)]
    texts = [*[f"{x}\nThat is the list." for x in lists], f"- old {nouns[0]}\n- old {nouns[8]}"]
    assert truncation.cut_documents(make_documents(*texts)).count() == 0


def test_trigrams_decide_most_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    signs = [r.sign for r in truncation.signs(documents).where("sign is not null").collect()]
    by_words = [x for x in signs if x.split()[0] in ("trigram", "bigram", "word")]
    assert sum(x.startswith("trigram") for x in by_words) > 0.6 * len(by_words) and not {"unknown"} & set(signs)


def test_long_words_and_long_ends(make_documents, corpus):
    """Words beyond 60 letters, and references longer than 300 characters after a text."""
    name = "q" + "ab" * 50
    known = [f"We met in {name} today." for _ in range(6)]
    ends = " ".join(f"[{k}]" for k in range(200))
    got = {r.doc_id for r in truncation.cut_documents(make_documents(*corpus, *known, f"{corpus[0]} We met in {name[:-20]}", f"{corpus[0]} {ends}", f"{corpus[1]}\n--")).collect()}
    assert got == {len(corpus) + len(known)}
