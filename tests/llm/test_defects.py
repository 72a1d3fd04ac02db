import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tarazu.llm import blocks, defects, descent
from tarazu.llm.answers import is_empty_answer, lines

URDU, ROMAN, ENGLISH = "یہاں کے استاد بچوں کو پہاڑ اور شیشہ کا فرق سمجھاتے ہیں", "Yahan ke ustad bachon ko pahar aur sheesha ka farq samjhate hain", "Teachers here explain the difference between rice and glass to children"
ASK = "Explain the benefits of tea with an example from the town."


@pytest.fixture(scope="module")
def vote(train):
    return defects.fit_votes(defects._sampled(train))


CASES = [
    (ASK, None, f"{ENGLISH}.", None), (ASK, None, None, "empty_answer"), (ASK, None, "", "empty_answer"), (ASK, None, "N/A", "empty_answer"), (ASK, None, "## Answer\n", "empty_answer"), ("Yes or no?", None, "No.", None), ("How many?", None, "42", None),
    (ASK, None, ASK, "copied_question"), (ASK, None, f'"{ASK[:-1]}"', "copied_question"), (ASK, None, f"Question: {ASK}", "copied_question"), (ASK, None, f"{ASK} {ASK}", "copied_question"), (ASK, "some input text", f"{ASK}\n\nsome input text", "copied_question"),
    (ASK, None, f"You asked: {ASK} {ENGLISH}.", None), ("Fix: he go home.", None, "he go home.", None),
    (ASK, None, "I'm sorry, but I can't help with the benefits of tea.", "refusal"), (ASK, None, "As a language model, I am unable to answer this question.", "refusal"), ("چائے کے بارے میں بتائیں۔", None, "معذرت، میں اس سوال کا جواب نہیں دے سکتا۔", "refusal"),
    ("Chai ke baray mein batayein.", None, "Maazrat, main is sawal ka jawab nahi de sakta.", "refusal"), ("How do I politely decline?", None, f"You may say: 'I'm sorry, but I can't help with that.' {ENGLISH}.", None),
    (ASK, None, f"{ENGLISH}. Teachers here explain the diff", "truncated_answer"), (ASK, None, f"{ENGLISH}.\n\n```python\nx = 1\nprint(", "truncated_answer"), (ASK, None, ENGLISH, None), (ASK, None, f"{ENGLISH}. 🙂", None), (ASK, None, f"{ENGLISH}. (Town)", None),
    (ASK, None, f"{URDU}۔ {URDU}۔", "other_language"), ("شہر کے بارے میں بتائیں کہ وہاں کیا ہوتا ہے۔", None, f"{ROMAN}. {ROMAN}.", None), ("اس جملے کا انگریزی میں ترجمہ کریں: یہاں کے استاد اچھے ہیں۔", None, f"{ENGLISH}.", None), (ASK, None, f"{URDU}۔ {ENGLISH}.", None),
]


def test_cases(make_train, train, vote, monkeypatch):
    sample = defects._sampled(train)
    monkeypatch.setattr(defects, "_sampled", lambda t: sample)
    monkeypatch.setattr(defects, "fit_votes", lambda sample: vote)
    shared = ["row_id", "instruction", "input", "output"]
    own = make_train(*[{"row_id": 10**9 + k, "instruction": q, "input": g, "output": a} for k, (q, g, a, _) in enumerate(CASES)], {"row_id": 5 * 10**9, "instruction": None, "output": None}).select(*shared)
    got = {r.row_id - 10**9: r.defect for r in defects.defective(train.select(*shared).unionByName(own)).collect() if r.row_id >= 10**9}
    assert got == {k: c[3] for k, c in enumerate(CASES) if c[3]}


def by_name(vote, *pair):
    """Votes of the functions that need no counts."""
    return [dict(zip(defects.FUNCTIONS[d], v)) for d, v in zip(defects.DEFECTS, vote(*pair)[0])]


def test_several_labels_stay(make_train, vote):
    v = by_name(vote, ASK, None, f"{URDU}۔ یہاں کے استاد بچوں کو پہا")
    assert v[3]["machine"] == 1 and v[4]["machines"] == 1


def test_broken_words_are_looked_up_in_all_outputs(make_train, vote):
    """A word that the sample of the machines doesn't hold, and longer than any limit."""
    name = "Qazbar" + "abad" * 20
    whole = [{"row_id": k, "instruction": ASK, "output": f"We met many friends in {name} this year."} for k in range(5)]
    last = {5: "Qazbar", 6: name[:-1], 7: name, 8: "Qozbar"}
    rows = make_train(*whole, *[{"row_id": k, "instruction": ASK, "output": f"{ENGLISH}. We met many friends in {w}"} for k, w in last.items()])
    got = {r.row_id: r.truncated_answer // 3 % 3 - 1 for r in defects.votes(rows, vote).collect()}
    assert len(got) == 9 and {k for k, v in got.items() if v == 1} == {5, 6}


def test_a_word_before_dots_is_not_counted():
    assert list(defects._finished_words("One two. Three fou...")) == [("One", False), ("two", True)] and list(defects._finished_words("- One 12.\n- Two")) == [("One", False), ("0", True)]


@pytest.mark.parametrize("text", ["N/A " * 20, "N/A " * 60, "Answer: " * 500, "- - " * 200, "جواب: " * 80])
def test_empty_answers_of_any_length(vote, text):
    assert is_empty_answer(text) and not is_empty_answer(f"{text} {ENGLISH}")
    assert by_name(vote, ASK, None, text)[0]["vocabulary"] >= 0


def test_no_function_stops_at_a_border(vote):
    """Signs behind many sentences and characters: a block left open, a refusal, quotes, function words."""
    long = f"{ENGLISH}. " * 60
    assert by_name(vote, ASK, None, f"{long}\n```python\nx = (")[3]["open block"] == 1
    assert by_name(vote, ASK, None, f"{long} I can't help with that.")[2]["declining phrase"] == 1
    assert by_name(vote, ASK, None, f"{long} You may say: 'I am sorry, I can't help.'")[2]["declining phrase"] == -1
    assert by_name(vote, ASK, None, f"{ENGLISH}. ({'a long aside, ' * 20})")[3]["machine"] == -1
    mixed = by_name(vote, ASK, None, f"{URDU}۔ " * 20 + f"{ENGLISH} of the town.")[4]  # an English sentence at the end: not wholly in another language
    assert mixed["machines"] == mixed["function words"] == -1


def test_the_model_is_no_single_function(spark):
    """Where no function sees every form of a defect the model's result differs from that of each."""
    rows = defects.labelling_functions(spark.read.parquet("/root/testdata/sf0.01/train.parquet")).collect()
    assert {(r.defect, r.function) for r in rows} == {(d, f) for d, names in defects.FUNCTIONS.items() for f in names}
    for d in ("empty_answer", "truncated_answer"):
        assert min(r.n_unlike_model for r in rows if r.defect == d) > 5
    assert all(0.3 <= r.cutoff <= 0.99 and r.n_voted > 0 for r in rows)
    assert all(r.found_share > 0.85 for r in rows if r.defect != "refusal")


def test_simulated_defects_are_of_every_kind(train, vote):
    made = defects.simulated(defects._sampled(train), vote.machines)
    assert {d for d, *_ in made} == set(defects.DEFECTS)
    assert all(is_empty_answer(a) for d, _, _, a in made if d == "empty_answer")


@pytest.mark.parametrize("phrase", ["لا أستطيع الإجابة.", "لا يمكنني ذلك.", "أنا غير قادر على ذلك.", "I cant do that.", "I wont do that.", "Is mein madad nahi.", "اس میں مدد نہیں۔", "I can’t."])
def test_refusal_phrases_in_the_consistent_form(vote, phrase):
    assert by_name(vote, ASK, None, phrase)[2]["declining phrase"] == 1


def test_asked_languages_in_the_consistent_form():
    assert defects._ASKED["english"].search(defects.consistent("ترجم إلى الإنجليزية")) and defects._ASKED["hindi"].search(defects.consistent("हिन्दी में"))


def test_a_refusal_after_two_polite_sentences(vote):
    late = by_name(vote, ASK, None, "Thank you for asking. What an interesting question this is. I'm sorry, but I can't help with that.")[2]
    assert late["declining phrase"] == late["talk about asking"] == 1 and late["length"] == 0
    assert by_name(vote, ASK, None, f"{ENGLISH}. " * 9 + "You cannot see it.")[2]["length"] == -1


def test_no_rows(make_train, vote):
    assert defects.votes(make_train(), vote).count() == 0 and defects.labelling_functions(make_train()).count() == 0
    assert defects.defective(make_train()).count() == 0


def test_very_long_output(vote):
    assert all(x[0] == -1 for x in vote(ASK, None, f"{ENGLISH}. " * 20_000)[0])


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.1
    right = (0.95, 0.9, 0.8)
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) for r in right], 1) * 2
    patterns, counts = np.unique(votes.astype(int), axis=0, return_counts=True)
    model = defects.LabelModel(3).fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.1) < 0.02
    for k, r in enumerate(right):
        assert abs(model.chance[k, 0, 0] - r) < 0.03 and abs(model.chance[k, 1, 2] - r) < 0.06
    p = model.posterior(votes.astype(int))
    assert ((p >= defects.cutoff(model.posterior(patterns), counts, np.zeros(0))[0]) == truth).mean() > 0.95


def test_ends_tell_cuts_on_held_out_rows(train):
    outputs = [r[0] for r in train.select("output").where("length(output) > 60").collect()]
    ends = defects.fit_ends(outputs[::2])
    whole = cut = hit = n = 0
    for t in outputs[1::2]:
        if "```" in t or not defects._STOP.search(t):
            continue
        for u in defects._UNITS.split(lines(t)):
            w, listed = defects._tokens(u)
            if len(w) > 5:
                n += 1
                whole += ends.end(w, listed) > 0.5
                cut += ends.end(w[:-2], listed) < 0.5
                hit += ends.end([*w[:-2], w[-2][:2]], listed) < 0.5
    assert n > 100 and whole > 0.9 * n and cut > 0.95 * n and hit > 0.95 * n


def test_machines_and_cutoffs_come_from_all_rows(train, monkeypatch):
    """Not from a sample: the limits of one change nothing, nor does where rows lie; the descent over blocks is that in memory."""
    whole = defects.fit_votes(train)
    monkeypatch.setattr(defects, "SAMPLED_ROWS", 3)
    monkeypatch.setattr(defects, "bounded_sample", None)
    monkeypatch.setattr(defects, "BLOCK_ROWS", 500)
    dealt = defects.fit_votes(train.repartition(5))
    for a, b in ((whole.ends, dealt.ends), (whole.refusals, dealt.refusals), (whole.machines, dealt.machines)):
        assert np.allclose(a.weights, b.weights, atol=1e-4)
    assert np.abs(whole.ends.weights).max() > 0.1 and np.abs(whole.machines.weights).max() > 0.1
    rows, y = [], []
    for r in train.where("instruction is not null and length(output) > 20").select("output").collect():
        text = defects._text(r.output)
        defects._add_ends(text, random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))), rows, y)
    assert np.allclose(defects._logistic(rows, y)[0], whole.ends.weights, atol=1e-4)
    passed = defects._passed(train, whole).persist()
    made = defects._planted_codes(passed, defects._looked_up(passed), whole)
    pairs = train.where("row_id is not null and instruction is not null").count()
    assert all(made.values()) and 0.8 * pairs < sum(sum(made[d].values()) for d in defects.PLANTED) <= pairs
    assert sum(made["other_language"].values()) > pairs


def test_blocks_vote_as_pairs_do(make_train, train, vote):
    """All texts at once, and read once, give what Votes gives of each."""
    columns = ["row_id", "lang", "instruction", "input", "output"]
    odd = [*CASES, (ASK, None, "One... two\n- 3.5 (a)b\n1. x", 0), ("", "", f"<|im_start|> {ENGLISH} <|im_end|>", 0), (ASK, None, f"say 'I can't help.' {ROMAN}. नमस्ते दुनिया यह है कि है।", 0), (ASK, None, "\uffff\ufffe\uffff a. b \uffff\ufffe\uffff c.", 0)]
    own = make_train(*[{"row_id": 10**9 + k, "instruction": q, "input": g, "output": a} for k, (q, g, a, _) in enumerate(odd)])
    rows = train.select(columns).unionByName(own.select(columns)).where("row_id is not null and instruction is not null")
    got, counted, n = {}, {}, Counter()
    for r in defects._passed(rows, vote).collect():
        if r.row_id is not None:
            got[r.row_id] = (*(r[d] for d in defects.DEFECTS), r.word)
        elif r.planted is None:
            counted[r.word] = counted.get(r.word, np.zeros(2, dtype=int)) + (r.n, r.n_ends)
    wanted = {}
    for r in rows.collect():
        codes, word, finished = vote(r.instruction, r.input, r.output)
        wanted[r.row_id] = (*map(defects._code, codes), word)
        for w in defects._unit_words(finished):
            n.update(w)
    assert got == wanted and {w: x[0] for w, x in counted.items() if "\uffff" not in w} == {w: k for w, k in n.items() if "\uffff" not in w}


def test_the_descent_is_short(train, monkeypatch):
    """Few rounds over the blocks, from which equal rows are gone; texts are read once. It was 120 rounds over all
    rows for each logistic machine and 100 for the language machines, on texts that were read twice."""
    rounds, reads = [], []
    summed, add = descent.summed, defects._encoded
    monkeypatch.setattr(descent, "summed", lambda *x: rounds.append(x[1]) or summed(*x))
    monkeypatch.setattr(defects, "_encoded", lambda t: reads.append(t) or add(t))
    defects.votes(train).count()
    assert len(rounds) < 90 and len(reads) == 1
    block = defects.Block()
    for k in range(50):
        block.add(k, "english", ASK, None, f"{ENGLISH}. {ENGLISH}.")
    (at, y, times), _ = pickle.loads(block.closed().column(1)[0].as_py())
    assert times.sum() >= 50 * 2 * 3 and len(y) < 60 and at.shape == (blocks.END_WIDTH, len(y))


def test_few_rounds_reach_the_best_weights():
    """The loss after them is near that after many."""
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.3).astype(float)
    at = np.stack([np.where(rng.random(4000) < 0.8, 3 * k + y, 3 * k + 2 + 50 * (rng.random(4000) < 0.02)) for k in range(8)]).astype(int)
    counts = descent.shown(at, y, 100)

    def loss(rounds):
        w, b = descent.logistic(lambda x: descent.logistic_slope(at, y, *x[0], y.sum(), len(y) - y.sum()), [descent.bound(8, counts)], rounds)[0]
        z = w[at].sum(0) + b
        return np.where(y > 0, np.log1p(np.exp(-z)) / (y > 0).sum(), np.log1p(np.exp(z)) / (y <= 0).sum()).sum() / 2

    assert loss(descent.ROUNDS) < loss(2000) + 0.01 < 0.05
