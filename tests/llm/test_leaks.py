import random
import time

from tarazu.llm import leaks


def brute(texts, text, run=8):
    w = leaks.words(text)
    held = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    return {k for k, t in texts if any(tuple(p[i : i + run]) in held for p in [leaks.words(t)] for i in range(len(p) - run + 1))}


def test_search_equals_brute_force_on_few_words():
    rng = random.Random(1)
    for run in (2, 3, 5, 8):
        texts = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))) for k in range(12)]
        search = leaks.WuManber(texts, run)
        for _ in range(300):
            t = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))
            assert search.find(t) == brute(texts, t, run)


def test_whole_table(spark, data, train):
    prompts = spark.read.parquet(f"{data}/prompts.parquet")
    texts = [(r.id, r.prompt) for r in prompts.collect()]
    wanted = {(r.row_id, k) for r in train.collect() if r.instruction for k in brute(texts, r.instruction)}
    assert {tuple(r) for r in leaks.leaked_pairs(train, prompts).collect()} == wanted


def test_forms_blocks_and_empty(spark, make_train, monkeypatch):
    prompts = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "short"), (3, None), (None, "x"), (4, "zwei two three four five six seven eight nine")], "id int, prompt string")
    df = make_train(
        {"row_id": 1, "instruction": "See: TWO, three-four\nfive  six. seven еight «nine»!"}, {"row_id": 2, "instruction": "two three four five six seven eight"}, {"row_id": 3, "instruction": None}, {"row_id": 4, "instruction": ""},
        {"row_id": 5, "instruction": "x " * 50_000 + "one two three four five six seven eight"},
    )
    wanted = {(1, 1), (1, 4), (5, 1)}
    assert {tuple(r) for r in leaks.leaked_pairs(df.unionByName(df), prompts).collect()} == wanted
    monkeypatch.setattr(leaks, "BLOCK_CHARACTERS", 10)
    assert {tuple(r) for r in leaks.leaked_pairs(df, prompts).collect()} == wanted
    assert leaks.leaked_records(df, prompts).where("row_id = 1").first() == (1, 2, "1,4")
    assert leaks.leaked_pairs(df, prompts.limit(0)).count() == 0 and leaks.leaked_pairs(make_train(), prompts).count() == 0


def test_one_table_for_all_tasks_of_a_worker():
    rng = random.Random(3)
    block = [(k, " ".join(f"w{rng.randrange(90_000)}" for _ in range(200))) for k in range(600)]

    class Sent:
        value = (block, 8)

    leaks._LAST.clear()
    table = leaks._table("a", Sent)
    began = time.perf_counter()
    assert all(leaks._table("a", Sent) is table for _ in range(1000)) and time.perf_counter() - began < 0.1
    assert leaks._table("b", Sent) is not table and len(leaks._LAST) == 1


def test_patterns_that_repeat():
    texts = [(k, "a b " * 300) for k in range(5)]
    search = leaks.WuManber(texts, 8)
    assert search.find("x a b a b a b a b x") == set(range(5)) and search.find("a b " * 3) == set()
