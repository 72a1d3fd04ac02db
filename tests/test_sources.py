import json

import pytest

from tarazu.sources import readers, sinks
from tarazu.streaming import clean_stream

SCHEMA = "id int, winner string"


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


GOOD = ['{"id": 1, "winner": "base"}', '{"id": 2, "winner": "اردو"}']


def test_strict(spark, tmp_path):
    assert readers.strict_jsonl(spark, put(tmp_path / "a.jsonl", GOOD), SCHEMA).count() == 2
    for k, bad in enumerate(("{", "", "not json", "{'id': 3}")):
        with pytest.raises(Exception, match="malformed"):
            readers.strict_jsonl(spark, put(tmp_path / f"b{k}.jsonl", [*GOOD, bad]), SCHEMA).collect()


def test_tolerant_counts_what_it_skips(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", [*GOOD, "", "   ", "| total |", '{"id": '])
    df = readers.tolerant_jsonl(spark, p, SCHEMA)
    assert readers.good(df).count() == 2
    assert tuple(readers.skipped(df).first()) == (2, 2)


def test_optional_isolated_state(spark, tmp_path):
    gone = str(tmp_path / "none.jsonl")
    assert readers.optional(spark, gone, SCHEMA, lambda s, p: readers.strict_jsonl(s, p, SCHEMA)).count() == 0
    df, why = readers.isolated(spark, SCHEMA, lambda: spark.read.parquet(gone))
    assert df.count() == 0 and why
    assert readers.state(spark, gone, "done int", {"done": 0}).first().done == 0
    (tmp_path / "p.json").write_text(json.dumps({"done": 5}, indent=2))
    assert readers.state(spark, str(tmp_path / "p.json"), "done int", {"done": 0}).first().done == 5


def test_directories_are_a_column(spark, tmp_path):
    for name in ("judge one", "b", "c"):
        put(tmp_path / name / "v.jsonl", GOOD)
    got = readers.partitioned(spark, str(tmp_path), "v.jsonl", SCHEMA, exclude=["c"])
    assert sorted({r.judge for r in got.collect()}) == ["b", "judge one"]


def test_nested_documents_and_latest(spark, tmp_path):
    for n, steps in ((500, [1, 2]), (10000, [2, 3])):
        p = tmp_path / f"checkpoint-{n}" / "state.json"
        p.parent.mkdir()
        p.write_text(json.dumps({"log_history": [{"step": s, "loss": 0.5} for s in steps]}, indent=1))
    rows = readers.exploded_documents(spark, f"{tmp_path}/checkpoint-*/state.json", "log_history", "log_history array<struct<step int, loss double>>")
    assert sorted(r.step for r in rows.collect()) == [1, 2, 2, 3]
    names = spark.createDataFrame([("checkpoint-500",), ("checkpoint-7500",), ("checkpoint-10000",), ("other",)], "name string")
    assert readers.latest(names).first()[0] == "checkpoint-10000"
    assert readers.latest(names.where("name <> 'other'"), numeric=False).first()[0] == "checkpoint-7500"


def test_files(spark, tmp_path):
    p = put(tmp_path / "x" / "a.jsonl", GOOD)
    assert readers.line_count(spark, p).first()[0] == 2
    assert readers.total_size(spark, str(tmp_path), "*.jsonl").first().bytes == (tmp_path / "x" / "a.jsonl").stat().st_size
    assert bytes(readers.files(spark, str(tmp_path), content=True).first().content).decode().startswith("{")
    keyed = readers.with_row_id(spark.read.text(p)).orderBy("row_key").collect()
    assert [r.value for r in keyed] == GOOD


def test_round_trip_without_escapes(spark, tmp_path):
    df = spark.createDataFrame([(1, "اردو\n"), (2, None)], SCHEMA)
    sinks.write_jsonl(df, str(tmp_path / "o"))
    text = "".join(f.read_text() for f in (tmp_path / "o").glob("part-*"))
    assert "اردو" in text and '"winner":null' in text
    assert sorted(map(tuple, readers.strict_jsonl(spark, str(tmp_path / "o"), SCHEMA).collect())) == [(1, "اردو\n"), (2, None)]


def test_split_verified_and_concatenated(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "too_short")], "id int, reason string")
    k, r = str(tmp_path / "kept"), str(tmp_path / "removed")
    sinks.write_split(df, "reason", k, r)
    assert [x.id for x in spark.read.json(k).collect()] == [1] and [x.id for x in spark.read.json(r).collect()] == [2]
    place = str(tmp_path / "v")
    sinks.write_verified(df, place, 2)
    with pytest.raises(ValueError):
        sinks.write_verified(df, place, 3)
    assert spark.read.json(place).count() == 2
    a, b = put(tmp_path / "1.jsonl", GOOD), put(tmp_path / "2.jsonl", [GOOD[1], '{"id": 3}'])
    for _ in range(2):
        sinks.concat_files(spark, [a, b, str(tmp_path / "gone")], str(tmp_path / "all"), "id")
    assert spark.read.text(str(tmp_path / "all")).count() == 3


def test_document_log_and_report(spark, tmp_path):
    sinks.write_document(spark.sql("select 1 as n, map('a', 2) as m"), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"n": 1, "m": {"a": 2}}
    with pytest.raises(ZeroDivisionError):
        sinks.run_logged(spark, str(tmp_path / "log"), lambda log: (log("began"), 1 / 0))
    lines = [x.value for x in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines[0].endswith("began") and "ZeroDivisionError" in lines[1]
    assert sinks.report(spark.sql("select 'x' as a, 5 as b"), {"a": 3, "b": -4}) == "a     b\nx     5"


def test_stream_appends_once_and_drops_late_copies(spark, tmp_path):
    schema = "instruction string, input string, output string, ingested_at timestamp"
    src, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    rows = [("q", "", "a", "2024-01-01 00:00:00"), ("Q ", "", "b", "2024-01-01 01:00:00"), ("other", "", "c", "2024-01-01 02:00:00")]
    put(src / "1.jsonl", [json.dumps(dict(zip(("instruction", "input", "output", "ingested_at"), r))) for r in rows])

    def run():
        stream = clean_stream.sized(clean_stream.first_seen(spark.readStream.schema(schema).json(str(src))))
        clean_stream.append_new(stream, out, at).awaitTermination()
        return spark.read.json(out).count()

    assert run() == 2 and run() == 2
    put(src / "2.jsonl", [json.dumps({"instruction": "q", "input": "", "output": "z", "ingested_at": "2024-01-01 03:00:00"}), json.dumps({"instruction": "new", "input": "", "output": "z", "ingested_at": "2024-01-01 03:00:00"})])
    assert run() == 3


def test_event_windows_as_batch(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    assert sorted((r.n_events, r.total) for r in clean_stream.counts_in_windows(e).collect()) == [(1, 4.0), (2, 3.0)]


@pytest.mark.parametrize("line", ['{"id": 1} trailing', '{"id": 1} {"id": 2}', '{"id": 1}]', "[1]", "7", "{'id': 1}"])
def test_what_follows_an_object_is_malformed(spark, tmp_path, line):
    p = put(tmp_path / "a.jsonl", [*GOOD, "\t ", line])
    rows = readers.tolerant_jsonl(spark, p, SCHEMA)
    assert readers.good(rows).count() == 2 and tuple(readers.skipped(rows).first()) == (1, 2)
    with pytest.raises(Exception, match="malformed"):
        readers.strict_jsonl(spark, p, SCHEMA).collect()


def test_a_long_report_says_what_it_leaves_out(spark):
    assert sinks.report(spark.range(205), {"id": -4}, 200).endswith("… and 5 more")
