"""Registered queries that write by a sink and read back by a source, and what else joins them.

Everything goes to a folder of its own below the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.operators import clean, enrich, judge
from tarazu.plans.sql import RATES, TAGGED
from tarazu.session import shared_dir
from tarazu.sources import readers, sinks

RECORD = "row_id long, instruction string, input string, output string, source string"
FIELDS = ("row_id", "instruction", "input", "output", "source")


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _place(s: SparkSession) -> str:
    return f"{shared_dir(s).rstrip('/')}/stored-{uuid.uuid4().hex}"


def _records(s, d):
    return _t(s, d, "train").select(*FIELDS)


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("~")) for c in FIELDS[1:]])).alias("record"))


def stored_strict(s, d):
    """JSON Lines written and read by the strict reader."""
    place = _place(s)
    sinks.write_jsonl(_records(s, d), place)
    return _hashed(readers.strict_jsonl(s, place, RECORD))


def _broken_lines(s, d) -> str:
    """Lines of all records: every fifth is cut, followed by more text, blank or no object."""
    place, n = _place(s), F.col("row_id") % 20
    line = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    cut = F.when(n == 4, F.expr("left(line, length(line) - 1)")).when(n == 9, F.concat("line", F.lit(" trailing"))).when(n == 14, F.lit(" \t ")).when(n == 19, F.lit("[1]")).otherwise(F.col("line"))
    _records(s, d).withColumn("line", line).select(cut.alias("value")).write.text(place)
    return place


def stored_tolerant(s, d):
    """The good lines among broken ones."""
    return _hashed(readers.good(readers.tolerant_jsonl(s, _broken_lines(s, d), RECORD)))


def stored_skipped(s, d):
    return readers.skipped(readers.tolerant_jsonl(s, _broken_lines(s, d), RECORD))


def stored_lines(s, d):
    place = _place(s)
    sinks.write_jsonl(_records(s, d), place)
    return readers.line_count(s, place)


def stored_appended(s, d):
    """A file written anew and one that is added to; a missing one has no rows."""
    place, r = _place(s), _records(s, d)
    for part, name in enumerate(("first", "second", "second")):
        sinks.write_jsonl(r.where(F.col("row_id") % 3 == part), f"{place}/{name}", append=name == "second")
    read = lambda x: readers.optional(s, f"{place}/{x}", RECORD, lambda s, p: readers.strict_jsonl(s, p, RECORD)).withColumn("file", F.lit(x))
    return read("first").unionByName(read("second")).unionByName(read("missing")).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("ids"))


def stored_split(s, d):
    """Kept and removed records in two places, by one pass."""
    place = _place(s)
    sinks.write_split(clean.tag(_records(s, d)).select("row_id", "reason_code"), "reason_code", f"{place}/kept", f"{place}/removed")
    parts = [s.read.schema("row_id long").json(f"{place}/{x}").select("row_id", F.lit(x).alias("part")) for x in ("kept", "removed")]
    return parts[0].unionByName(parts[1])


def stored_statistics(s, d):
    """Statistics as a JSON document and read again as a state."""
    place = f"{_place(s)}/stats.json"
    sinks.write_document(clean.totals(clean.tag(_records(s, d))), place)
    fields = clean.totals(clean.tag(_records(s, d).limit(0))).schema
    return readers.state(s, place, fields, {}).withColumn("kept_share", F.round("kept_share", 6))


def stored_verified(s, d):
    """Replaced only by a write with the expected number of lines."""
    place, r = _place(s), _records(s, d)
    n = r.count()
    sinks.write_verified(r, place, n)
    try:
        sinks.write_verified(r.where("row_id % 2 = 0"), place, n + 1)
    except ValueError:
        pass
    return _hashed(readers.strict_jsonl(s, place, RECORD))


def stored_concatenated(s, d):
    """Lines of overlapping files, each key once; a rerun adds nothing."""
    place, r = _place(s), _records(s, d)
    sinks.write_jsonl(r.where("row_id % 3 < 2"), f"{place}/a")
    sinks.write_jsonl(r.where("row_id % 3 > 0"), f"{place}/b")
    for _ in range(2):
        sinks.concat_files(s, [f"{place}/a", f"{place}/b", f"{place}/gone"], f"{place}/all", "row_id")
    return _hashed(readers.strict_jsonl(s, f"{place}/all", RECORD))


def stored_by_judge(s, d):
    """One relation of the folders of all judges, named by the folder."""
    place = _place(s)
    v = _t(s, d, "verdicts").where("judge is not null")
    v.select("run_id", "id", "winner", F.col("judge").alias("of")).write.partitionBy("of").option("ignoreNullFields", "false").json(place)
    read = readers.partitioned(s, place, "*.json", "run_id long, id int, winner string")
    return read.groupBy(F.expr("substring(judge, 4)").alias("judge")).agg(F.count(F.lit(1)).alias("n_verdicts"), F.count("winner").alias("n_named"))


def stored_log(s, d):
    """The lines of a run that fails, written all the same."""
    place = _place(s)

    def run(log):
        log(f"{_records(s, d).count()} records")
        raise RuntimeError("stopped")

    try:
        sinks.run_logged(s, place, run)
    except RuntimeError:
        pass
    return s.read.text(place).select(F.expr("substring(value, 22)").alias("line"))


def latest_checkpoint(s, d):
    """Of names like checkpoint-500 the last by number."""
    return readers.latest(_t(s, d, "progress").where("done is not null").select(F.concat(F.lit("checkpoint-"), F.col("done").cast("string")).alias("name")))


def filled_items(s, d):
    return enrich.filled(_records(s, d)).select("row_id")


def progress_shares(s, d):
    """How far each saved state is, of the furthest of its job."""
    p = _t(s, d, "progress").where("job_id is not null and done is not null").select("job_id", "done").distinct()
    both = p.join(p.groupBy("job_id").agg(F.max("done").alias("total")), "job_id")
    return both.select("job_id", F.col("done").cast("long").alias("done"), F.round(enrich.progress_percent(F.col("done"), F.col("total")), 6).alias("percent"))


def source_bars(s, d):
    """Counts by source as bars and numbers as a report prints them."""
    n = _t(s, d, "train").groupBy("source").agg(F.count(F.lit(1)).alias("n_records"))
    whole = n.crossJoin(F.broadcast(n.agg(F.sum("n_records").alias("whole"))))  # one row
    share = 100.0 * F.col("n_records") / F.col("whole")
    return whole.select("source", tx.count_bar(F.col("n_records"), F.col("whole")).alias("bar"), tx.thousands(F.col("n_records")).alias("n_text"), tx.fixed(share, 1).alias("share_text"), tx.fixed(share - 5, 1, True).alias("delta_text"))


def first_pairs(s, d):
    """Records whose instruction and output occur for the first time; only hashes are shuffled."""
    pairs = _records(s, d).where("instruction is not null and output is not null").select("row_id", F.xxhash64("instruction", "output").alias("a"), F.md5(F.concat_ws("\x1f", "instruction", "output")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.min("row_id").alias("row_id")).select("row_id")


def incomplete_prompts(s, d):
    """How many prompts lack one of the two answers."""
    r = _t(s, d, "eval_results")
    side = lambda c: r.where(F.col(c).isNotNull()).select("id", F.col(c).alias("response"), F.struct("run_id", c).alias("seq"))
    p = _t(s, d, "prompts")
    joined = judge.join_eval(p, side("base_response"), side("finetuned_response"))
    return p.join(joined.select("id", F.lit(True).alias("both")), "id", "left").agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(F.col("both").isNull()).alias("n_incomplete"))


def winrate_bars(s, d):
    """What a chart of win rates shows: the median of the judges and their range, by category."""
    a = judge.across_judges(judge.win_rates(_t(s, d, "verdicts")))
    return a.select("category", F.round("median", 6).alias("bar"), F.round(F.col("median") - F.col("lowest"), 6).alias("below"), F.round(F.col("highest") - F.col("median"), 6).alias("above"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        stored_strict, stored_tolerant, stored_skipped, stored_lines, stored_appended, stored_split, stored_statistics, stored_verified, stored_concatenated, stored_by_judge, stored_log,
        latest_checkpoint, filled_items, progress_shares, source_bars, first_pairs, incomplete_prompts, winrate_bars,
    )
    return {f.__name__: f for f in each}


def whole_sql(of_sample: dict[str, str]) -> dict[str, str]:
    """SQL of the queries that batch all rows: as of their namesakes, without the sample's border."""
    return {f"{name}_all": of_sample[name].replace("pos < 1000 AND ", "") for name in ("batch_pack", "batch_requests")}


def oracle_sql(totals: str) -> dict[str, str]:
    hashed = "SELECT row_id, md5(" + " || chr(31) || ".join(f"coalesce({c}, '~')" for c in FIELDS[1:]) + ") AS record FROM train"
    return {
        "stored_strict": hashed,
        "stored_tolerant": hashed + " WHERE row_id % 5 <> 4",
        "stored_skipped": "SELECT count(*) FILTER (row_id % 20 IN (4, 9, 19)) AS n_skipped, count(*) FILTER (row_id % 5 <> 4) AS n_rows FROM train",
        "stored_lines": "SELECT count(*) AS n_lines FROM train",
        "stored_appended": "SELECT CASE WHEN row_id % 3 = 0 THEN 'first' ELSE 'second' END AS file, count(*) AS n_rows, sum(row_id)::BIGINT AS ids FROM train GROUP BY 1",
        "stored_split": TAGGED + "SELECT row_id, CASE WHEN reason_code IS NULL THEN 'kept' ELSE 'removed' END AS part FROM tagged",
        "stored_statistics": totals,
        "stored_verified": hashed,
        "stored_concatenated": hashed,
        "stored_by_judge": "SELECT judge, count(*) AS n_verdicts, count(winner) AS n_named FROM verdicts WHERE judge IS NOT NULL GROUP BY judge",
        "stored_log": "SELECT count(*) || ' records' AS line FROM train UNION ALL SELECT 'failed: RuntimeError: stopped'",
        "latest_checkpoint": "SELECT 'checkpoint-' || max(done) AS latest FROM progress",
        "filled_items": "SELECT row_id FROM train WHERE coalesce(instruction, '') <> '' AND coalesce(output, '') <> ''",
        "progress_shares": "SELECT DISTINCT job_id, done::BIGINT AS done, round(100.0::DOUBLE * done / max(done) OVER (PARTITION BY job_id), 6) AS percent FROM progress WHERE job_id IS NOT NULL AND done IS NOT NULL",
        "source_bars": "WITH n AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS w FROM train GROUP BY source) SELECT source, repeat('█', coalesce(floor(n / nullif(floor(w / 50), 0))::INT, 0)) AS bar, format('{:,}', n) AS n_text, printf('%.1f', 100.0::DOUBLE * n / w) AS share_text, printf('%+.1f', 100.0::DOUBLE * n / w - 5) AS delta_text FROM n",
        "first_pairs": "SELECT min(row_id) AS row_id FROM train WHERE instruction IS NOT NULL AND output IS NOT NULL GROUP BY instruction, output",
        "incomplete_prompts": "SELECT count(*) AS n_prompts, count(*) FILTER (id NOT IN (SELECT id FROM eval_results WHERE base_response IS NOT NULL) OR id NOT IN (SELECT id FROM eval_results WHERE finetuned_response IS NOT NULL)) AS n_incomplete FROM prompts",
        "winrate_bars": RATES + "SELECT category, round(median(ft_pct), 6) AS bar, round(median(ft_pct) - min(ft_pct), 6) AS below, round(max(ft_pct) - median(ft_pct), 6) AS above FROM rates GROUP BY category",
    }
