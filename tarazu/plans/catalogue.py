"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import jsonx, order
from tarazu.functions import text as tx
from tarazu.operators import clean, combine, enrich, ingest, judge, profile, trainlog
from tarazu.operators import format as fmt
from tarazu.plans.sql import oracle_sql  # noqa: F401 - the driver's second half
from tarazu.streaming.clean_stream import counts_in_windows

# The naive letter map from Urdu to Roman, and the baseline rates of the first evaluation.
LETTERS = {
    "ا": "a", "آ": "aa", "ب": "b", "پ": "p", "ت": "t", "ٹ": "T", "ث": "s", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ڈ": "D", "ذ": "z", "ر": "r", "ڑ": "R", "ز": "z", "ژ": "zh",
    "س": "s", "ش": "sh", "ص": "s", "ض": "z", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ں": "n", "و": "o", "ہ": "h", "ھ": "h",
    "ء": "", "ی": "i", "ے": "e", "ئ": "i", "۰": "0", "۱": "1", "۲": "2", "۳": "3", "۴": "4", "۵": "5", "۶": "6", "۷": "7", "۸": "8", "۹": "9", "؟": "?", "۔": ".", "،": ",",
}
BASELINE = {"translation": 80.0, "summarization": 72.7, "qa": 61.9, "creative": 54.5, "reasoning": 43.8, "grammar": 40.0, "code_explanation": 10.0, "code_mixed": 0.0, "overall": 51.5}
NEW_SOURCES = ("code-roman-synthetic", "urdu-instruct-roman-v2")


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _train(s, d):
    return _t(s, d, "train")


def _tagged(s, d):
    return clean.tag(_train(s, d).select("row_id", "instruction", "input", "output", "source"))


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def clean_reason_counts(s, d):
    return clean.reason_counts(_tagged(s, d))


def clean_totals(s, d):
    return clean.totals(_tagged(s, d)).withColumn("kept_share", F.round("kept_share", 6))


def clean_kept_rows(s, d):
    return clean.kept(_tagged(s, d)).select("row_id", F.md5("instruction").alias("instruction"), F.md5("input").alias("input"), F.md5("output").alias("output"), "source")


def clean_removed_rows(s, d):
    return clean.removed(_tagged(s, d)).select("row_id", "reason_code", "removal_reason")


def clean_stats_by_source(s, d):
    return clean.kept_by_source(_tagged(s, d)).select("source", "n_records", "first_row", _r6("share"))


def script_ratio_rows(s, d):
    i = tx.text_or_empty("instruction")
    return _train(s, d).select("row_id", tx.script_count(i).cast("long").alias("n_script"), F.round(tx.script_ratio(i), 6).alias("ratio"))


def script_strip_rows(s, d):
    return _train(s, d).select("row_id", F.md5(tx.strip_script(tx.text_or_empty("output"))).alias("stripped"))


def low_ratio_gate(s, d):
    i, o = (tx.script_ratio(tx.text_or_empty(c)) for c in ("instruction", "output"))
    rows = _train(s, d).select("row_id", i.alias("ri"), o.alias("ro"))
    return rows.where(F.greatest("ri", "ro") < 0.3).select("row_id", tx.percent(F.col("ri")).alias("instruction_share"), tx.percent(F.col("ro")).alias("output_share"))


def ratio_histogram(s, d):
    h = profile.ratio_histogram(_train(s, d), "output", ["source"])
    return h.select("source", "n_high", "n_middle", "n_low", _r6("mean_ratio"))


def _unified(s, d):
    evals = _t(s, d, "eval_results").withColumn("row_id", F.col("run_id") * 1000 + F.col("id"))
    return ingest.union_sources([
        ingest.unify(_train(s, d), None),
        ingest.unify(evals.withColumnRenamed("finetuned_response", "response"), "eval-finetuned"),
        ingest.unify(evals.withColumnRenamed("base_response", "response"), "eval-base"),
    ])


def source_union(s, d):
    u = _unified(s, d)
    return u.groupBy("source_rank", "source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(tx.combined_length("instruction", "input", "output").cast("long")).alias("n_chars"), F.min("row_id").alias("first_row"))


def source_counts(s, d):
    return ingest.counts_by_source(_unified(s, d)).select("source", "n_records", "first_row", _r6("share"), tx.bar(F.col("share")).alias("bar"))


def language_filter(s, d):
    names = _train(s, d).where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n_records"))
    return names.select("lang", "n_records", *[tx.names_urdu("lang", v).alias(f"variant_{v}") for v in "abc"])


def urdu_documents(s, d):
    return ingest.in_urdu(_t(s, d, "documents")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_records"))


def chat_format(s, d):
    return fmt.within(fmt.formatted(_train(s, d))).select("row_id", "source", F.md5("text").alias("text"), F.col("n_tokens").cast("long").alias("n_tokens"))


def format_statistics(s, d):
    return fmt.format_statistics(fmt.formatted(_train(s, d)), 100)


def token_length_profile(s, d):
    p = fmt.length_profile(fmt.formatted(_train(s, d)), ("source",))
    return p.select("source", "n", *[F.col(c).cast("long").alias(c) for c in ("min", "max", "mean", "median", "p90", "p95", "p99")])


def length_profile_columns(s, d):
    p = profile.length_profile(_train(s, d), ["instruction", "input", "output"])
    return p.select("column", *[F.col(c).cast("long").alias(c) for c in ("n", "min", "max", "mean", "median", "n_empty", "n_short", "n_long")])


def duplicate_profile(s, d):
    return profile.distinct_profile(_train(s, d), ["instruction", "input", "output", "source"]).select("column", "n_values", "n_distinct", "n_duplicates", _r6("duplicate_share"))


def low_cardinality_values(s, d):
    return profile.low_cardinality(_train(s, d), ["source", "category", "lang", "instruction"])


def top_languages(s, d):
    return profile.top(_train(s, d).where("lang is not null"), "lang")


def has_input_share(s, d):
    return profile.with_input(_train(s, d), ["source"]).select("source", "n_records", "n_with_input", _r6("input_share"))


def dataset_comparison(s, d):
    named = {"train": _train(s, d), "documents": _t(s, d, "documents").select(F.lit("").alias("instruction"), F.col("text").alias("output")), "prompts": _t(s, d, "prompts").select(F.col("prompt").alias("instruction"), F.lit("").alias("output"))}
    return profile.compare(named)


def combine_new(s, d):
    t = _train(s, d).select("row_id", "instruction", "input", "output", "source")
    new = [(n, t.where(F.col("source") == n)) for n in NEW_SOURCES]
    return combine.combine_statistics(combine.combine(t.where(~F.coalesce("source", F.lit("")).isin(*NEW_SOURCES)), *new))


def seeded_sample(s, d):
    return order.sample(_train(s, d).select("row_id"), 500, 42, "row_id")


def disjoint_second_sample(s, d):
    t = _train(s, d).select("row_id")
    return order.sample(enrich.remaining(t, order.sample(t, 500, 42, "row_id")), 500, 123, "row_id")


def gathered_rows(s, d):
    t = _train(s, d)
    return enrich.gather(t, order.sample(t.select("row_id"), 100, 7, "row_id")).select("row_id", "source", tx.combined_length("instruction", "output").cast("long").alias("n_chars"))


def shuffle_positions(s, d):
    t = _train(s, d).select("row_id").withColumn("_h", order.hash_of(42, "row_id"))
    return order.with_position(t, "_h", "row_id").select("row_id", F.col("pos").cast("long").alias("pos"))


def train_val_split(s, d):
    kept, held = order.split_exact(_train(s, d).select("row_id"), 0.05, 42, "row_id")
    return kept.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("val")))


def _batched(s, d):
    return enrich.plan_batches(_train(s, d).select("row_id", "instruction", "output"), 1000, 5, 42, skip=15)


def _batched_all(s, d, *columns):
    """All rows from the 16th on; texts only where they are named, as they are shuffled."""
    t = _train(s, d).select("row_id", *columns).withColumn("_h", order.hash_of(42, "row_id"))
    return order.batches(t, 5, "_h", "row_id").drop("_h").where(F.col("pos") >= 15)


def _packed(b):
    return b.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_id"))), lambda x: x["row_id"].cast("string")), ",").alias("rows"))


def batch_pack(s, d):
    return _packed(_batched(s, d))


def batch_pack_all(s, d):
    return _packed(_batched_all(s, d))


def _request_fields(b):
    """Fields of the JSON request of each batch, read back from it."""
    r = enrich.requests(b)
    items = F.from_json("request", jsonx.ITEMS)
    return r.select(F.col("batch").cast("long").alias("batch"), "n_rows", F.expr("cast(aggregate(from_json(request, 'array<struct<id:bigint>>'), 0L, (a, x) -> a + x.id) as bigint)").alias("id_sum"), F.md5(F.array_join(F.transform(items, lambda x: x["instruction"]), "|")).alias("instructions"))


def batch_requests(s, d):
    return _request_fields(_batched(s, d))


def batch_requests_all(s, d):
    return _request_fields(_batched_all(s, d, "instruction", "output"))


def topic_cycle(s, d):
    topics = _t(s, d, "topics").select((F.col("topic_id") - 1).alias("pos"), "topic")
    slots = enrich.cycle(topics, 200, 7, 11)
    lists = slots.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "topic"))).alias("t"))
    return lists.select("batch", F.size("t").cast("long").alias("n_topics"), tx.numbered(F.transform("t", lambda x: x["topic"])).alias("list"))


def running_budget(s, d):
    kept = enrich.within_budget(_t(s, d, "events"), "value", 100.0, "event_id", ("user_id",))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_written"), F.round(F.max("spent"), 6).alias("spent"))


def failure_breaker(s, d):
    e = _t(s, d, "events").withColumn("outcome", F.when(F.col("event_type") == "error", "call").when(F.col("event_type") == "signup", "parse").otherwise("ok"))
    return enrich.before_breaker(e, 10, "event_id", ("user_id",)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_done"), F.max("failures").alias("failures"))


def _responses(s, d):
    e = _t(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    item = F.concat(F.lit('{"id": 0, "instruction": "q", "output": "'), F.col("k"), F.lit('"}'))
    m = F.col("event_id") % 7
    text = (
        F.when(m == 0, F.concat(F.lit("["), item, F.lit("]"))).when(m == 1, F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
        .when(m == 2, F.concat(F.lit('{"examples": ['), item, F.lit("]}"))).when(m == 3, F.concat(F.lit('Sure: {"examples": ['), item, F.lit("]} done")))
        .when(m == 4, F.concat(F.lit("["), item)).when(m == 5, F.concat(F.lit('{"x": ['), item, F.lit("]}"))).otherwise(F.col("props"))
    )
    return e.select("event_id", "k", text.alias("response"))


def response_parse(s, d):
    r = _responses(s, d)
    one = lambda f: f("response")[0]["output"]
    return r.select("event_id", one(jsonx.response_items).alias("any_form"), one(jsonx.response_list).alias("list_only"))


def positional_match(s, d):
    batched = _train(s, d).select("row_id", "instruction", "output", F.floor((F.col("row_id") - 1) / 5).alias("batch"), F.col("row_id").alias("pos"))
    n = (F.col("batch") % 8).cast("int")
    item = lambda i: F.struct(F.lit("").alias("instruction"), F.concat(F.lit("r"), i.cast("string")).alias("output"))
    answers = batched.select("batch").distinct().where(n > 0).withColumn("items", F.transform(F.sequence(F.lit(0), n - 1), item))
    return enrich.match_by_position(batched, answers).select("row_id", F.col("batch").cast("long").alias("batch"), "output")


def progress_marks(s, d):
    marks = enrich.progress_marks(_t(s, d, "progress").select("job_id", F.col("done").cast("long").alias("done")).distinct(), 20, "done")
    return marks.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_marks"), F.max("done").alias("furthest"))


def job_states(s, d):
    st = enrich.last_states(_t(s, d, "progress").fillna(0, ["total_input_tokens", "total_output_tokens"]))
    return st.select("job_id", "job", F.col("done").cast("long").alias("done"), F.col("total_output_tokens").cast("long").alias("total_output_tokens"), "n_states")


def log_merge(s, d):
    p = _t(s, d, "progress").withColumn("pos", F.coalesce("total_output_tokens", F.lit(-1)))
    m = trainlog.merge(p.select("job_id", "done", "saved_at", "pos", "total_output_tokens"), ("job_id", "done"), ("saved_at", "pos"))
    return m.select("job_id", F.col("done").cast("long").alias("done"), F.col("total_output_tokens").cast("long").alias("total_output_tokens"))


def _log(s, d):
    e = _t(s, d, "events")
    evals = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("eval_loss"))
    steps = e.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return evals, steps


def eval_asof_trend(s, d):
    evals, steps = _log(s, d)
    joined = trainlog.asof(evals, steps, "step", "loss", ("user_id",))
    return trainlog.trend(joined, by=("user_id",)).select("user_id", "step", "eval_loss", "loss_asof", "trend")


def ema_loss(s, d):
    _, steps = _log(s, d)
    return trainlog.smoothed(steps, "loss", "step", ("user_id",)).select("user_id", "step", "loss", _r6("ema"))


def best_and_overfit(s, d):
    evals, _ = _log(s, d)
    return trainlog.best_and_last(evals, by=("user_id",))


def epoch_boundaries(s, d):
    _, steps = _log(s, d)
    return trainlog.epochs(steps, by=("user_id",)).select("user_id", F.col("epoch").cast("long").alias("epoch"), _r6("boundary"))


def log_kinds(s, d):
    e = _t(s, d, "events")
    k = trainlog.kind(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") != "error", F.col("value")))
    return e.groupBy(F.coalesce(k, F.lit("neither")).alias("kind")).agg(F.count(F.lit(1)).alias("n_entries"))


def eval_join(s, d):
    r = _t(s, d, "eval_results")
    side = lambda c: r.where(F.col(c).isNotNull()).select("id", F.col(c).alias("response"), F.struct("run_id", c).alias("seq"))
    j = judge.join_eval(_t(s, d, "prompts"), side("base_response"), side("finetuned_response"))
    return j.select("id", "category", F.md5("base_response").alias("base"), F.md5("finetuned_response").alias("finetuned"))


def eval_counts(s, d):
    r = _t(s, d, "eval_results")
    empty = lambda c: F.count_if(tx.strip(tx.text_or_empty(c)) == "")
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("id").alias("n_prompts"), empty("base_response").alias("n_empty_base"), empty("finetuned_response").alias("n_empty_finetuned"))


def _rates(s, d):
    return judge.win_rates(_t(s, d, "verdicts"))


def judge_winrates(s, d):
    return _rates(s, d).select("judge", "category", "finetuned", "base", "tie", "total", _r6("ft_pct"))


def judge_median_delta(s, d):
    base = s.createDataFrame(list(BASELINE.items()), "category string, v1 double")
    a = judge.across_judges(_rates(s, d), base)
    return judge.display_order(a).select("category", "n_judges", *map(_r6, ("median", "lowest", "highest", "v1", "delta")))


def judge_bands(s, d):
    return judge.across_judges(_rates(s, d), exclude=("judge-delta",)).select("category", _r6("median"), judge.band(F.col("median")).alias("band"))


def judge_agreement(s, d):
    a = judge.agreement(_t(s, d, "verdicts"))
    return a.groupBy("n_judges").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("agreed").alias("n_agreed"))


def blinded_ab(s, d):
    return _t(s, d, "prompts").select("id", combine.ab_side(42, "id").alias("side"))


def char_map(s, d):
    return _train(s, d).where("instruction is not null").select("row_id", F.md5(tx.char_map("instruction", LETTERS)).alias("roman"))


def preview_rows(s, d):
    return _t(s, d, "documents").where("text is not null").select("doc_id", F.md5(tx.preview("text", 200)).alias("preview"))


def event_windows(s, d):
    w = counts_in_windows(_t(s, d, "events"))
    return w.select(F.col("start").cast("string").alias("start"), "event_type", "n_events", _r6("total"))


def low_ratio_examples(s, d):
    """The first three outputs with little of the script, as a spot check."""
    rows = _train(s, d).select("row_id", tx.text_or_empty("output").alias("output")).withColumn("ratio", tx.script_ratio("output"))
    return rows.where("ratio < 0.5").orderBy("row_id").limit(3).select("row_id", F.md5(tx.preview("output", 300, always=True)).alias("start"), _r6("ratio"))


def steps_per_epoch(s, d):
    n = _train(s, d).agg(F.count(F.lit(1)).alias("n_records")).withColumn("n_held", F.ceil(F.col("n_records") * 0.05))
    return n.withColumn("steps_per_epoch", F.expr("(n_records - n_held) div 16"))


def usage_totals(s, d):
    st = enrich.last_states(_t(s, d, "progress").fillna(0, ["total_input_tokens", "total_output_tokens"]))
    return st.groupBy("job").agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("done").alias("n_done"), F.sum("total_input_tokens").cast("long").alias("input_tokens"), F.sum("total_output_tokens").cast("long").alias("output_tokens"))


def pair_duplicates(s, d):
    """How many different instruction and output pairs occur how often; only hashes are shuffled."""
    pairs = _train(s, d).where("instruction is not null and output is not null").select(F.md5("instruction").alias("i"), F.md5("output").alias("o"))
    return pairs.groupBy("i", "o").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("n_pairs"))


def judge_labels(s, d):
    labels = s.createDataFrame([("judge-alpha", "A"), ("judge-beta", "B")], "judge string, label string")
    return _rates(s, d).where("category = 'overall'").join(labels, "judge", "left").select("judge", F.coalesce("label", "judge").alias("label"), _r6("ft_pct"))


def eval_languages(s, d):
    return _t(s, d, "prompts").groupBy(F.coalesce("language", F.lit("none")).alias("language"), "category").agg(F.count(F.lit(1)).alias("n_prompts"))


def message_roles(s, d):
    turns = tx.chat_messages(F.lit(fmt.SYSTEM), tx.user_message(tx.text_or_empty("instruction"), tx.text_or_empty("input")), tx.text_or_empty("output"))
    flat = _train(s, d).select(F.explode(turns).alias("m"))
    return flat.groupBy(F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("m.content").cast("long")).alias("n_chars"))


def document_text_columns(s, d):
    p = profile.length_profile(_t(s, d, "documents"), short=50, long=3000)
    return p.select("column", *[F.col(c).cast("long").alias(c) for c in ("n", "min", "max", "mean", "median", "n_empty", "n_short", "n_long")])


def checksum_by_source(s, d):
    """Rows, and a fold of their hashes that no order changes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[tx.text_or_empty(c) for c in ("instruction", "input", "output")])), 1, 8), 16, 10).cast("long")
    return _train(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(h).alias("checksum"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        clean_reason_counts, clean_totals, clean_kept_rows, clean_removed_rows, clean_stats_by_source, script_ratio_rows, script_strip_rows, low_ratio_gate, ratio_histogram,
        source_union, source_counts, language_filter, urdu_documents, chat_format, format_statistics, token_length_profile, length_profile_columns, duplicate_profile, low_cardinality_values,
        top_languages, has_input_share, dataset_comparison, combine_new, seeded_sample, disjoint_second_sample, gathered_rows, shuffle_positions, train_val_split, batch_pack, batch_requests,
        topic_cycle, running_budget, failure_breaker, response_parse, positional_match, progress_marks, job_states, log_merge, eval_asof_trend, ema_loss, best_and_overfit, epoch_boundaries, log_kinds,
        eval_join, eval_counts, judge_winrates, judge_median_delta, judge_bands, judge_agreement, blinded_ab, char_map, preview_rows, event_windows, checksum_by_source,
        low_ratio_examples, steps_per_epoch, usage_totals, pair_duplicates, judge_labels, eval_languages, message_roles, document_text_columns,
    )
    return {f.__name__: f for f in each}


def whole() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries over all rows whose namesakes have SQL over a sample; these have none."""
    return {f.__name__: f for f in (batch_pack_all, batch_requests_all)}
