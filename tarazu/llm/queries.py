"""The registered queries on training data, pN_ for problem N, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarazu.llm import defects, languages, leaks, mixing, normal, packing, tokens, truncation


def _t(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    train = lambda s, d: _t(s, d, "train")
    documents = lambda s, d: _t(s, d, "documents")
    prompts = lambda s, d: _t(s, d, "prompts")
    targets = lambda s, d: _t(s, d, "mix_targets")
    return {
        "p1_token_totals": lambda s, d: tokens.token_totals(train(s, d), documents(s, d)),
        "p1_train_tokens": lambda s, d: tokens.token_counts(train(s, d), "row_id"),
        "p1_document_tokens": lambda s, d: tokens.token_counts(documents(s, d), "doc_id"),
        "p2_found": lambda s, d: normal.same_looking_pairs(train(s, d)),
        "p2_classes": lambda s, d: normal.same_looking_classes(train(s, d)),
        "p2_consistent": lambda s, d: normal.consistent_fields(train(s, d)),
        "p3_mix_records": lambda s, d: mixing.mix_records(train(s, d), targets(s, d)),
        "p3_mix_shares": lambda s, d: mixing.mix_shares(train(s, d), targets(s, d)),
        "p4_found": lambda s, d: languages.wrongly_labelled(train(s, d)),
        "p4_stretches": lambda s, d: languages.stretches(train(s, d)),
        "p5_found": lambda s, d: leaks.leaked_pairs(train(s, d), prompts(s, d)),
        "p5_records": lambda s, d: leaks.leaked_records(train(s, d), prompts(s, d)),
        "p6_found": lambda s, d: defects.defective(train(s, d)),
        "p6_labels": lambda s, d: defects.labelled(train(s, d)),
        "p6_functions": lambda s, d: defects.labelling_functions(train(s, d)),
        "p7_ids": lambda s, d: tokens.token_ids(documents(s, d)),
        "p8_containers": lambda s, d: packing.pack_documents(documents(s, d)),
        "p8_fill": lambda s, d: packing.packing_summary(packing.pack_documents(documents(s, d))),
        "p8_steps": lambda s, d: packing.step_balance(packing.pack_documents(documents(s, d))),
        "p9_found": lambda s, d: truncation.cut_documents(documents(s, d)),
        "p9_shares": lambda s, d: truncation.cut_shares(documents(s, d)),
    }


HIDDEN = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# Tables of the SQL, written apart from the operator's.
TWINS = (
    "АаВЕеЅѕІіЈјКМНОоРрСсТУуХхԁһ" "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧν",
    "AaBEeSsIiJjKMHOoPpCcTYyXxdh" "ABEZHIKMNOoPTYXv",
)
SIGNS = r"\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6DC}\x{6DF}-\x{6E4}\x{6E7}\x{6E8}\x{6EA}-\x{6ED}"
JOINING = r"\x{620}\x{622}-\x{64A}\x{66E}\x{66F}\x{671}-\x{6D3}\x{6D5}\x{6FA}-\x{6FC}\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8C7}"


def _folded() -> tuple[str, str]:
    """Wide and presentation forms of one letter, look-alikes, and digits drawn alike in both Arabic sets."""
    wide = {chr(c): f for block in (range(0xFB50, 0xFE00), range(0xFE70, 0xFEFD), range(0xFF01, 0xFF5F)) for c in block if len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f != chr(c)}
    pairs = wide | dict(zip(*TWINS, strict=True)) | dict(zip("٠١٢٣٧٨٩", "۰۱۲۳۷۸۹"))
    return "".join(pairs), "".join(pairs.values())


def _consistent_sql(x: str) -> str:
    """The consistent form in SQL, for texts whose look-alike letters all stand for Latin
    ones, as in the tables here; tokens of real Cyrillic or Greek need the operator."""
    old, new = (t.replace("'", "''") for t in _folded())
    x = f"nfc_normalize(translate(regexp_replace({x}, '{HIDDEN}', '', 'g'), '{old}', '{new}'))"
    x = f"replace(translate({x}, 'ى', 'ی'), 'ی' || chr(1620), 'ئ')"
    for a, b in (("ك", "ک"), ("ي", "ی")):
        for _ in range(2):  # letters in a row overlap
            x = f"regexp_replace({x}, '{a}([{SIGNS}]*[{JOINING}])', '{b}\\1', 'g')"
    return f"trim(regexp_replace({x}, '{BLANKS}', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that it can express. Tokenizers, random rounding, packing and
    fitted models are tested against public tokenizers, brute force, exact round trips
    and held-out rows instead."""
    both = f"WITH f AS (SELECT row_id, instruction, output, {_consistent_sql('instruction')} AS i, {_consistent_sql('output')} AS o FROM train)"
    words = lambda x: f"regexp_extract_all(lower({_consistent_sql(x)}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
    leaked = f"""
WITH p AS (SELECT id, {words('prompt')} AS w FROM prompts WHERE prompt IS NOT NULL), t AS (SELECT row_id, {words('instruction')} AS w FROM train WHERE instruction IS NOT NULL),
pg AS (SELECT DISTINCT id, array_to_string(w[k:k + 7], ' ') AS g FROM p, unnest(range(1, len(w) - 6)) r(k)), tg AS (SELECT DISTINCT row_id, array_to_string(w[k:k + 7], ' ') AS g FROM t, unnest(range(1, len(w) - 6)) r(k)),
hit AS (SELECT DISTINCT row_id, id FROM tg JOIN pg USING (g))
"""
    return {
        "p2_found": both + " SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM f a JOIN f b ON a.i = b.i AND a.o = b.o AND a.row_id < b.row_id WHERE a.instruction <> b.instruction OR a.output <> b.output",
        "p2_classes": both + " SELECT row_id, min(row_id) OVER w AS class_id, len(list(DISTINCT [instruction, output]) OVER w) AS n_spellings FROM f WHERE i IS NOT NULL AND o IS NOT NULL WINDOW w AS (PARTITION BY i, o)",
        "p2_consistent": both + " SELECT row_id, i AS instruction, o AS output FROM f",
        "p5_found": leaked + " SELECT row_id, id FROM hit",
        "p5_records": leaked + " SELECT row_id, count(*) AS n_prompts, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM hit GROUP BY row_id",
    }
