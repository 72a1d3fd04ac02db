"""Texts that were cut before their end (problem 9), in Spark SQL.

Units are lines and sentences. All word trigrams of finished units are counted,
inside units and at their ends. A document whose last unit has no final stop is
judged by its final trigram: one that is frequent inside units but almost never ends
one marks a cut. The same is asked of the trigrams that share its first two words: a
last word that there only begins longer ones is broken off, and a place whose third
words almost never end a unit doesn't end one now. Where trigrams are too rare, the
counts back off to the last two words and then to the last word. Open code blocks,
broken chat markers, bare list items and half characters are cuts by form. Marks that
authors put after a finished text (signatures, emoji, rules, end lines, references)
end it.

A text is read once and split once. Its first two words of a trigram leave as
hashes, the third as it is, since its beginnings are compared.
"""

from __future__ import annotations

import unicodedata
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm import normal
from tarazu.session import materialize, spread

#: Trigrams seen so often are judged by their own counts.
SEEN = 3
#: A place or bigram needs so many sightings.
SEEN_PLACE = 5
#: Below this share of sightings at an end, words don't end a unit.
END_SHARE = 0.2
#: A word is broken off if it is seen less often than this share of the longer words that begin with it.
BEGUN_SHARE = 0.02
#: A word that is seen often and whose sightings are at an end by this share is whole.
SURE_SHARE = 0.9
#: A place that ends units judges the endings of rare words if seen so often; endings with less than this share are broken.
SEEN_ENDINGS, ENDING_SHARE = 30, 0.005


def _one_to_one() -> tuple[str, str]:
    """Letters in presentation or wide form, look-alikes and variants with their plain letter."""
    pairs = {chr(c): f for c in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFF5F)) if len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f != chr(c)}
    pairs |= normal.LATIN | {"ك": "ک", "ي": "ی", "ى": "ی", "ە": "ہ"} | {chr(c): t for c, t in normal._SAME.items()}
    return "".join(pairs), "".join(pairs.values())


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Signs that end a sentence before a blank, and signs that hold no word.
STOPS = (".", "۔", "?", "!", "؟", "।")
SIGNS = ("\"", "“", "”", "(", ")", "[", "]", "*", "#", "=", *STOPS, "…", "\ufffd")
#: What may follow a finished text: end marks of chats, references, emoji, signatures, end lines.
AFTER = (
    r"(?<!\s)(?:\s*+(?:[\"”»)]\s*+)?(?:<\|(?:im_end|endoftext)\|>|\(\d+\)|\[\d+\]|[\p{So}\x{1F3FB}-\x{1F3FF}&&[^\x{FFFD}]]+)|(?:[^\S\n]*+\n|(?<=\|>))\s*+(?:[*=_~]+|[*=_~#-]{3,}|— ?[^\n]{1,60}|THE END|The end|Tamam shud|ختم شد|تمام شد)|\s*+[\"”»)])+$"
)


def _words(source: str) -> str:
    """WITH clause of `words`: the tokens of the finished units of each text, and those
    of a last unit without stop. Two line ends come before each unit, numbers are 0, and
    words of list items are marked, since what ends an item seldom ends a sentence.
    Costly patterns run only where a cheap test finds something."""
    old, new = _one_to_one()
    hidden = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
    blanks = r"[\r\x{85}\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\t]"
    # signs that don't stay as they are; a negated class of all others takes Java many times as long
    odd = r"[\x{FB50}-\x{FFEF}\x{34F}-\x{58F}\x{643}\x{649}\x{64A}\x{660}-\x{669}\x{6D5}\x{1680}-\x{200F}\x{2028}-\x{206F}\r\t\x{85}\x{A0}\x{AD}\x{61C}\x{3000}]"
    # stops end sentences before a blank; these and other signs hold no word. Plain replacements
    # cost a fraction of a pattern over whole texts
    broken_up = "replace(t6, '\\n', ' \\n \\n ')"
    for stop in STOPS:
        broken_up = f"replace({broken_up}, '{stop} ', ' \\n \\n ')"
    plain = lambda x: reduce(lambda y, sign: f"replace({y}, {_q(sign)}, ' ')", SIGNS, x)
    last_line = "substring_index(t3, '\\n', -1)"
    one_row = lambda **columns: "LATERAL VIEW inline(array(named_struct(" + ", ".join(f"'{k}', {x}" for k, x in columns.items()) + "))) AS " + ", ".join(columns)
    # each step is a generator of one row: the optimizer would else write its expression
    # into every place that uses it, and patterns would run many times
    steps = (
        one_row(odd=f"if(octet_length(text) = length(text), instr(text, '\\t') > 0 OR instr(text, '\\r') > 0, text RLIKE {_q(odd)})"),
        one_row(t0=f"if(odd, regexp_replace(regexp_replace(translate(text, {_q(old)}, {_q(new)}), {_q(hidden)}, ''), {_q(blanks)}, ' '), text)"),
        one_row(t1="trim(TRAILING ' \\n\\t\\u000b\\u000c' FROM t0)"),
        one_row(t2="if(instr('*=_~#-', right(t1, 1)) > 0, trim(TRAILING '*=_~#- \\n' FROM t1), t1)"),
        one_row(ruled=f"t2 <> t1 AND substring(t1, length(t2) + 1) RLIKE {_q(r'^[ ]*\n\s*(?:[*=_~]+|[*=_~#-]{3,})')}"),
        one_row(t3="if(ruled, t2, t1)"),
        one_row(stopped=f"t3 <> '' AND instr('{''.join(STOPS)}', right(t3, 1)) > 0"),
        one_row(closed=f"ruled OR NOT stopped AND (right(t3, 1) RLIKE {_q(r'[^\p{L}\p{M}\p{N}]')} OR {last_line} RLIKE {_q(r'^\s*(?:— ?|THE END|The end|Tamam shud|ختم شد|تمام شد)|\|>\s*— ?')}) AND t3 RLIKE {_q(AFTER)}"),
        one_row(
            open_code="instr(t3, '```') > 0 AND (length(t3) - length(replace(t3, '```', ''))) % 6 = 3 OR endswith(t3, '\\n`') OR endswith(t3, '\\n``')",
            open_mark=f"NOT stopped AND instr(t3, '<|') > 0 AND t3 RLIKE {_q(r'<\|[a-z_]*\|?$')}",
            broken=f"NOT stopped AND endswith(t3, '\ufffd') AND t3 RLIKE {_q(r'[\p{L}\p{M}\p{N},،:-] *\x{FFFD}+$')}",
            bare_item=f"right(t3, 1) IN ('-', '.', ')') AND {last_line} RLIKE {_q(r'^ *(?:-|\d+[.)])$')}",
            unfinished="NOT closed AND NOT endswith(t3, '```') AND (endswith(t3, '..') OR NOT stopped)",
        ),
        one_row(t4=f"if(closed AND NOT ruled, regexp_replace(t3, {_q(AFTER)}, '\\n'), t3)"),
        one_row(t5=f"if(instr(t4, '```') > 0, regexp_replace(t4, {_q(r'(?s)```.*?(?:```|$)')}, '\\n'), t4)"),
        one_row(t6=f"if(instr(t5, '<|') > 0, regexp_replace(t5, {_q(r'<\|[a-z_]+\|>')}, '\\n'), t5)"),
        one_row(t7=f"concat(' \\n \\n ', {broken_up}, ' ')"),
        one_row(has_items="instr(t7, '\\n - ') > 0 OR instr(t7, '\\n • ') > 0 OR instr(t7, '\\n * ') > 0"),
        one_row(t8=f"if(has_items, regexp_replace(t7, {_q(r'(?<=\n )[-•*] +')}, '• '), t7)"),
        one_row(t9=plain("t8")),
        one_row(t10="replace(replace(t9, '  ', ' '), '  ', ' ')"),
        one_row(t11="if(instr(t10, '  ') > 0, regexp_replace(t10, ' {2,}', ' '), t10)"),
        one_row(t12=f"trim(TRAILING ' \\n' FROM if(has_items, regexp_replace(t11, {_q(r'(?:(?<=\n )• |\G)([^ \n]+) ')}, '$1• '), t11))"),
        one_row(tail="if(unfinished, substring_index(t12, '\\n', -1), '')"),
        one_row(body="if(unfinished, left(t12, length(t12) - length(tail)), concat(t12, ' \\n'))"),
        one_row(w="split(concat(trim(BOTH ' ' FROM body), ' '), ' ')", z="split(concat('\\n \\n ', trim(BOTH ' ' FROM tail)), ' ')"),
        one_row(c="get(z, size(z) - 1)"),
        one_row(asked=f"unfinished AND c RLIKE {_q(r'[\p{L}\p{N}]')}"),
        one_row(marks="int(open_code) + 2 * int(open_mark) + 4 * int(bare_item) + 8 * int(broken) + 16 * int(unfinished) + 32 * int(asked AND instr(body, concat(' ', c)) > 0 AND body RLIKE concat('[ \\n]\\\\Q', replace(c, '\\\\E', ''), '\\\\E[^ \\n]{2}'))"),
    )
    return "WITH words AS (SELECT doc_id, source, marks, w, z, c, asked FROM " + source + "\n" + "\n".join(steps) + "\nWHERE t1 <> '')"


def _number(word: str) -> str:
    """A word, or 0 for all that begin with a digit."""
    return f"if({word} >= '0' AND {word} < ':' OR {word} >= '٠' AND {word} < '٪' OR {word} >= '۰' AND {word} < 'ۺ', '0', {word})"


#: One row of counts for each trigram, and one for each document with its marks and its final
#: trigram, if that is asked about; the word after the last one stands for the document.
_COUNTED = f"""
SELECT doc_id, source, marks, xxhash64({_number("w1")}, {_number("w2")}) AS h12, xxhash64({_number("w2")}) AS h2, {_number("w3")} AS w3, count(*) AS n, count_if(ends) AS e
FROM (
  SELECT if(last, CAST(doc_id AS BIGINT), NULL) AS doc_id, if(last, source, NULL) AS source, if(last, marks, 0) AS marks, last, if(last, get(z, size(z) - 3), get(w, i - 2)) AS w1, if(last, get(z, size(z) - 2), get(w, i - 1)) AS w2,
    if(last, if(asked, c, NULL), t) AS w3, NOT last AND get(w, i + 1) = '\n' AS ends
  FROM (SELECT *, i = size(w) - 1 AS last FROM words LATERAL VIEW posexplode(w) AS i, t)
) WHERE last OR w3 <> '\n' AND w3 <> ''
GROUP BY ALL
"""

_JUDGED = f"""
WITH grams AS (
  SELECT h12, h2, w3, n, e, rtrim('•', w3) AS bare, if(endswith(w3, '•'), '•', '') AS mark FROM {{counted}} WHERE doc_id IS NULL
), tails AS (
  SELECT doc_id, source, n AS copies, h12, h2, w3 AS c, marks & 1 > 0 AS open_code, marks & 2 > 0 AS open_mark, marks & 4 > 0 AS bare_item, marks & 8 > 0 AS broken, marks & 16 > 0 AS unfinished, marks & 32 > 0 AS longer_here
  FROM {{counted}} WHERE doc_id IS NOT NULL
), asked AS (
  SELECT DISTINCT h12, h2, c FROM tails WHERE c IS NOT NULL
), places AS (
  SELECT h12, collect_set(length(rtrim('•', c))) AS lengths FROM asked GROUP BY h12
), before AS (
  SELECT h2, collect_set(length(rtrim('•', c))) AS lengths FROM asked GROUP BY h2
), any_length AS (
  SELECT collect_set(length(rtrim('•', c))) AS lengths FROM asked
), two AS (
  SELECT h2, w3, bare, mark, sum(n) AS n, sum(e) AS e FROM grams GROUP BY ALL
), one AS (
  SELECT w3, bare, mark, sum(n) AS n, sum(e) AS e FROM two GROUP BY ALL
), evidence AS (
  SELECT level, h, k.kind, k.s, sum(n) AS n, sum(e) AS e FROM (
    SELECT 3 AS level, h12 AS h, n, e, explode(concat(array(named_struct('kind', 'same', 's', w3), named_struct('kind', 'all', 's', ''), named_struct('kind', 'ending', 's', right(w3, 3))),
      transform(filter(lengths, l -> l < length(bare)), l -> named_struct('kind', 'begun', 's', concat(left(bare, l), mark))))) AS k
    FROM grams JOIN places USING (h12)
    UNION ALL
    SELECT 2, h2, n, e, explode(concat(array(named_struct('kind', 'same', 's', w3)), transform(filter(lengths, l -> l < length(bare)), l -> named_struct('kind', 'begun', 's', concat(left(bare, l), mark)))))
    FROM two JOIN before USING (h2)
    UNION ALL
    SELECT 1, 0L, n, e, explode(concat(array(named_struct('kind', 'same', 's', w3)), transform(filter(lengths, l -> l < length(bare)), l -> named_struct('kind', 'begun', 's', concat(left(bare, l), mark)))))
    FROM one CROSS JOIN any_length
  ) GROUP BY ALL
), judged AS (
  SELECT h12, h2, c, {", ".join(f"coalesce(sum(if(level = {level} AND kind = '{kind}', {x}, 0)), 0) AS {name}" for level, kind, x, name in ((3, "same", "n", "n3"), (3, "same", "e", "e3"), (3, "begun", "n", "l3"), (3, "all", "n", "np"), (3, "all", "e", "ep"), (3, "ending", "n", "nx"), (2, "same", "n", "n2"), (2, "same", "e", "e2"), (2, "begun", "n", "l2"), (1, "same", "n", "n1"), (1, "same", "e", "e1"), (1, "begun", "n", "l1")))}
  FROM (
    SELECT h12, h2, c, k.level, k.h, k.kind, k.s FROM (SELECT *, explode(array({", ".join(f"named_struct('level', {level}, 'h', {h}, 'kind', '{kind}', 's', {s})" for level, h, kind, s in ((3, "h12", "same", "c"), (3, "h12", "begun", "c"), (3, "h12", "all", "''"), (3, "h12", "ending", "right(c, 3)"), (2, "h2", "same", "c"), (2, "h2", "begun", "c"), (1, "0L", "same", "c"), (1, "0L", "begun", "c")))})) AS k FROM asked)
  ) LEFT JOIN evidence USING (level, h, kind, s)
  GROUP BY h12, h2, c
)
SELECT doc_id, source, copies, t.c, unfinished, n3, e3, l3, np, ep, n2, e2, l2, n1, e1, l1, nx, longer_here,
  CASE
    WHEN open_code THEN 'code'
    WHEN open_mark THEN 'mark'
    WHEN bare_item THEN 'item'
    WHEN NOT unfinished THEN NULL
    WHEN broken THEN 'half character'
    WHEN t.c IS NULL THEN NULL
    WHEN n3 >= {SEEN} THEN CASE WHEN e3 < {END_SHARE} * n3 THEN 'trigram' END
    WHEN np >= {SEEN_ENDINGS} AND l3 >= (1 - {END_SHARE}) * np THEN 'trigram begun'
    WHEN n2 = 0 AND l2 > 0 AND NOT (n1 >= {SEEN_PLACE} AND e1 >= {SURE_SHARE} * n1) THEN CASE WHEN l3 > 0 THEN 'trigram begun' ELSE 'bigram begun' END
    WHEN np >= {SEEN_PLACE} AND ep < {END_SHARE} * np THEN 'trigram place'
    WHEN n1 <= 1 AND longer_here THEN 'word begun here'
    WHEN n1 < {SEEN_PLACE} AND np >= {SEEN_ENDINGS} AND nx < {ENDING_SHARE} * np THEN 'trigram ending'
    WHEN n1 < {BEGUN_SHARE} * l1 THEN 'word begun'
    WHEN n2 >= {SEEN} AND e2 < {END_SHARE} * n2 THEN 'bigram'
    WHEN np >= {SEEN_PLACE} OR n2 >= {SEEN} THEN NULL
    WHEN n1 >= {SEEN} AND e1 < {END_SHARE} * n1 THEN 'word'
  END AS sign
FROM tails t LEFT JOIN judged j ON t.h12 = j.h12 AND t.h2 = j.h2 AND t.c = j.c
"""


def signs(documents: DataFrame) -> DataFrame:
    """One row per document with a text: the sign of its cut, or null, and how many
    copies of the row there are. Null and blank texts have no row. Counts cover all
    documents; a last unit without stop is judged, not counted. Texts are read once:
    the last words of each leave with the trigrams, in one shuffle of counts."""
    spark = documents.sparkSession
    name = f"tarazu_{uuid.uuid4().hex}"
    spread(documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null")).createOrReplaceTempView(name)
    materialize(spark.sql(_words(name) + _COUNTED)).createOrReplaceTempView(f"{name}_counted")
    out = spark.sql(_JUDGED.format(counted=f"{name}_counted"))
    for view in (name, f"{name}_counted"):
        spark.catalog.dropTempView(view)
    return out


def cut_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every cut document, once."""
    return signs(documents).where("sign is not null").select("doc_id").distinct()


def cut_shares(documents: DataFrame) -> DataFrame:
    """For each source its texts that aren't blank, how many are cut and their share."""
    return signs(documents).groupBy("source").agg(F.sum("copies").alias("n_texts"), F.coalesce(F.sum(F.when(F.col("sign").isNotNull(), F.col("copies"))), F.lit(0)).alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
