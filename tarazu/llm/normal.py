"""One consistent form for texts that look the same (problem 2).

The form is defined on what a reader sees: characters that show nothing are
removed, width and joining forms are folded, letters that are drawn the same in
their place get one spelling, and white space becomes single spaces. Letter
case, vowel signs, punctuation and the presence of a word space are kept.

Each letter has a resolved script set: the scripts of its Script_Extensions and those
that have a letter drawn like it. The sets of a token's letters are intersected. One
script left is the token's, and letters of others in it are respelt. Several left make
the token a whole-script confusable: it is spelt in the script of the nearest word of
its text that leaves no choice, so that real Russian or Greek stays what it is. Where
no word of the text decides, the text looks like Latin as much as like the other
script, and all spellings of it get the Latin one. None left: the token stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.session import materialize, spread

# Fixed values, after the Unicode list of confusables: letters of other scripts and the Latin
# letters that they are drawn as.
DRAWN_AS = {
    "Cyrl": ("АВЕЅІЈКМНОРСТУХԚԜӀаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXQWIaesijopcyxhdqwl"),
    "Grek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿανορυιϲϳγ", "ABEZHIKMNOPTYXCJavopuicjy"),
    "Armn": ("ՕՍԼօսհոցզյ", "OULouhngqj"),
    "Copt": ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),
    "Cher": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏞᏟᏢᏙᏦᏴᎥꮯꮃꮩꮪꮓ", "DRTAJEWMHGZRWSLCPVKBicwvsz"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}

#: Scripts in the order in which one is chosen where nothing else decides.
SCRIPTS = ("Latn", *DRAWN_AS)
#: The Latin letter of every letter that is drawn as one, and the letter of each script for a Latin one.
LATIN = {a: b for letters, drawn in DRAWN_AS.values() for a, b in zip(letters, drawn, strict=True)}
_SPELL: dict[str, dict[str, str]] = {"Latn": {b: b for b in LATIN.values()}}
for _script, (_letters, _drawn) in DRAWN_AS.items():
    _SPELL[_script] = {}
    for _a, _b in zip(_letters, _drawn):
        _SPELL[_script].setdefault(_b, _a)
_FOREIGN = regex.compile("[" + "".join(rf"\p{{scx={x}}}" for x in DRAWN_AS) + r"--\p{M}]", regex.V1)
_TOKEN = regex.compile("(?:[" + "".join(rf"\p{{scx={x}}}" for x in SCRIPTS) + r"&&\p{L}]\p{M}*)+", regex.V1)
_OF = {x: regex.compile(rf"\p{{scx={x}}}") for x in SCRIPTS}

#: Records of a class that one task pairs with the rest of it.
CLASS_ROWS = 1000

_HIDDEN = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_FORMS = re.compile("[Ⅰ-ⅿﬀ-ﬆﭐ-﷿ﹰ-﻾＀-￯]+")
# letters that join the one before them: all Arabic letters but hamza, and the kashida
_JOINS = "ؠآ-يٮٯٱ-ۓەۺ-ۼۿݐ-ݿࢠ-ࣇ"
_MARKS = "ً-ٰٟۖ-ۜ۟-۪ۨ-ۭ"
_KAF = re.compile(f"ك(?=[{_MARKS}]*[{_JOINS}])")
_YEH = re.compile(f"ي(?=[{_MARKS}]*[{_JOINS}])")
_ARABIC = re.compile("[كهىئ٠-٣٧-٩ە]")
#: alef maksura is a dotless final yeh; the digits but 4, 5 and 6 are drawn alike in both Arabic sets
_SAME = {0x649: "ی"} | {0x660 + i: chr(0x6F0 + i) for i in (0, 1, 2, 3, 7, 8, 9)}
#: anything that isn't certain to stay as it is, white space aside
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ،؛؟ء-عغفقل-نو٪-٬ٱ-ڿۀ-۔۰-۹ऀ-नप-रलळव-हऽ-ॗॠ-॰–—‘-”…]")


@lru_cache(None)  # one entry for each letter of these scripts
def _own(letter: str) -> frozenset[str]:
    return frozenset(x for x, p in _OF.items() if p.match(letter))


@lru_cache(None)
def _able(letter: str) -> frozenset[str]:
    """The resolved script set of a letter."""
    latin = LATIN.get(letter, letter)
    return _own(letter) | {x for x in SCRIPTS if latin in _SPELL[x]}


def scripts(token: str) -> set[str]:
    """The intersection of the Script_Extensions of a token's letters: empty if it mixes scripts."""
    return set(frozenset.intersection(*(_own(c) for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))))


@lru_cache(1 << 14)
def resolved(token: str) -> frozenset[str]:
    """The scripts that can draw all letters of a token."""
    return frozenset.intersection(*(_able(c) for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)))


@lru_cache(1 << 14)
def _spelt(token: str, script: str) -> str:
    spell, own = _SPELL[script], _OF[script]
    letters = (c if own.match(c) or unicodedata.combining(c) else spell[LATIN.get(c, c)] for c in unicodedata.normalize("NFD", token))
    return unicodedata.normalize("NFC", "".join(letters))


def respelt(text: str) -> str:
    """The text with each token in the script that its letters, or else its neighbours, leave."""
    found = list(_TOKEN.finditer(text))
    able = [resolved(m[0]) for m in found]
    sure = [next(iter(x)) if len(x) == 1 else None for x in able]
    after, nxt = [None] * len(found), None
    for k in range(len(found) - 1, -1, -1):
        after[k] = nxt
        nxt = sure[k] or nxt
    out, at, before = [], 0, None
    for k, m in enumerate(found):
        if able[k]:
            script = sure[k] or next((x for x in (before, after[k], *SCRIPTS) if x in able[k]))
            out += [text[at : m.start()], _spelt(m[0], script)]
            at = m.end()
        before = sure[k] or before
    return "".join([*out, text[at:]])


def consistent(text: str) -> str:
    """The consistent form of a text. Texts look the same iff their forms are equal."""
    if not _UNUSUAL.search(text):
        return " ".join(text.split())
    text = _HIDDEN.sub("", text)
    text = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = unicodedata.normalize("NFC", text)
    if _ARABIC.search(text):
        text = text.translate(_SAME).replace("یٔ", "ئ")
        text = _YEH.sub("ی", _KAF.sub("ک", text))
    if _FOREIGN.search(text):
        text = respelt(text)
    return " ".join(text.split())


def _halves(data: str) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data.encode("utf-8", "surrogatepass"))
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, q, a in zip(*(c.to_pylist() for c in b.columns)):
            rows.append((i, *_halves(f"{consistent(q)}\0{consistent(a)}"), *_halves(f"{len(q)}\0{q}{a}")))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["row_id", "k1", "k2", "r1", "r2"])


def fingerprints(train: DataFrame) -> DataFrame:
    """row_id, 128 bits of the consistent form (k1, k2) and of the raw code points
    (r1, r2) of both fields. Rows with a null field have no form and are left out."""
    both = train.select("row_id", "instruction", "output").where("row_id is not null and instruction is not null and output is not null")
    return spread(both).mapInArrow(_fingerprints, "row_id long, k1 long, k2 long, r1 long, r2 long")


def same_looking_pairs(train: DataFrame) -> DataFrame:
    """All pairs of records that look the same and differ in code points.

    Only 40 bytes a record are shuffled. Keys with a single spelling, however
    many copies they have, end in a partial aggregation and never meet a join;
    for the rest spellings are paired first and records joined to those pairs,
    so that exact copies are never compared with each other. The pairs of a class are
    all asked for; the class is dealt over as many tasks as it has CLASS_ROWS records.
    Null fields: no case. Empty texts are texts. A repeated row_id pairs only
    with other ids. Empty table: no rows.
    """
    m = materialize(fingerprints(train))
    several = m.groupBy("k1", "k2").agg(F.min(F.struct("r1", "r2")).alias("lo"), F.max(F.struct("r1", "r2")).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    rows = m.join(several.select("k1", "k2", F.ceil(F.col("n") / CLASS_ROWS).cast("int").alias("parts")), ["k1", "k2"])
    spellings = rows.select("k1", "k2", F.struct("r1", "r2").alias("raw")).distinct()
    pairs = spellings.withColumnRenamed("raw", "raw_a").join(spellings.withColumnRenamed("raw", "raw_b"), ["k1", "k2"]).where("raw_a < raw_b")
    a = rows.select("k1", "k2", F.struct("r1", "r2").alias("raw_a"), F.col("row_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = rows.select("k1", "k2", F.struct("r1", "r2").alias("raw_b"), F.col("row_id").alias("b"), F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"))
    out = pairs.join(a, ["k1", "k2", "raw_a"]).join(b, ["k1", "k2", "raw_b", "part"]).where("a <> b")
    return out.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b")).distinct()


def same_looking_classes(train: DataFrame) -> DataFrame:
    """One row per record with both fields: the least row_id that looks the same
    as its class id, and the number of spellings the class has."""
    m = materialize(fingerprints(train))
    classes = m.groupBy("k1", "k2").agg(F.min("row_id").alias("class_id"), F.count_distinct("r1", "r2").alias("n_spellings"))
    return m.join(classes, ["k1", "k2"]).select("row_id", "class_id", "n_spellings")


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(0)] + [pa.array([None if t is None else consistent(t) for t in b.column(i).to_pylist()], pa.string()) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays(cols, names=["row_id", "instruction", "output"])


def consistent_fields(train: DataFrame) -> DataFrame:
    """row_id with the consistent form of both fields; a null field stays null."""
    return spread(train.select(F.col("row_id").cast("long"), "instruction", "output")).mapInArrow(_forms, "row_id long, instruction string, output string")
