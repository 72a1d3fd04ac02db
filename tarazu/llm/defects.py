"""Broken prompt and response pairs (problem 6).

For every defect several labelling functions vote on each pair: yes, no or
nothing. Each looks at another kind of evidence (letters, vocabulary, form, length,
script, counts over all outputs, a fitted machine), none waits for another, and none
is right alone. A label model, fitted by expectation maximization on the counts of
vote patterns of all pairs, estimates how often each function votes what given the
truth, and gives each pattern the posterior of the defect. A pair keeps every defect
whose posterior exceeds the cutoff. Cutoffs are validated: the share of defects found
is that of defects simulated from all pairs, which the model hasn't seen, and the share
of wrong ones is what the models of two halves expect, each on the other half.

Patterns are few, so the counts are what reaches the driver; pairs are never
shuffled. Three small machines back some functions: language machines as those of
problem 4, one that tells ends of sentences from cuts and one that knows refusals by
the words around their phrases. They learn from all rows, where these lie (`descent`).
Texts are read once, in blocks: what each shows without the machines, counts of words,
simulated defects, and hashed features that machines are fitted on and asked for later
(`blocks`). `Votes` says the same of one pair. Last words meet the counts afterwards.
"""

from __future__ import annotations

import json
import math
import pickle
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions.order import bounded_sample
from tarazu.llm import blocks, descent
from tarazu.llm.answers import _EMPTY_WORDS, HEADINGS, _ITEM, _MARK, is_empty_answer, lines, sentences, without_code
from tarazu.llm.languages import FAMILIES, LANGUAGES, SAMPLE_ROWS, Machines, family, fit, label_language
from tarazu.llm.normal import consistent
from tarazu.session import materialize, spread

#: In the order in which one is chosen.
DEFECTS = ("empty_answer", "copied_question", "refusal", "truncated_answer", "other_language")
#: The labelling functions of each.
FUNCTIONS = {
    "empty_answer": ("letters", "vocabulary", "form", "shared words", "size"),
    "copied_question": ("word run", "letters", "bag of words", "length", "last words"),
    "refusal": ("declining phrase", "talk about asking", "length", "machine", "quotation"),
    "truncated_answer": ("machine", "open block", "last sign", "broken word", "last word"),
    "other_language": ("machines", "scripts", "function words", "letters"),
}
#: Rows of a sample in memory that the machines for ends and refusals learn from, at most; whole tables have no limit.
SAMPLED_ROWS = 8000
END_FEATURES, END_WIDTH = blocks.END_FEATURES, blocks.END_WIDTH
#: A block of texts is closed when the machine for ends has so many rows of it.
BLOCK_ROWS = 500_000
#: A word that finished units hold so often is known; so often and it has a habit.
KNOWN, HABIT = 5, 20
#: The machine calls a place a cut below and an end above these.
CUT, END = 0.25, 0.6
#: The machine calls a text a refusal above the one and none below the other.
SAID, UNSAID = 0.85, 0.3

# What a copied question may be headed by, refusal phrases and names of languages.
QUESTION_HEADS = r"(?:question|instruction|prompt|task|q|you asked|your question is|sawal|aap ne poocha|aap ka sawal hai|aap ka sawal|hidayat|سوال|آپ نے پوچھا|آپ کا سوال ہے|آپ کا سوال|ہدایت|प्रश्न|सवाल|आपने पूछा|السؤال|سؤال|پرسش)"
REFUSAL_OBJECTS = r"sorry|apolog|unfortunately|regret|language model|\bai\b|assist|help|request|question|answering|thank you for asking|provide|maazrat|mazrat|maaf|afsos|zabani model|zubani model|sawal|mauzoo|madad|poochiye|poochein|raye|معذرت|معاف|افسوس|زبانی ماڈل|سوال|موضوع|مدد|پوچھی|رائے|क्षमा|माफ़|खेद|सवाल|मदद|عذرا|آسف|أعتذر|السؤال|متأسف|ببخشید|پوزش|پرسش"
REFUSAL_PREDICATES = r"\bcan'?t\b|\bcan’t\b|\bcannot\b|\bcan not\b|\bwon'?t\b|\bwon’t\b|\bunable\b|not able to|not something i|not permitted|not allowed|outside what i|outside my|beyond my|must decline|have to decline|\bnahin? (?:de|kar|bata|likh|ho) ?(?:sak|pa)|\bqasir\b|hadood se bahar|ijazat nahi|madad nahi|نہیں (?:دے|کر|بتا|لکھ|ہو) ?(?:سک|پا)|قاصر|حدود سے باہر|اجازت نہیں|مدد نہیں|नहीं (?:दे|कर|बता|लिख) ?(?:सक|पा)|असमर्थ|لا أستطيع|لا أقدر|لا يمكنني|غير قادر|نمی ?توان"
QUOTED = r"you (?:may|can|could) say|aap keh sakte|keh sakte hain|آپ کہہ سکتے|کہہ سکتے ہیں|\bdear\b|mohtaram|محترم"
ASKED = {
    "urdu": r"\burdu\b|اردو|उर्दू", "english": r"\benglish\b|angrezi|انگریزی|انگلش|अंग्रेज़ी|الإنجليزية|انگلیسی", "hindi": r"\bhindi\b|devanagari|ہندی|हिंदी|हिन्दी|देवनागरी",
    "arabic": r"\barabic\b|\barabi\b|عربی|العربية|अरबी", "persian": r"\bpersian\b|\bfarsi\b|فارسی|الفارسية|फ़ारसी",
}
FUNCTION_WORDS = {
    "english": "the of and is to in that for was with this are", "roman_urdu": "hai ka ki ke mein aur se ko par hain ne nahi",
    "urdu_script": "ہے کا کی کے میں اور سے کو پر ہیں نے نہیں", "arabic": "في من على إن هذا هو عند إلى التي الذي أن", "persian": "است در از را که برای این شد بین و با", "hindi": "है का की के में और से को पर हैं ने नहीं",
}

#: Sentences for simulated refusals.
SIMULATED_REFUSALS = ("I cannot answer this.", "I'm sorry, I am unable to help with that request.", "Unfortunately I can't provide this.", "معذرت، میں اس کا جواب نہیں دے سکتا۔", "یہ میری حدود سے باہر ہے۔", "Maazrat, main is ka jawab nahi de sakta.", "Is mein madad nahi kar sakta.", "क्षमा करें, मैं इसका उत्तर नहीं दे सकता।")
#: Letters that Urdu has and Arabic and Persian don't.
URDU_LETTERS = frozenset("ٹڈڑےںھہۂۓ")

_WORDS = re.compile(r"(?:[^\W_]|[\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f])+")
#: Headings before a copied question, in its words.
_QUESTION = regex.compile(rf"(?:{consistent(QUESTION_HEADS[3:-1])}|{'|'.join(map(regex.escape, HEADINGS))}) ")
# the texts that these are searched in are in the consistent form, so the phrases are too
_OBJECT, _PREDICATE, _QUOTED = (re.compile(consistent(p)) for p in (REFUSAL_OBJECTS, REFUSAL_PREDICATES, QUOTED))
_ASKED = {k: re.compile(consistent(p)) for k, p in ASKED.items()}
_ASKED_STEMS = {k: tuple(consistent(p).replace("\\b", "").split("|")) for k, p in ASKED.items()}
#: The phrases of _OBJECT, all plain but one; looking for each costs a fraction of the pattern.
_OBJECTS, _AI = tuple(x for x in _OBJECT.pattern.split("|") if "\\" not in x), re.compile(r"\bai\b")
#: One of these is in every phrase of _QUOTED.
_QUOTED_PARTS = tuple(map(consistent, ("you may say", "you can say", "you could say", "keh sakte", "کہہ سکتے", "dear", "mohtaram", "محترم")))
_HIDDEN = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in consistent(_v).split():
        _LANGUAGES_OF[_w] = (*_LANGUAGES_OF.get(_w, ()), _k)
#: One of these is in every refusal phrase; a cheap test before the pattern: the longest fixed part of each of its phrases.
_STEMS = tuple(sorted({max(re.split(r"\\b|\(\?:[^()]*\)|.\?", p), key=len) for p in re.split(r"\|(?![^()]*\))", _PREDICATE.pattern)}))
_UNITS = re.compile(r"(?<=[.۔?!؟।])\s+|\n+")
_STRIPPED = re.compile(r"[\"“”()\[\]*#=.۔?!؟।…]+")
_STOP = re.compile(r"[.۔?!؟।][\"”’»')\]\s]*$")
#: What may follow the stop of a text.
_CLOSING = "\"”’»')] \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_DOTS = re.compile(r"(?:…|\.\.)[\"”’»')\]\s]*$")
_AFTER = regex.compile(r"(?:\s*+(?:<\|im_end\|>|<\|endoftext\|>|\(\d+\)|\[\d+\]|[\p{So}\U0001F3FB-\U0001F3FF--�]+))+$", regex.V1)
_QUOTES = re.compile(r"(?<!\w)['\"“«‘](?:[^'\"”»’\n]|(?<=\w)['’](?=\w))+['\"”»’](?!\w)")
#: A finished sentence and something in brackets after it.
_ASIDE = re.compile(r"[.۔?!؟।]\s*\([^()\n]*\)$")
_LISTED, _NUMBER = re.compile(r"\s*(?:[-*•]|\d+[.)])\s"), re.compile(r"\d+")
_BARE = re.compile(r"\s*(?:[-*•]|\d+[.)])\s*")
_BARE_ENDS = "-*•.)"
_GOING_ON = ",،;؛:-–(«“"


def _tokens(unit: str) -> tuple[list[str], bool]:
    """The words of a unit in the consistent form, and whether it is a list item."""
    return _STRIPPED.sub(" ", _NUMBER.sub("0", _ITEM.sub("", unit))).split(), _LISTED.match(unit) is not None


def _ended(text: str) -> tuple[bool, bool]:
    """Whether a text ends with a stop (as _STOP finds it), and whether with dots (_DOTS)."""
    t = text.rstrip(_CLOSING)
    return t[-1:] in _STOPS if t else False, t[-1:] == "…" or t[-2:] == ".."


_STOPS = frozenset(".۔?!؟।")


def _logistic(rows: list[list[int]], y: list[float]) -> tuple[np.ndarray, float]:
    """Weights and bias over rows of the same number of hashed features; both classes weigh the same."""
    at, y = np.ascontiguousarray(np.array(rows).T), np.array(y)
    steep = descent.bound(len(at), descent.shown(at, y, END_FEATURES))
    return descent.logistic(lambda x: descent.logistic_slope(at, y, *x[0], y.sum(), len(y) - y.sum()), [steep])[0]


class Linear:
    """A logistic machine over hashed features; a feature list of any length."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self._each = self.weights.tolist()

    def __reduce__(self):
        return type(self), (self.weights, self.bias)

    def chance(self, features: list[int]) -> float:
        z = sum(map(self._each.__getitem__, features), self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Ends(Linear):
    """Tells whether a unit of text is at its end after its last words."""

    def end(self, words: list[str], listed: bool) -> float:
        numbered = blocks.Numbered()
        at = [-1, -1, -1, *(numbered[w] for w in words[-3:])][-3:]
        return self.chance(blocks.Endings(numbered).features(*np.array(at)[:, None], np.array([len(words)]), np.array([listed]))[:, 0].tolist())


def _add_ends(text: str, rng: random.Random, rows: list[list[int]], y: list[float]) -> None:
    """Adds the finished units of a text in consistent lines and simulated cuts of them."""
    units, stopped, _ = _divided(text)
    if units and not stopped:
        units.pop()
    words, listed = blocks.Numbered(), np.array([_LISTED.match(u) is not None for u in units], dtype=bool)
    own = _unit_words(units)
    seeds = blocks.seeds(np.array([rng.getrandbits(40)], dtype=np.uint64), np.array([len(units)]))
    at, classes, times = blocks.end_rows(words, np.array([words[w] for u in own for w in u], dtype=np.int64), np.array([len(u) for u in own], dtype=np.int64), listed, seeds)
    rows += np.repeat(at, times, axis=1).T.tolist()
    y += np.repeat(classes, times).astype(float).tolist()


def fit_ends(outputs: list[str], seed: int = 7) -> Ends:
    """Logistic machine from finished units of texts and from simulated cuts of them."""
    rng = random.Random(seed)
    rows, y = [], []
    for text in outputs:
        _add_ends(lines(text), rng, rows, y)
    return Ends(*_logistic(rows, y)) if rows else Ends(np.zeros(END_FEATURES), 0.0)


#: Features of the machine for refusals, and the examples that it needs; without them it has no vote.
FRAMES, SEEDS = 24, 20


#: Words of the phrases that other functions look for; the machine doesn't see them.
_PHRASED = frozenset(_WORDS.findall(f"{_OBJECT.pattern} {_PREDICATE.pattern}".replace("\\b", " ")))


def _frames(words: list[str]) -> list[int]:
    """The words without those of the phrases: those with the least hashes of a text, so
    that there are always FRAMES of them."""
    grams = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in {*words} - _PHRASED]
    return [g % END_FEATURES for g in (sorted(grams) + [0] * FRAMES)[:FRAMES]]


class Refusals(Linear):
    """Knows a refusal by the words around its phrases."""

    def refusal(self, words: list[str]) -> float:
        return self.chance(_frames(words))


def _add_refusal(low: str, parts: int, rows: list[list[int]], y: list[float]) -> None:
    low = _unquoted(low)
    rows.append(_frames(_WORDS.findall(low)))
    y.append(float(parts <= 2 and _says_no(low) and _of_asking(low)))


def fit_refusals(outputs: list[str]) -> Refusals:
    """Learns from outputs in which a phrase that declines and talk about asking meet in one short text, against the others."""
    rows, y = [], []
    for text in outputs:
        _add_refusal(consistent(text).lower(), len(sentences(text)), rows, y)
    return Refusals(*_logistic(rows, y)) if SEEDS <= sum(y) < len(y) else Refusals(np.zeros(END_FEATURES), 0.0)


def _divided(text: str) -> tuple[list[str], bool, bool]:
    """The units of a text in consistent lines without code, whether it ends with a stop and whether with dots."""
    t = without_code(text).rstrip()
    return [u for u in _UNITS.split(t) if u and not u.isspace()], *_ended(t)


def _unfinished(text: str) -> tuple[list[str], str | None]:
    """The finished units of a text in consistent lines without code, and a last one that has no stop."""
    units, stopped, dots = _divided(text)
    return (units[:-1], units[-1]) if units and (dots or not stopped) else (units, None)


_ITEMS = re.compile(r"^[^\S\n]*(?:[-*•#>]+|\d+[.)])[^\S\n]*", re.M)


def _unit_words(units: list[str]) -> list[list[str]]:
    """The words of each of many units, as _tokens gives them."""
    return [u.split() for u in _STRIPPED.sub(" ", _NUMBER.sub("0", _ITEMS.sub("", "\n".join(units)))).split("\n")] if units else []


def _finished_words(text: str) -> Iterator[tuple[str, bool]]:
    """The words of finished units, and whether they end one, spelt as _tokens does."""
    for w in _unit_words(_unfinished(lines(text))[0]):
        yield from ((x, False) for x in w[:-1])
        yield from ((x, True) for x in w[-1:])


class Votes:
    """The labelling functions. A vote is 1 for the defect, -1 against it, else 0."""

    def __init__(self, machines: Machines, ends: Ends, refusals: Refusals):
        self.machines, self.ends, self.refusals = machines, ends, refusals

    def __call__(self, instruction: str, given: str | None, output: str | None) -> tuple[tuple[tuple[int, ...], ...], str | None, list[str]]:
        """The votes on each defect but those of the counts of words, the last word if it is
        open, and the finished units."""
        return self.voted(self.asked(instruction, given), output)[:3]

    def asked(self, instruction: str, given: str | None) -> tuple[list[str], list[str], tuple]:
        """The words of an instruction and of its input, and its languages."""
        low = consistent(instruction).lower()
        return _WORDS.findall(low), _WORDS.findall(consistent(given).lower()) if given and given.strip() else [], self.asked_languages(low, sentences(instruction))

    def voted(self, asked: tuple[list[str], list[str], tuple], output: str | None) -> tuple[tuple[tuple[int, ...], ...], str | None, list[str], tuple | None]:
        """What __call__ gives, and the languages of the output."""
        text = _text(output)
        q, more, wanted = asked
        flat, parts = " ".join(text.split()), sentences(text, True)
        low, a = _answer_words(flat)
        finished, open_ = _unfinished(text)
        truncated, word = self.truncated(text.rstrip(), finished, open_)
        said = self.said_languages(parts)
        return (self.empty(flat, q, a), self.copied(q, more, a), self.refused(low, a, parts), truncated, self.language(wanted, said)), word, finished, said

    def planted(self, defect: str, asked: tuple[list[str], list[str], tuple], output: str | None) -> tuple[tuple[int, ...], str | None]:
        """The votes on one defect only, and the last word if it is open."""
        text = _text(output)
        if defect == "truncated_answer":
            return self.truncated(text.rstrip(), *_unfinished(text))
        flat = " ".join(text.split())
        low, a = _answer_words(flat)
        if defect == "refusal":
            return self.refused(low, a, sentences(text, True)), None
        return self.empty(flat, asked[0], a) if defect == "empty_answer" else self.copied(*asked[:2], a), None

    @staticmethod
    def empty(flat: str, q: list[str], a: list[str]) -> tuple[int, ...]:
        flat = _MARK.sub(" ", flat).strip() if "<|" in flat else flat.strip()
        content = any(w not in _EMPTY_WORDS and w not in ("n", "a") and not (w == "no" and a[k + 1 : k + 2] in (["answer"], ["output"], ["response"])) for k, w in enumerate(a))
        size, asked = sum(map(len, a)), sum(map(len, q))
        return (
            1 if not a else 0 if len(a) <= 3 else -1,
            0 if not a else -1 if content else 1,
            1 if flat[:1] == "#" or flat[-1:] in (":", "：") else -1 if len(a) > 3 and _ended(flat)[0] or any(w.isdigit() for w in a) else 0,
            -1 if any(len(w) > 3 for w in set(q).intersection(a)) else 0,
            0 if size <= 0.4 * asked else -1,
        )

    @staticmethod
    def copied(q: list[str], more: list[str], a: list[str]) -> tuple[int, ...]:
        """Of the run of words, the stream of letters, the bag of words, the length and the end."""
        if not q:
            return (0,) * 5
        asked_words, letters, own, given, rest = " ".join(q), "".join(a), "".join(q), "".join(more), None
        if own in letters:
            answer = f" {' '.join(a)} "
            if f" {asked_words} " in answer:
                body = answer.strip()
                while (m := _QUESTION.match(body)) and m.end() < len(body):
                    body = body[m.end() :]
                rest = f" {body} "
                for piece in (asked_words, " ".join(more)):
                    while piece and f" {piece} " in rest:
                        rest = rest.replace(f" {piece} ", "  ")
            left = letters.replace(own, "")
            left = left.replace(given, "") if given else left
        qw, aw = {*q}, {*a}
        covered, needed = len(aw & {*qw, *more}) / max(1, len(aw)), len(qw & aw) / len(qw)
        times = len(letters) / max(1, len(own))
        near = min(abs(times - round(times)), abs((len(letters) - len(given)) / max(1, len(own)) - 1)) if round(times) else 1.0
        return (
            -1 if rest is None or len(rest.split()) > 2 else 0 if rest.strip() else 1,
            1 if own in letters and len(left) <= max(12, 0.2 * len(own)) else -1,
            1 if covered > 0.97 and needed > 0.97 else 0 if covered > 0.8 and needed > 0.8 else -1,
            1 if near < 0.02 else 0 if near < 0.25 else -1,
            1 if a and a[-3:] in (q[-3:], more[-3:]) else -1,
        )

    def refused(self, low: str, a: list[str], parts: list[str]) -> tuple[int, ...]:
        """It says no; it speaks of asking or helping; it is short; the machine; it quotes or writes to someone."""
        no, asking, short, quotes = _refusal_signs(low, _unquoted(low), len(parts))
        chance = self.refusals.refusal(a)
        return no, asking, short, 1 if chance > SAID else -1 if chance < UNSAID else 0, quotes

    def truncated(self, text: str, finished: list[str], open_: str | None) -> tuple[tuple[int, ...], str | None]:
        """The machine for ends; an open code block or item; a sign that goes on. The last word follows if it is open."""
        machine, *signs, words, listed, last = _cut_signs(text, finished, open_)
        if machine is None:
            p = self.ends.end(words, listed)
            machine = 1 if p < CUT else -1 if p > END else 0
        return (machine, *signs), last

    def asked_languages(self, asked: str, questions: list[str]) -> tuple[frozenset, ...]:
        """Of an instruction: the languages that the machines see, those that it asks for, its scripts and
        the languages by function words and by letters."""
        by, wanted = [family(p) for p in questions], _wanted(asked)
        own = frozenset(_one(x) for x in self.machines.languages(questions, by))
        return own, wanted, frozenset(x[0] for x in by) - {None}, frozenset(map(_common, questions)) - {None}, frozenset(_lettered(*x) for x in by) - {None}

    def said_languages(self, parts: list[str]) -> tuple[frozenset, ...] | None:
        """Of an output: the same without those asked for; none if it is very short."""
        if sum(p.count(" ") + 1 for p in parts) < 4:
            return None
        by = [family(p) for p in parts]
        said = frozenset(_one(x) for x in self.machines.languages(parts, by))
        return said, frozenset(x[0] for x in by) - {None}, frozenset(map(_common, parts)) - {None}, frozenset(_lettered(*x) for x in by) - {None}

    @staticmethod
    def language(asked: tuple[frozenset, ...], answer: tuple[frozenset, ...] | None) -> tuple[int, ...]:
        """The machines for languages; the scripts; the function words; the letters. Both scripts of
        Urdu are one language, and a language that was asked for is no other one."""
        if answer is None:
            return (-1, 0, 0, 0)
        (own, wanted, f_in, c_in, l_in), (said, f_out, c_out, l_out) = asked, answer
        return (
            0 if not said or not own else -1 if said & (own | wanted) else 1,
            0 if not f_out or not f_in or f_out & f_in or "Devanagari" not in f_out | f_in else -1 if "hindi" in wanted or wanted and "Devanagari" in f_in else 1,
            0 if not c_out or not c_in else -1 if c_out & (c_in | wanted) else 1,
            0 if not l_out or not l_in else -1 if l_out & l_in or wanted & {x for y in l_out for x in y.split(" or ")} else 1,
        )


def _wanted(asked: str) -> frozenset:
    """The languages that an instruction asks for."""
    return frozenset(k for k, stems in _ASKED_STEMS.items() if any(x in asked for x in stems) and _ASKED[k].search(asked))


def _unquoted(low: str) -> str:
    """A text without what it quotes, which isn't said."""
    return _QUOTES.sub(" ", low) if any(x in low for x in "'\"“«‘") else low


def _says_no(low: str) -> bool:
    return any(x in low for x in _STEMS) and _PREDICATE.search(low) is not None


def _of_asking(low: str) -> bool:
    return any(x in low for x in _OBJECTS) or _AI.search(low) is not None


def _refusal_signs(whole: str, low: str, parts: int) -> tuple[int, int, int, int]:
    """It says no; it speaks of asking or helping; it is short; it quotes or writes to someone."""
    return 1 if _says_no(low) else -1, 1 if _of_asking(low) else -1, 1 if parts <= 2 else 0 if parts <= 4 else -1, -1 if _quotes(whole) else 0


def _quotes(low: str) -> bool:
    return any(x in low for x in _QUOTED_PARTS) and _QUOTED.search(low) is not None


def _cut_signs(text: str, finished: list[str], open_: str | None) -> tuple[int | None, int, int, list[str], bool, str | None]:
    """The vote of the machine for ends if it needs none, else None; of an open code block or item; of a sign
    that goes on; the words of the last unit and whether it is a list item; the last word if it is open."""
    words, listed = _tokens(open_ if open_ is not None else finished[-1] if finished else "")
    fences, last = text.count("```"), text[-1:]
    stopped, dots = _ended(text)
    closed = bool(fences and not fences % 2 and text.endswith("```") or last and not (last.isalpha() or last in _STOPS) and (_AFTER.search(text) or _ASIDE.search(text)))
    bare = last in _BARE_ENDS and _BARE.fullmatch(text[text.rfind("\n") + 1 :]) is not None
    tiny = not finished and len(words) <= 2 or not words  # a word or two are an answer, or end nowhere
    machine = 0 if tiny or bare or fences % 2 else -1 if closed else None
    shut = -1 if (stopped and not dots or closed) and not bare else 0
    block = 1 if fences % 2 or text.endswith(("\n`", "\n``")) or bare else shut
    return machine, block, 1 if last and last in _GOING_ON and not tiny and not closed else shut, words, listed, words[-1] if open_ is not None and not tiny and not closed else None


def _text(output: str | None) -> str:
    """An output in consistent lines without characters that show nothing."""
    return lines((output or "") if (output or "").isascii() else _HIDDEN.sub("", output or ""))


def _answer_words(flat: str) -> tuple[str, list[str]]:
    low = flat.lower()
    return low, _WORDS.findall(_MARK.sub(" ", low) if "<|" in low else low)


def _one(language: str) -> str:
    return "urdu" if language in ("urdu_script", "roman_urdu") else language


def _common(sentence: str) -> str | None:
    """The language with most function words."""
    counts: dict[str, int] = {}
    for w in sentence.lower().split():
        for k in _LANGUAGES_OF.get(w, ()):
            counts[k] = counts.get(k, 0) + 1
    return _one(max(counts, key=counts.__getitem__)) if counts else None


def _lettered(script: str | None, share: float, words: list[str]) -> str | None:
    """What the letters of a sentence alone say: Urdu by letters or, in Latin script, by words that end in vowels."""
    if script is None or share < 0.6 or len(words) < 4:
        return None
    if script == "Devanagari":
        return "hindi"
    if script == "Arabic":
        text = "".join(words)
        n = sum(map(text.count, URDU_LETTERS)) / len(text)
        return "urdu" if n > 0.06 else "arabic or persian" if n < 0.02 else None
    vowels = sum(w[-1] in "aeiouAEIOU" for w in words) / len(words)
    return "urdu" if vowels > 0.5 else "english" if vowels < 0.4 else None


def _code(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def _sampled(train: DataFrame) -> list:
    """A bounded sample for machines that are fitted in memory: at most SAMPLE_ROWS rows of each
    language that a label names and as many as that of those without. No query uses it."""
    labelled = train.select(F.coalesce(label_language(), F.lit("none")).alias("label"), "instruction", "input", "output", "row_id")
    return bounded_sample(labelled.where("instruction is not null and length(output) > 20"), SAMPLE_ROWS, 0, "row_id", "label")


#: What texts are told apart by before a phrase is searched: of each phrase the longest run of letters, which is within a word.
def _runs(*phrases: str) -> tuple[str, ...]:
    return tuple(sorted({max(_WORDS.findall(p), key=len) for p in phrases}))


_NO_RUNS, _ASKING_RUNS = _runs(*_STEMS), _runs(*_OBJECTS, "ai")
_QUOTED_RUNS = _runs(*_QUOTED_PARTS)
_COMMON = {w: tuple(map(list(FUNCTION_WORDS).index, v)) for w, v in _LANGUAGES_OF.items()}
_SCRIPTS, _COMMON_NAMES, _LETTERED = tuple(FAMILIES), tuple(map(_one, FUNCTION_WORDS)), ("hindi", "urdu", "english", "arabic or persian")
_SPOKEN = tuple(map(_one, LANGUAGES))


#: Stands between the units of a text among its words.
_BREAK = "\uffff\ufffe\uffff"


class _Pieces(dict):
    """The numbers of the words that a token of a unit holds, spelt as _tokens does."""

    def __init__(self, words: blocks.Numbered):
        self.words = words
        self[_BREAK] = (-1,)

    def __missing__(self, token: str) -> tuple[int, ...]:
        got = self[token] = tuple(map(self.words.__getitem__, _STRIPPED.sub(" ", _NUMBER.sub("0", token)).split()))
        return got


class Block:
    """What the texts of some rows show before the machines are fitted."""

    def __init__(self):
        self.n, self.units = 0, 0
        self.ids, self.fitted, self.wanted, self.codes = [], [], [], []
        self.lows, self.parts, self.answers, self.answer_length = [], [], [], []
        self.words, self.tokens, self.pieces = blocks.Numbered(), blocks.Numbered(), blocks.Numbered()
        self.pieces_of = _Pieces(self.pieces)
        self.sentences, self.sentence_length, self.per_text, self.label, self.fold = [], [], [], [], []
        self.unit_words, self.unit_listed, self.per_unit = [], [], []  # of each text: its units, those that are counted, whether the pair is fitted on, the seed
        self.ends: list[tuple[list[str], bool]] = []
        self.cut: list[tuple] = []  # base, word and row of ends of each row
        self.planted: Counter = Counter()
        self.planted_cuts: list[tuple] = []

    def add(self, i: int | None, label: str | None, instruction: str, given: str | None, output: str | None) -> None:
        text = _text(output)
        flat, parts = " ".join(text.split()), sentences(text, True)
        asked = consistent(instruction).lower()
        low, a = _answer_words(flat)
        fitted = len(output or "") > 20
        self.ids.append(i)
        self.fitted.append(fitted)
        self.lows.append(low)
        self.parts.append(len(parts))
        self.answers += map(self.words.__getitem__, a)
        self.answer_length.append(len(a))
        known = LANGUAGES.index(label) if fitted and label in LANGUAGES else -1
        self._sentences(sentences(instruction), -1)
        self._sentences(parts, known)
        units, stopped, dots = _divided(text)
        finished, open_ = (units[:-1], units[-1]) if units and (dots or not stopped) else (units, None)
        self._units(units if stopped else finished, len(finished), text if fitted else None, i is not None)
        q, more = _WORDS.findall(asked), _WORDS.findall(consistent(given).lower()) if given and given.strip() else []
        self.codes.append((_code(Votes.empty(flat, q, a)), _code(Votes.copied(q, more, a))))
        self.wanted.append(sum(1 << list(ASKED).index(k) for k in _wanted(asked)))
        self.cut.append(self._cut(text.rstrip(), finished, open_))
        if i is not None:
            seed = zlib.crc32(b"%d" % i)
            defect = PLANTED[seed % len(PLANTED)]
            if made := _damaged(defect, instruction, given, output, random.Random(seed)):
                text = _text(made[0])
                if defect == "truncated_answer":
                    self.planted_cuts.append(self._cut(text.rstrip(), *_unfinished(text)))
                else:
                    flat = " ".join(text.split())
                    a = _answer_words(flat)[1]
                    self.planted[defect, _code(Votes.empty(flat, q, a) if defect == "empty_answer" else Votes.copied(q, more, a))] += 1
        self.n += 1

    def _sentences(self, parts: list[str], label: int) -> None:
        self.sentences += map(self.tokens.__getitem__, " ".join(parts).split())
        self.sentence_length += [s.count(" ") + 1 for s in parts]
        self.per_text.append(len(parts))
        self.label.append(label)
        if label >= 0:
            self.fold += [blocks.crc(s) % 5 for s in parts]

    def _units(self, units: list[str], counted: int, fitted: str | None, pair: bool) -> None:
        if not units:
            return
        listed = [not u[0].isalpha() and _LISTED.match(u) is not None for u in units]
        self.unit_listed += listed
        whole = f" {_BREAK} ".join(u if u[0].isalpha() else _ITEM.sub("", u) for u in (units if _BREAK not in "".join(units) else [u.replace(_BREAK, " ") for u in units]))
        self.unit_words += chain.from_iterable(map(self.pieces_of.__getitem__, whole.split()))
        self.unit_words += self.pieces_of[_BREAK]
        self.units += len(units) * (fitted is not None)
        self.per_unit.append((len(units), counted if pair else 0, fitted is not None, random.Random(blocks.crc(fitted)).getrandbits(40) if fitted is not None else 0))

    def _cut(self, text: str, finished: list[str], open_: str | None) -> tuple[int, str | None, int]:
        """The vote pattern without the machine, the last word if it is open, and the row that the machine is asked for."""
        machine, *signs, words, listed, last = _cut_signs(text, finished, open_)
        if machine is None:
            self.ends.append((words, listed))
        return _code((-1 if machine is None else machine, *signs)), last, -1 if machine is not None else len(self.ends) - 1

    def closed(self) -> pa.RecordBatch:
        """Row-wise signs; rows of the machines for ends and refusals; labelled sentences."""
        whole = lambda x: np.array(x, dtype=np.int64)
        fitted, lengths = np.array(self.fitted, dtype=bool), whole(self.answer_length)
        # refusals
        answers, of_text = whole(self.answers), np.repeat(np.arange(self.n), lengths)
        shown = np.zeros((self.n, 3), dtype=bool)
        for k, runs in enumerate((_NO_RUNS, _ASKING_RUNS, _QUOTED_RUNS)):
            shown[of_text[blocks.holding(self.words, runs)[answers]], k] = True
        hashes, skipped = np.array([blocks.crc(w) for w in self.words], dtype=np.uint64), np.array([w in _PHRASED for w in self.words], dtype=bool)
        frames = blocks.least(of_text, answers, hashes, skipped, self.n, FRAMES, END_FEATURES)
        unquoted, said, refusal = frames.copy(), np.zeros(self.n, dtype=np.int8), []
        for k, (low, parts, (no, asking, quotes)) in enumerate(zip(self.lows, self.parts, shown.tolist())):
            marked, own = "<|" in low, _unquoted(low)
            signs = 1 if (no or marked) and _says_no(own) else -1, 1 if (asking or marked) and _of_asking(own) else -1, 1 if parts <= 2 else 0 if parts <= 4 else -1
            refusal.append(_code((*signs, -1, -1 if (quotes or marked) and _quotes(low) else 0)))
            if marked or own is not low:
                unquoted[:, k] = _frames(_WORDS.findall(own))
            said[k] = signs == (1, 1, 1)
        # words and ends of units
        pieces, listed = whole(self.unit_words), np.array(self.unit_listed, dtype=bool)
        ends_at = np.flatnonzero(pieces < 0)
        per, pieces = np.diff(ends_at, prepend=-1) - 1, pieces[pieces >= 0]
        n_units, n_counted, fit, seed = np.array(self.per_unit or np.zeros((0, 4)), dtype=np.int64).T
        place = np.arange(len(per)) - np.repeat(blocks.starts(n_units), n_units)
        counted, fit, seeds = place < np.repeat(n_counted, n_units), np.repeat(fit, n_units) > 0, blocks.seeds(seed.astype(np.uint64), n_units)
        n = np.bincount(pieces[np.repeat(counted, per)], minlength=len(self.pieces))
        last = np.bincount(pieces[(blocks.starts(per) + per - 1)[counted & (per > 0)]], minlength=len(self.pieces))
        words = [(w, a, b) for w, a, b in zip(self.pieces, n.tolist(), last.tolist()) if a]
        rows = blocks.end_rows(self.pieces, pieces[np.repeat(fit, per)], per[fit], listed[fit], seeds[fit])
        asked_of = blocks.Numbered()
        three = whole([[-1, -1, -1, *(asked_of[w] for w in x[-3:])][-3:] for x, _ in self.ends]).reshape(-1, 3)
        ends = blocks.Endings(asked_of).features(*three.T, whole([len(x) for x, _ in self.ends]), np.array([x for _, x in self.ends], dtype=bool))
        # languages
        s = blocks.Sentences(self.tokens, whole(self.sentences), whole(self.sentence_length), _COMMON, URDU_LETTERS)
        owner, features = np.repeat(np.arange(2 * self.n), self.per_text), s.features()
        label, fold = np.repeat(self.label, self.per_text), np.zeros(s.n, dtype=np.int8)
        fold[label >= 0] = self.fold
        sides = [blocks.bits(owner, x, 2 * self.n, width) for x, width in ((s.family, len(_SCRIPTS)), (s.common, len(_COMMON_NAMES)), (s.lettered, len(_LETTERED)))]
        tokens = np.bincount(owner, self.sentence_length, 2 * self.n)[1::2]
        rowwise = {
            "ids": self.ids, "codes": np.array(self.codes, dtype=np.uint8), "refusal": np.array(refusal, dtype=np.int16), "frames": frames, "cut": self.cut, "ends": ends, "words": words,
            "planted": dict(self.planted), "planted_cuts": self.planted_cuts, "wanted": np.array(self.wanted, dtype=np.int8), "sides": [x.astype(np.int16) for x in sides], "short": tokens < 4,
            "said": (features, s.family.astype(np.int8), s.share.astype(np.float32), *map(blocks.small, (s.most, s.ids, np.array(self.per_text)))),
        }
        learnt = rows, blocks.grouped(unquoted[:, fitted], said[fitted])
        blobs = pickle.dumps(rowwise), pickle.dumps(learnt), pickle.dumps(s.labelled(label, fold, features))
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=list(_BLOBS))


_BLOBS = ("pairs", "texts", "sentences")


def _encoded(train: DataFrame) -> DataFrame:
    """Blocks of all pairs: what each shows before the machines are fitted, and what these are fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                block.add(*row)
                if 5 * block.units > BLOCK_ROWS or block.n >= BLOCK_ROWS // 10:
                    yield block.closed()
                    block = Block()
        if block.n:
            yield block.closed()

    label = label_language() if "lang" in train.columns else F.lit(None).cast("string")  # votes need no labels
    rows = spread(train.select(F.col("row_id").cast("long"), label.alias("label"), "instruction", "input", "output").where("instruction is not null and (row_id is not null or length(output) > 20)"))
    return rows.mapInArrow(run, ", ".join(f"{x} binary" for x in _BLOBS))


def fit_votes(rows: DataFrame | list) -> Votes:
    """Machines fitted on all rows of a table or of its blocks, or in memory on a list of rows as _sampled gives it."""
    if isinstance(rows, DataFrame):
        read = rows if "sentences" in rows.columns else materialize(_encoded(rows))
        texts, said = descent.stored(read, "texts"), descent.stored(read, "sentences")
        ends, refusals = descent.fit_logistic(texts, (END_WIDTH, FRAMES), END_FEATURES, (1, SEEDS))
        texts.unpersist()
        machines = descent.fit_languages(said)
        said.unpersist()
        return Votes(machines, Ends(*ends), Refusals(*refusals))
    outputs = [r["output"] for r in rows][:SAMPLED_ROWS]
    return Votes(fit([(r["label"], r["output"]) for r in rows if r["label"] in LANGUAGES]), fit_ends(outputs), fit_refusals(outputs))


_COLUMNS = ("row_id", *DEFECTS, "word", "n", "n_ends", "planted", "code")
_TYPES = (pa.int64(), *[pa.int32()] * len(DEFECTS), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
#: Defects of which each pair gets one made; refusals are fixed sentences, and all outputs meet all instructions for other languages.
PLANTED = ("empty_answer", "copied_question", "truncated_answer")


def _chances(machine: Linear, at: np.ndarray) -> np.ndarray:
    """Linear.chance of many rows of features, a row of `at` for each place."""
    z = np.full(at.shape[1], machine.bias)
    for column in at:
        z += machine.weights[column]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _names(bits: int, names: tuple[str, ...]) -> frozenset:
    return frozenset(x for k, x in enumerate(names) if bits >> k & 1)


def _decided(pairs: dict, vote: Votes) -> list[tuple]:
    """The rows of _passed for a block."""
    n, none = len(pairs["ids"]), [None] * (1 + len(DEFECTS))
    real = np.array([i is not None for i in pairs["ids"]], dtype=bool)
    chance = _chances(vote.refusals, pairs["frames"])
    refusal = pairs["refusal"] + 3 * (1 + np.where(chance > SAID, 1, np.where(chance < UNSAID, -1, 0)))
    p = _chances(vote.ends, pairs["ends"])
    machine = np.where(p < CUT, 2, np.where(p > END, 0, 1)).tolist()
    cut = lambda base, at: base + 9 * machine[at] if at >= 0 else base
    features, family_, share, *others = pairs["said"]
    most, ids, per_text = (x.astype(np.int64) for x in others)
    spoken = blocks.spoken(vote.machines, features, family_, share.astype(np.float64), most, ids, np.repeat(np.arange(2 * n), per_text), 2 * n) @ (1 << np.arange(len(LANGUAGES)))
    key = spoken
    for x, width in zip(pairs["sides"], (len(_SCRIPTS), len(_COMMON_NAMES), len(_LETTERED))):
        key = key << width | x
    asked_key, said_key = key[::2] << len(ASKED) | pairs["wanted"], np.where(pairs["short"], -1, key[1::2])

    def sides(x: int) -> list[frozenset]:
        out = []
        for names in (_LETTERED, _COMMON_NAMES, _SCRIPTS, _SPOKEN):
            out.append(_names(x & (1 << len(names)) - 1, names))
            x >>= len(names)
        return out[::-1]

    asked, said, planted = {}, {-1: None}, Counter()
    for x in set(asked_key.tolist()):
        own, *rest = sides(x >> len(ASKED))
        asked[x] = (own, _names(x & (1 << len(ASKED)) - 1, tuple(ASKED)), *rest)
    for x in {*said_key.tolist()} - {-1}:
        said[x] = tuple(sides(x))
    both = list(zip(asked_key.tolist(), said_key.tolist()))
    language = {x: _code(Votes.language(asked[x[0]], said[x[1]])) for x in set(both)}
    rows = [(i, e, c, r, cut(base, at), language[x], word, None, None, None, None) for i, (e, c), r, (base, word, at), x in zip(pairs["ids"], pairs["codes"].tolist(), refusal.tolist(), pairs["cut"], both) if i is not None]
    rows += [(*none, w, k, at_end, None, None) for w, k, at_end in pairs["words"]]
    rows += [(*none, None, k, None, defect, code) for (defect, code), k in pairs["planted"].items()]
    for base, word, at in pairs["planted_cuts"]:
        planted["truncated_answer", word, cut(base, at)] += 1
    for kind, keys, of in (("asked", asked_key, asked), ("said", said_key, said)):
        for x, k in Counter(keys[real].tolist()).items():
            planted[kind, json.dumps(of[x] and [sorted(y) for y in of[x]]), None] += k
    return rows + [(*none, word, k, None, kind, code) for (kind, word, code), k in planted.items()]


def _passed(train: DataFrame, vote: Votes) -> DataFrame:
    """From the texts, or from blocks of them, a row for each pair with its votes as numbers in
    base 3 and its open last word; rows without row_id that count the words of a block's finished
    units; and rows that count, by `planted`, the votes on simulated defects and the languages of
    instructions ("asked") and of outputs ("said")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                cols = list(zip(*_decided(pickle.loads(blob.as_buffer()), vote))) or [()] * len(_COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=list(_COLUMNS))

    read = train if "sentences" in train.columns else _encoded(train)
    return read.select("pairs").mapInArrow(run, "row_id long, " + ", ".join(f"{d} int" for d in DEFECTS) + ", word string, n long, n_ends long, planted string, code int")


def _by_counts(n, n_ends, begun):
    """Votes of the counts of a last word, as columns: broken if it is unknown and begins
    known ones; by habit if it seldom or often ends a unit."""
    broken = F.when((n < KNOWN) & (begun >= KNOWN), 1).otherwise(0)
    habit = F.when(n < HABIT, 0).when(n_ends < 0.02 * n, 1).when(n_ends > 0.3 * n, -1).otherwise(0)
    return broken, habit


def last_words(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """word, broken, habit of the asked words from the counts of all finished words. Known
    words are cut only to the lengths that are asked for, so long ones need no limit."""
    asked = asked.distinct()
    n = asked.join(counts, "word", "left")
    lengths = asked.agg(F.collect_set(F.length("word")).alias("lengths"))
    begun = counts.where(F.col("n") >= KNOWN).crossJoin(F.broadcast(lengths)).select(F.explode(F.expr("transform(filter(lengths, k -> k < length(word)), k -> left(word, k))")).alias("word"), F.col("n").alias("m"))
    both = n.join(begun.groupBy("word").agg(F.sum("m").alias("begun")), "word", "left")
    broken, habit = _by_counts(F.coalesce("n", F.lit(0)), F.coalesce("n_ends", F.lit(0)), F.coalesce("begun", F.lit(0)))
    return both.select("word", broken.alias("broken"), habit.alias("habit"))


def _looked_up(passed: DataFrame) -> DataFrame:
    """The votes of the counts of all outputs on the last words of pairs and of simulated cuts."""
    asked = passed.where("word is not null and (row_id is not null or planted = 'truncated_answer')").select("word")
    counts = passed.where("row_id is null and planted is null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"))
    return last_words(asked, counts)


def _with_words(rows: DataFrame, code: str, looked_up: DataFrame) -> DataFrame:
    """rows whose votes on truncated answers are followed by those of the last word."""
    whole = F.when(F.col(code) % 3 == 0, -1).otherwise(0)  # a word that a stop follows
    joined = lambda broken, habit: (F.col(code) * 9 + (broken + 1) * 3 + habit + 1).cast("int")
    closed = rows.where("word is null").withColumn(code, joined(whole, F.lit(0)))
    open_ = rows.where("word is not null").join(looked_up, "word").withColumn(code, joined(F.col("broken"), F.col("habit")))
    return closed.unionByName(open_.select(rows.columns))


def votes(train: DataFrame, vote: Votes | None = None) -> DataFrame:
    """row_id and for each defect the votes of its functions, as a number in base 3.
    Null instructions are no case and have no row. Last words meet the counts of all
    outputs after the votes, so no text is shuffled for them."""
    read = materialize(_encoded(train))
    passed = materialize(_passed(read, vote or fit_votes(read)))
    return _votes(passed, _looked_up(passed))


def _votes(passed: DataFrame, looked_up: DataFrame) -> DataFrame:
    return _with_words(passed.where("row_id is not null").select("row_id", *DEFECTS, "word"), "truncated_answer", looked_up).select("row_id", *DEFECTS)


class LabelModel:
    """Two classes, votes independent given the class; fitted by expectation maximization.

    A function that doesn't vote says nothing, so the chances are those of its votes. One
    that only ever votes against the defect can't be weighed by its votes and keeps the
    chances assumed before."""

    #: Chances of the votes -1, 0, 1 before any are seen, without and with the defect, and how many pairs they weigh.
    BEFORE, WEIGHT = np.array([[0.95, 1.0, 0.05], [0.10, 1.0, 0.90]]), 20.0
    #: The share of defective pairs before any are seen, and how many pairs it weighs.
    RARE, PAIRS = 0.02, 200.0

    def __init__(self, functions: int):
        self.prior, self.chance = self.RARE, np.tile(self.BEFORE, (functions, 1, 1))  # function, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        k = np.arange(patterns.shape[1])
        log = [np.log(self.chance[k, c, patterns]).sum(1) + np.log((1 - self.prior, self.prior)[c]) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        weighed = [f for f in range(patterns.shape[1]) if counts[patterns[:, f] == 2].sum() > 0]
        for _ in range(rounds):
            p = self.posterior(patterns)
            self.prior = float(np.clip(((counts * p).sum() + self.RARE * self.PAIRS) / (counts.sum() + self.PAIRS), 1e-5, 0.5))
            for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
                for f in weighed:
                    against, _, for_ = np.bincount(patterns[:, f], weight, 3)
                    self.chance[f, c, [0, 2]] = (np.array([against, for_]) + self.WEIGHT * self.BEFORE[c, [0, 2]]) / (against + for_ + self.WEIGHT)
        return self


def cutoff(posterior: np.ndarray, counts: np.ndarray, planted: np.ndarray, times: np.ndarray | None = None, held: np.ndarray | None = None) -> tuple[float, float]:
    """The cutoff with the best F1, and the share of planted defects that it finds. What a
    cutoff finds is measured on the planted ones, each so many times; what it takes wrongly is
    expected by the posteriors of the counted patterns, those of models that haven't seen the pairs if given."""
    best, at, found = -1.0, 0.5, 0.0
    times, held = np.ones(len(planted)) if times is None else times, posterior if held is None else held
    whole = (counts * held).sum()
    for c in sorted({0.5, *np.clip(posterior[posterior >= 0.3], 0.3, 0.99).tolist()}):
        taken = posterior >= c
        recall = float((times * (planted >= c)).sum() / times.sum()) if len(planted) else (counts * held)[taken].sum() / max(1e-9, whole)
        wrong = (counts * (1 - held))[taken].sum()
        f1 = 2 * recall * whole / max(1e-9, recall * whole + wrong + whole)
        if f1 > best + 1e-12:
            best, at, found = f1, c, recall
    return at, found


def _damaged(defect: str, q: str, g: str | None, a: str | None, rng: random.Random) -> tuple[str | None] | None:
    """The output that a pair has with a defect; None if it can't be made of this one."""
    head = rng.choice(HEADINGS).capitalize()
    if defect == "empty_answer":
        return (rng.choice((None, "", "  ", "N/A", "none", "---", "...", f"{head}:", f"## {head}", "<|im_end|>")),)
    if defect == "copied_question":
        return (rng.choice((q, f'"{q}"', f"{head}: {q}", f"{q}\n{q}", f"{q}\n\n{g}" if g and g.strip() else f"{q} ?")),)
    if defect == "refusal":
        return (rng.choice(SIMULATED_REFUSALS),)
    if a and len(a) > 40 and len(a.rstrip()) - 2 > len(a) // 3 and _STOP.search(a.rstrip()) and "```" not in a:
        return (a[: rng.randrange(len(a) // 3, len(a.rstrip()) - 2)],)
    return None


def simulated(sample: list, machines: Machines, seed: int = 11) -> list[tuple[str, str, str | None, str | None]]:
    """(defect, instruction, input, output): every defect in turn made from pairs in memory. The
    queries make them of all pairs, where these lie."""
    rng = random.Random(seed)
    spoken = [(r, {_one(x) for x in machines.languages(sentences(r["output"]))}) for r in sample]
    out: list[tuple[str, str, str | None, str | None]] = []
    for k, (r, _) in enumerate(spoken):
        q, g, defect = r["instruction"], r["input"], DEFECTS[k % 5]
        if defect == "other_language":
            own, (other, said) = {_one(x) for x in machines.languages(sentences(q))}, rng.choice(spoken)
            if own and len(said) == 1 and not said & own and not any(p.search(consistent(q).lower()) for p in _ASKED.values()):
                out.append((defect, q, g, other["output"]))
        elif made := _damaged(defect, q, g, r["output"], rng):
            out.append((defect, q, g, *made))
    return out


def _planted_codes(passed: DataFrame, looked_up: DataFrame, vote: Votes) -> dict[str, Counter]:
    """How many simulated defects have each vote pattern. Every output of one language answers
    every instruction in others that asks for none, by the counts of the languages of both."""
    rows = passed.where(F.col("planted").isin(*PLANTED)).select("planted", "code", "word", "n")
    cut = _with_words(rows.where("planted = 'truncated_answer'"), "code", looked_up)
    out = {d: Counter() for d in DEFECTS}
    for r in rows.where("planted <> 'truncated_answer'").unionByName(cut).groupBy("planted", "code").agg(F.sum("n").alias("n")).collect():  # at most 3 x 243 rows
        out[r["planted"]][r["code"]] += r["n"]
    for text in SIMULATED_REFUSALS:
        out["refusal"][_code(vote.planted("refusal", ([], [], ()), text)[0])] += 1
    sides: dict[str, list] = {"asked": [], "said": []}
    for r in passed.where("planted in ('asked', 'said')").groupBy("planted", "word").agg(F.sum("n").alias("n")).collect():  # sets of a few languages and scripts
        side = json.loads(r["word"])
        if side is not None:
            sides[r["planted"]].append((tuple(map(frozenset, side)), r["n"]))
    answers = [(x, n) for x, n in sides["said"] if len(x[0]) == 1]
    for asked, n in sides["asked"]:
        if asked[0] and not asked[1]:
            for answer, m in answers:
                if not answer[0] & asked[0]:
                    out["other_language"][_code(Votes.language(asked, answer))] += n * m
    return out


def _judged(train: DataFrame) -> tuple[DataFrame, list[tuple], list[tuple]]:
    """row_id, defect, code of all pairs; (defect, code, posterior) of the patterns that are
    taken; and a row for each labelling function."""
    read = materialize(_encoded(train))
    vote = fit_votes(read)
    passed = materialize(_passed(read, vote))
    looked_up = materialize(_looked_up(passed))
    v = materialize(_votes(passed, looked_up))
    half = F.pmod(F.xxhash64("row_id"), F.lit(2)).alias("half")
    stacked = v.select("row_id", half, F.expr("stack({}, {}) as (defect, code)".format(len(DEFECTS), ", ".join(f"'{d}', {d}" for d in DEFECTS))))
    counted = stacked.groupBy("half", "defect", "code").count().collect()  # at most 2 x 5 x 243 rows
    planted = _planted_codes(passed, looked_up, vote) if counted else {}
    taken, functions = [], []
    for d in DEFECTS:
        codes = np.array(sorted({r["code"] for r in counted if r["defect"] == d}), dtype=np.int64)
        if not len(codes):
            continue
        k = len(FUNCTIONS[d])
        apart = lambda x, k=k: np.stack([x // 3 ** (k - 1 - i) % 3 for i in range(k)], 1)
        patterns, counts = apart(codes), np.zeros((2, len(codes)))
        for r in counted:
            if r["defect"] == d:
                counts[r["half"], np.searchsorted(codes, r["code"])] += r["count"]
        n = counts.sum(0)
        model = LabelModel(k).fit(patterns, n)
        p = model.posterior(patterns)
        unseen = [LabelModel(k).fit(patterns, counts[h]).posterior(patterns) * counts[1 - h] for h in (0, 1)]
        own, times = np.array(sorted(planted[d]), dtype=np.int64), np.array([planted[d][x] for x in sorted(planted[d])], dtype=float)
        c, recall = cutoff(p, n, model.posterior(apart(own)) if len(own) else np.zeros(0), times, sum(unseen) / n)
        taken += [(d, int(x), float(y)) for x, y in zip(codes, p) if y >= c]
        for f, name in enumerate(FUNCTIONS[d]):
            yes = patterns[:, f] == 2
            functions.append((d, name, int(n.sum()), int(n[patterns[:, f] != 1].sum()), int(n[yes].sum()), int(n[yes != (p >= c)].sum()), float(model.chance[f, 1, 2]), float(model.chance[f, 0, 0]), float(c), recall))
    return stacked, taken, functions


def labelled(train: DataFrame) -> DataFrame:
    """row_id, defect, posterior of every defect that a pair shows; several may hold."""
    stacked, taken, _ = _judged(train)
    table = train.sparkSession.createDataFrame(taken, "defect string, code int, posterior double")
    return stacked.join(F.broadcast(table), ["defect", "code"]).select("row_id", "defect", "posterior").distinct()


def labelling_functions(train: DataFrame) -> DataFrame:
    """One row for each labelling function: the pairs it saw, on how many it voted, on how
    many for the defect, on how many that differs from the model, its estimated chance
    to vote for the defect where it is and against it where it isn't, the cutoff of the
    defect and the share of simulated ones that it finds."""
    schema = "defect string, function string, n_pairs long, n_voted long, n_for long, n_unlike_model long, hit_chance double, reject_chance double, cutoff double, found_share double"
    return train.sparkSession.createDataFrame(_judged(train)[2], schema)


def defective(train: DataFrame) -> DataFrame:
    """row_id and the first defect of each defective pair in the order of DEFECTS."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return labelled(train).groupBy("row_id").agg(F.min_by("defect", order).alias("defect"))
