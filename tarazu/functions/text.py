"""Column functions on text. All stay inside the JVM's generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python strips it; Arabic-script ranges; ASCII letters; the chat template's marks.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ARABIC_SCRIPT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
ASCII_LETTERS = "[a-zA-Z]"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, Unicode's and the control separators included.
    Trimming looks at the ends only; a pattern would look at every blank."""
    return F.btrim(_col(c), F.lit(SPACES))


def clean_whitespace(c: Column | str) -> Column:
    """Runs of blanks and tabs as one blank, three or more line ends as two, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(_col(c), "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"))


def combined_length(*cs: Column | str) -> Column:
    """Code points of all columns together; null counts 0."""
    total = F.lit(0)
    for c in cs:
        total = total + F.length(text_or_empty(c))
    return total


def script_count(c: Column | str, script: str = ARABIC_SCRIPT) -> Column:
    c = _col(c)
    return F.length(c) - F.length(F.regexp_replace(c, f"{script}+", ""))  # a count by matches would make a string of each letter


def script_ratio(c: Column | str, script: str = ARABIC_SCRIPT) -> Column:
    """Letters of the script among those and ASCII letters; 0 without either."""
    n = script_count(c, script)
    return F.coalesce(F.try_divide(n.cast("double"), (n + script_count(c, ASCII_LETTERS)).cast("double")), F.lit(0.0))


def strip_script(c: Column | str, script: str = ARABIC_SCRIPT, most: float = 0.5) -> Column:
    """Without letters of the script, unless they are more than `most` of the letters."""
    c = _col(c)
    return F.when(script_ratio(c, script) > most, c).otherwise(strip(F.regexp_replace(F.regexp_replace(c, script, ""), " +", " ")))


def user_message(instruction: Column | str, given: Column | str) -> Column:
    """The instruction and, after an empty line, the unstripped input if it holds anything."""
    return F.when(strip(text_or_empty(given)) != "", F.concat(_col(instruction), F.lit("\n\n"), _col(given))).otherwise(_col(instruction))


def chat_messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))


def chat_template(messages: Column) -> Column:
    """Messages as one text with a line end after each turn."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(f"{TURN_END}\n"))), "")


def strip_fences(c: Column | str) -> Column:
    """Without the lines that open or close a code fence, if the text begins with one."""
    c = strip(c)
    kept = F.filter(F.split(c, "\n"), lambda line: ~F.startswith(strip(line), F.lit("```")))
    return F.when(F.startswith(c, F.lit("```")), F.array_join(kept, "\n")).otherwise(c)


def outermost(c: Column | str, opening: str, closing: str) -> Column:
    """From the first opening to the last closing mark; null without both in order."""
    c = _col(c)
    start, end = F.instr(c, opening), F.length(c) - F.instr(F.reverse(c), closing) + 1
    return F.when((start > 0) & (F.instr(c, closing) > 0) & (end > start), F.substring(c, start, end - start + 1))


def char_map(c: Column | str, mapping: dict[str, str]) -> Column:
    """Each character by its mapping of any length, others as they are: one-to-one
    mappings in one pass, the rest by replacement. No value may hold a key."""
    if any(k in v for v in mapping.values() for k in mapping):
        raise ValueError("a value of the mapping holds one of its keys")
    one = {k: v for k, v in mapping.items() if len(v) <= 1}
    keep = {k: v for k, v in one.items() if v} | {k: "" for k, v in one.items() if not v}
    old = "".join(sorted(keep, key=lambda k: not keep[k]))  # the deleted ones come last
    out = F.translate(_col(c), old, "".join(keep[k] for k in old))
    for k, v in mapping.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def preview(c: Column | str, n: int, always: bool = False) -> Column:
    """The first n code points and, if more follow (or always), three dots."""
    c = _col(c)
    cut = F.concat(F.substring(c, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(c) > n, cut).otherwise(c)


def percent(ratio: Column) -> Column:
    """A ratio as a whole percentage, halves to even."""
    return F.concat(F.bround(ratio * 100).cast("int").cast("string"), F.lit("%"))


def bar(share: Column) -> Column:
    """One block for every two percent."""
    return F.repeat(F.lit("█"), F.floor(share / 2).cast("int"))


def count_bar(n: Column, whole: Column) -> Column:
    """One block for every fiftieth of the whole; nothing of a whole below 50."""
    return F.repeat(F.lit("█"), F.coalesce(F.floor(F.try_divide(n, F.floor(whole / 50))).cast("int"), F.lit(0)))


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """A number with so many digits after the point, with its sign if signed."""
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", x.cast("double"))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def names_urdu(c: Column | str, variant: str = "a") -> Column:
    """Whether a language name means Urdu. Variants: a, contains "urdu" or is "urd" in any
    case; b, contains "urdu" or "urd" in any case; c, as a, but "urd" in lower case only."""
    c = _col(c)
    low = F.lower(c)
    holds = F.contains(low, F.lit("urdu"))
    return holds | {"a": low == "urd", "b": F.contains(low, F.lit("urd")), "c": c == "urd"}[variant]


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among the columns: presence decides, not nulls."""
    return next((c for c in candidates if c in columns), None)
