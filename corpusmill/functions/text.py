"""Scalar text functions as column expressions; Python only where SQL has no Unicode form."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.lexicons import ABBREVIATIONS, CONSTRAINTS, NUMBER, OPTION_MARKERS

WORD = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: White space as Python has it; at the ends of a text or alone.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fewest and most options of a question.
OPTIONS = (2, 12)


def normal_form(t: str) -> str:
    """NFKC, white space runs to one space, stripped, casefolded."""
    return " ".join(unicodedata.normalize("NFKC", t).split()).casefold()


@F.pandas_udf(StringType())
def dedup_norm(texts):
    """``normal_form``; null stays null."""
    return texts.map(lambda t: None if t is None else normal_form(t))


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case characters whose case folding is another one character, or is several."""
    one, many = {}, {}
    for c in map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))):
        low, folded = c.lower(), c.casefold()
        if low != folded and len(low) == 1:
            (one if len(folded) == 1 else many)[low] = folded
    return one, many


@functools.cache
def _suspects() -> str:
    """A few ranges of characters that hold all those of ``_folds`` but the sharp s, and some others."""
    ranges: list[list[int]] = []
    for c in sorted(ord(c) for table in _folds() for c in table if c != "ß"):
        if ranges and c < 0x250 and c == ranges[-1][1] + 1 or ranges and c >= 0x250 and c <= ranges[-1][1] + 64:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges) + "]"


def fold(text: Column) -> Column:
    """Case folding: lower case, and what full folding changes beyond it."""
    one, many = _folds()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in many.items()))
    # few texts hold any other such character; only those are gone through
    full = F.aggregate(pairs, F.translate(low, "".join(one), "".join(one.values())), lambda s, p: F.replace(s, p[0], p[1]))
    return F.when(low.rlike(_suspects()), full).otherwise(low)


def words(text: str | Column) -> Column:
    """Word tokens with inner apostrophes; null text has none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def phrase(term: str, gap: str = r"\s+") -> str:
    """Java pattern of a term's words, separated by ``gap``, between non-word characters."""
    return r"(?iU)(?<!\w)" + gap.join(map(re.escape, term.split())) + r"(?!\w)"


def _given(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def distinct_phrases(text: str | Column, terms: list[str]) -> Column:
    """How many of the terms occur; null text has none."""
    return sum((_given(text).rlike(phrase(t)).cast("int") for t in terms), F.lit(0))


def phrase_occurrences(text: str | Column, terms: list[str]) -> Column:
    """How often the terms occur, each by itself; null text has none."""
    return sum((F.regexp_count(_given(text), F.lit(phrase(t))) for t in terms), F.lit(0))


def weighted_phrase_max(text: str | Column, weights: dict[str, int]) -> Column:
    """Largest weight of a term that occurs, its words separated by white space, _ or -; else 0."""
    by_weight: dict[int, list[str]] = {}
    for term, w in weights.items():
        by_weight.setdefault(w, []).append(phrase(term, r"[\s_-]+"))
    hits = F.lit(0)
    for w in sorted(by_weight):  # the largest is asked first
        hits = F.when(_given(text).rlike("|".join(by_weight[w])), w).otherwise(hits)
    return hits


def number(literal: Column) -> Column:
    """Value of a number literal: digit groups, a power, an exponent; null if it is none or not finite."""
    plain = F.regexp_replace(literal, "[,_]", "")
    parts = F.split(plain, r"\^", 2)
    value = F.when(plain.contains("^"), F.pow(parts[0].try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(plain.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def constraint_matches(text: str | Column, patterns: list[str] = CONSTRAINTS) -> Column:
    """What each pattern matches, one after the other; a range with both ends counts under two of them."""
    return F.concat(*(F.regexp_extract_all(_given(text), F.lit(f"(?U){p}"), F.lit(0)) for p in patterns))


def constraint_values(matches: Column) -> Column:
    """The last number of each match, null where it has none."""
    return F.transform(matches, lambda m: number(F.try_element_at(F.regexp_extract_all(m, F.lit(NUMBER), F.lit(0)), F.lit(-1))))


def sentences(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Sentences: every line break ends one, and so does white space after . ! ? and before an upper-case
    letter, a digit, a quote or an opening bracket, unless an abbreviation stands before it. No list of
    abbreviations, or an empty one, means the built-in one."""
    kept = "|".join(map(re.escape, abbreviations or ABBREVIATIONS))
    cut_at = rf"(?U)\n|(?<=[.!?])(?<!(?:^|\s)(?iu:{kept}))[^\S\n]+(?=[\p{{IsUppercase}}\d\"'(\[])"
    parts = F.split(F.coalesce(text, F.lit("")), cut_at)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def lines(text: Column) -> Column:
    """Lines without their ends; null or empty text has none, nor has what follows a last line end."""
    rows = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?:{LINE_END})\z", ""), LINE_END)
    return F.when(F.coalesce(text, F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(rows)


def option_run(rows: Column, markers: list[str] = OPTION_MARKERS) -> Column:
    """(first line, options) of the answer options in an array of lines; no options, no first line.

    The marked lines count from the first one as long as line number and value go up by one together and
    the kind stays: number or letter. A marker that is neither ends them. Fewer than ``OPTIONS[0]`` are none.
    """
    marker = "(?U)(?:" + "|".join(markers) + ")"  # the first alternative that fits, as in a list of patterns

    def read(line: Column, i: Column) -> Column:
        mark = F.regexp_extract(line, marker, 0)
        digits = F.nullif(F.regexp_extract(mark, "[0-9]+", 0), F.lit(""))
        letter = F.nullif(F.regexp_extract(F.lower(mark), rf"([a-z])[.)\]]?{SPACE}*$", 1), F.lit(""))
        value = F.coalesce(digits.try_cast("decimal(38,0)"), F.ascii(letter).cast("decimal(38,0)"))
        rest = strip(F.substring(line, F.length(mark) + 1, F.length(line)))
        return F.struct(i.alias("at"), (mark != "").alias("marked"), digits.isNotNull().alias("numeric"), (value - i).alias("start"), rest.alias("rest"))

    marked = F.filter(F.transform(rows, read), lambda h: h["marked"])

    def chosen(hits: Column) -> Column:
        first = F.get(hits, F.lit(0))
        fits = F.transform(hits, lambda h, p: F.coalesce((h["at"] - p == first["at"]) & (h["numeric"] == first["numeric"]) & (h["start"] == first["start"]), F.lit(False)))
        ends = F.array_position(fits, F.lit(False))
        n = F.least(F.when(ends == 0, F.size(hits)).otherwise(ends - 1), F.lit(OPTIONS[1])).cast("int")
        taken = F.when(n >= OPTIONS[0], F.slice(hits, F.lit(1), n))
        return F.struct(F.get(taken, F.lit(0))["at"].alias("first"), F.coalesce(F.transform(taken, lambda h: h["rest"]), F.expr("cast(array() as array<string>)")).alias("options"))

    # one binding, so that the marked lines are found once
    return F.transform(F.array(marked), chosen)[0]


def options(text: Column) -> Column:
    """Answer options of a text."""
    return option_run(lines(text))["options"]


def enumerated(rows: Column, skip_from: Column | None = None, skip: Column | None = None) -> Column:
    """How many lines of an array stand in runs of two or more enumerators that go up by one from line to line.

    Enumerators are ``(iv)`` up to ten, ``(b)`` and ``3.`` or ``3)``; a roman number of one letter is a letter. ``skip``
    lines from ``skip_from`` on do not count.
    """
    value_of = F.create_map(*chain.from_iterable((F.lit(r), F.lit(v)) for r, v in (("ii", 2), ("iii", 3), ("iv", 4), ("vi", 6), ("vii", 7), ("viii", 8), ("ix", 9))))

    def key(line: Column, i: Column) -> Column:
        """Kind and value less the line's number: equal for the lines of a run."""
        mark = F.lower(F.regexp_extract(line, r"(?iU)^\s*(\([ivxlcdm]+\)|\([a-z]\)|\d+[.)])\s+", 1))
        bare = F.regexp_replace(mark, "[().]", "")
        value = F.when(bare.rlike("^[a-z]$"), F.ascii(bare) - 96).when(bare.rlike(r"^[0-9]{1,18}$"), bare.try_cast("long")).otherwise(F.try_element_at(value_of, bare))
        kind = F.when(bare.rlike("^[0-9]"), "n").when(F.length(bare) == 1, "a").otherwise("r")
        out = F.concat_ws(":", kind, (value.cast("long") - i).cast("string"))
        shown = value.isNotNull() & (mark != "")
        if skip is not None:
            shown &= ~F.coalesce((i >= skip_from) & (i < skip_from + skip), F.lit(False))
        return F.when(shown, out)

    def counted(keys: Column) -> Column:
        beside = lambda k, i: k.isNotNull() & (F.coalesce(F.get(keys, i - 1) == k, F.lit(False)) | F.coalesce(F.get(keys, i + 1) == k, F.lit(False)))
        return F.size(F.filter(keys, beside))

    return F.transform(F.array(F.transform(rows, key)), counted)[0]


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
