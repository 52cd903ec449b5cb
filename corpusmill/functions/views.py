"""Views of a question text: normalised, with its code found, and what is left without code and formulas.

Only the Unicode normal form and the line scan for code need Python: one Arrow crossing for both. All other
views are expressions over their result.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.lexicons import Lexicons

MAX_CHARS = 20000
#: Words that a sentence encoder reads.
PIECES = 256
#: Lines of an indented block of code, at least.
INDENTED = 4
FENCES = ("```", "~~~")
MATH = r"(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$[^$]+\$"
_READ = "raw_text string, code_spans array<string>, code_tiers array<struct<start int, end int, tier string>>"


def normalised(text: str) -> str:
    """NFKC; line ends as LF, three or more as two; no white space at the ends of lines or of the text."""
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(map(str.rstrip, re.sub("\n{3,}", "\n\n", text).split("\n"))).strip()


def code_tiers(rows: list[str], signatures: list[re.Pattern]) -> list[tuple[int, int, str]]:
    """(start, end, tier) of the code among lines, ``end`` exclusive; spans that touch are one, of the first's tier.

    In order of preference at a line: ``fenced``, from an opening fence to the next line with the same fence;
    ``indented``, ``INDENTED`` or more lines with a tab or four spaces, if a signature is found in them;
    ``signature``, a line in which one is found.
    """
    n = len(rows)
    after: dict[str, int] = {}
    closing, indent_end = [n] * n, list(range(n))
    for i in reversed(range(n)):  # what lies below a line is known before the line
        mark = rows[i].strip()[:3]
        if mark in FENCES:
            closing[i] = after.get(mark, n)
            after[mark] = i
        if rows[i].startswith(("    ", "\t")):
            indent_end[i] = indent_end[i + 1] if i + 1 < n and indent_end[i + 1] > i + 1 else i + 1
    found = lambda s: any(p.search(s) for p in signatures)

    def span(i: int) -> tuple[int, str] | None:
        if closing[i] < n:
            return closing[i] + 1, "fenced"
        if indent_end[i] - i >= INDENTED and found("\n".join(rows[i : indent_end[i]])):
            return indent_end[i], "indented"
        return (i + 1, "signature") if found(rows[i]) else None

    out: list[tuple[int, int, str]] = []
    i = 0
    while i < n:
        end, tier = span(i) or (i, "")
        if end > i:
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], end, out[-1][2])
            else:
                out.append((i, end, tier))
        i = max(end, i + 1)
    return out


def code_text(rows: list[str], start: int, end: int, tier: str) -> str:
    """The code of a span: without fences and a blank line after the first, or without indents."""
    own = rows[start:end]
    if tier == "fenced":
        own = own[1:-1]
        own = own[1:] if own and not own[0].strip() else own
    elif tier == "indented":
        own = [x.lstrip(" \t") for x in own]
    return "\n".join(own)


def read_column(text: str | Column, lexicons: Lexicons) -> Column:
    """Struct of the normalised text, its code and where that is; a null text is an empty one."""
    signatures = list(lexicons.code_signatures)

    @F.pandas_udf(_READ)
    def read(texts):
        import pandas as pd

        patterns, out = [re.compile(p) for p in signatures], []
        for t in texts:
            raw = normalised(t or "")
            rows = raw.splitlines()
            tiers = code_tiers(rows, patterns)
            out.append((raw, [code_text(rows, *x) for x in tiers], [dict(zip(("start", "end", "tier"), x, strict=True)) for x in tiers]))
        return pd.DataFrame(out, columns=["raw_text", "code_spans", "code_tiers"])

    return read(F.col(text) if isinstance(text, str) else text)


def with_views(rows: DataFrame, text: str = "question", lexicons: Lexicons | None = None, max_chars: int = MAX_CHARS, abbreviations: list[str] | None = None) -> DataFrame:
    """``rows`` and the struct ``view``: raw_text, code_spans, code_tiers, nl_view, nl_stem, options, option_start,
    option_end, option_lines, sentences, semantic_truncated, oversized, mcq_tier.

    ``nl_view``: each line of code is one space and each formula the word MATHEXPR. Options are looked for in the
    normalised text; ``nl_stem`` is the view without their lines. ``option_lines`` are (first, number) of the options
    of the text as given, which is what the count of sub-questions leaves out. ``oversized``: longer than ``max_chars``;
    such rows keep their views, callers reject them.
    """
    lexicons = lexicons or Lexicons()
    read = rows.withColumn("view", read_column(text, lexicons))
    raw_lines = T.lines(F.col("view.raw_text"))
    covered = lambda i: F.exists("view.code_tiers", lambda s: (s["start"] <= i) & (i < s["end"]))
    masked = F.array_join(F.transform(raw_lines, lambda x, i: F.when(covered(i), F.lit(" ")).otherwise(x)), "\n")
    read = read.withColumn("view", F.struct("view.*", F.regexp_replace(masked, MATH, " MATHEXPR ").alias("nl_view"), T.option_run(raw_lines, lexicons.option_markers).alias("run"), T.option_run(T.lines(F.col(text)), lexicons.option_markers).alias("given")))
    first, n = F.col("view.run.first"), F.size("view.run.options")
    stem = F.array_join(F.filter(T.lines(F.col("view.nl_view")), lambda x, i: ~F.coalesce((i >= first) & (i < first + n), F.lit(False))), "\n")
    view = F.col("view.nl_view")
    return read.withColumn(
        "view",
        F.struct(
            "view.raw_text", "view.code_spans", "view.code_tiers", "view.nl_view", T.strip(F.when(first.isNull(), view).otherwise(stem)).alias("nl_stem"),
            F.col("view.run.options").alias("options"), first.alias("option_start"), (first + n).alias("option_end"),
            F.struct(F.col("view.given.first").alias("first"), F.size("view.given.options").alias("n")).alias("option_lines"),
            T.sentences(view, abbreviations).alias("sentences"), (F.size(F.filter(F.split(view, f"{T.SPACE}+"), lambda w: w != "")) > PIECES).alias("semantic_truncated"),
            (F.length("view.raw_text") > max_chars).alias("oversized"), F.when(first.isNotNull(), "sequential_markers").alias("mcq_tier"),
        ),
    )
