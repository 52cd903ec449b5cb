"""The 35 features and five indicators of question views, over whole corpora.

Features of a text alone are expressions over its view, in one stage. Those fitted on training rows (rare words,
TF-IDF) work on one table of (key, token, n), counted once and pre-aggregated; tables fitted from it are joined by token.
Missing numbers are null, never zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.code import complexity_column
from corpusmill.functions.views import with_views
from corpusmill.lexicons import AUXILIARIES, CONCEPTS, INSTRUCTION_TYPES, TECHNICAL, Lexicons
from corpusmill.operators.quantiles import exact_quantiles
from corpusmill.registry import DISABLED, FAMILIES, FEATURES, INDICATORS
from corpusmill.session import cut

RARE_BELOW = 5
#: Terms of the TF-IDF vocabulary: two word characters or more, no apostrophes.
TERM = r"[\p{L}\p{N}_]{2,}"
MOST_TERMS, MIN_DF = 50000, 2
_INTERROGATIVES = "what|why|how|which|when|where"


# --- features of a text alone ---------------------------------------------------------------


def _mean(total: Column, n: Column) -> Column:
    return total / F.greatest(n, F.lit(1))


def lexical_columns(text: Column, n_sentences: Column) -> dict[str, Column]:
    """F01 to F04 of a text: words, words a sentence, letters a word, distinct words (case folded) a word."""
    tokens = T.words(text)
    n = F.size(tokens)
    letters = F.aggregate(tokens, F.lit(0), lambda s, x: s + F.length(x))
    return {"F01": n, "F02": _mean(n, n_sentences), "F03": _mean(letters, n), "F04": _mean(F.size(F.array_distinct(T.words(T.fold(text)))), n)}


def question_type(text: Column, sentences: Column) -> Column:
    """the interrogative that leads the first question, or else the first sentence; then yes or no; then the
    first interrogative anywhere."""
    lead = T.fold(F.coalesce(F.get(F.filter(sentences, lambda s: s.endswith("?")), F.lit(0)), F.get(sentences, F.lit(0)), F.lit("")))
    own = F.regexp_extract(lead, rf"(?U)^({_INTERROGATIVES})\b", 1)
    anywhere = F.regexp_extract(T.fold(F.coalesce(text, F.lit(""))), rf"(?U)\b({_INTERROGATIVES})\b", 1)
    polar = lead.endswith("?") & lead.rlike(rf"(?U)^(?:{'|'.join(AUXILIARIES)})\b")
    return F.when(own != "", F.initcap(own)).when(polar, "YesNo").when(anywhere != "", F.initcap(anywhere)).otherwise("Other")


def _lookup(pairs: dict[str, object]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def instruction_type(lemmas: Column, lexicon: dict[str, list[str]]) -> Column:
    """the class of the first lemma that has one; of a lemma's classes the first in the schema's order."""
    kinds = {w.casefold(): c for c in reversed(INSTRUCTION_TYPES[:-1]) for w in lexicon.get(c, [])}
    found = F.filter(F.transform(lemmas, lambda w: F.try_element_at(_lookup(kinds), w)), lambda k: k.isNotNull()) if kinds else None
    return F.coalesce(F.get(found, F.lit(0)), F.lit("Other")) if kinds else F.lit("Other")


def cognitive_demand(lemmas: Column, lexicon: dict[str, list[str]]) -> Column:
    """F16: the highest level, 1 to 6, of a lemma; 1 if none has one."""
    levels: dict[str, int] = {}
    for i, name in enumerate(("Remember", "Understand", "Apply", "Analyze", "Evaluate", "Create"), 1):
        for w in lexicon.get(name, []):
            levels[w.casefold()] = max(i, levels.get(w.casefold(), 0))
    return F.coalesce(F.array_max(F.transform(lemmas, lambda w: F.try_element_at(_lookup(levels), w))), F.lit(1)) if levels else F.lit(1)


def subquestion_count(text: Column, option_lines: Column | None = None) -> Column:
    """enumerated lines in runs, without option lines, and question marks beyond the first."""
    skip = (option_lines["first"], option_lines["n"]) if option_lines is not None else (None, None)
    return T.enumerated(T.lines(text), *skip) + F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\?")) - 1, F.lit(0))


def option_columns(options: Column) -> dict[str, Column]:
    """F18 to F20: options, their mean words, the population variance of those (two options or more)."""
    n = F.size(options)
    sizes = F.transform(options, lambda o: F.size(T.words(o)).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(total(sizes), n)
    spread = F.try_divide(total(F.transform(sizes, lambda x: x * x)), n) - mean * mean
    return {"F18": n, "F19": mean, "F20": F.when(n >= 2, F.greatest(spread, F.lit(0.0)))}


def phrase_columns(text: Column, n_words: Column, concepts: list[str] = CONCEPTS, technical: list[str] = TECHNICAL) -> dict[str, Column]:
    """F26 to F28: distinct concepts, those by word, occurrences of technical terms by word."""
    kinds = T.distinct_phrases(text, concepts)
    return {"F26": kinds, "F27": _mean(kinds, n_words), "F28": _mean(T.phrase_occurrences(text, technical), n_words)}


def constraint_columns(text: Column, patterns: list[str]) -> dict[str, Column]:
    """F31 and F32: log10 of the largest constraint and one, null without a readable one; constraints."""
    matches = T.constraint_matches(text, patterns)
    return {"F31": F.log10(1 + F.array_max(T.constraint_values(matches))), "F32": F.size(matches)}


def text_features(rows: DataFrame, lexicons: Lexicons | None = None, switches: dict | None = None) -> DataFrame:
    """``rows`` with a ``view``, and the features and indicators that need the text alone.

    F30 reads the view and the code; F33 to F35 the code, and are null without any. A switched-off family holds
    its defaults. ``code_parse_exact`` is 1 where the syntax tree gave F34 and F35.
    """
    lexicons, switches = lexicons or Lexicons(), switches or {}
    view, code = F.col("view.nl_view"), F.array_join("view.code_spans", "\n")
    has_code = F.size("view.code_spans") > 0
    sentences = F.greatest(F.size("view.sentences"), F.lit(1))
    counted = rows.withColumn("_code", complexity_column(F.when(has_code, code), switches.get("recursion_weight", 2), lexicons.branch_keywords, lexicons.loop_keywords, switches.get("indent_width", 4)))
    lemmas, n_words = T.words(T.fold(view)), F.size(T.words(view))
    code_lines = F.size(F.filter(T.lines(F.when(has_code, code)), lambda x: T.strip(x) != ""))
    found = {
        **lexical_columns(view, sentences),
        "F14": question_type(view, T.sentences(view)), "F15": instruction_type(lemmas, lexicons.task), "F16": cognitive_demand(lemmas, lexicons.bloom), "F17": subquestion_count(view, F.col("view.option_lines")),
        **option_columns(F.col("view.options")), **phrase_columns(view, n_words, lexicons.concepts, lexicons.technical_terms),
        "F30": T.weighted_phrase_max(F.when(has_code, F.concat(view, F.lit("\n"), code)).otherwise(view), lexicons.algorithm), **constraint_columns(view, lexicons.constraint_patterns),
        "F33": F.when(has_code, code_lines), "F34": F.col("_code.decisions"), "F35": F.col("_code.nesting"),
    }
    for family, members in FAMILIES.items():
        if not switches.get(f"use_{family}", True):
            found |= {f: F.lit(DISABLED.get(f)) for f in members if f in found}
    found |= {
        "mcq_detected": (F.size("view.options") > 0).cast("int"), "code_detected": has_code.cast("int"), "input_size_detected": found["F31"].isNotNull().cast("int"), "multi_segment": (sentences >= 2).cast("int"),
        "code_parse_exact": F.coalesce(F.col("_code.exact").cast("int"), F.lit(0)),
    }
    return counted.withColumns(found).drop("_code")


def audit(rows: DataFrame, key: str = "question_id") -> DataFrame:
    """What the features of a row rest on: never model input."""
    return rows.select(key, F.col("view.semantic_truncated").alias("semantic_truncated"), "code_parse_exact", F.col("view.code_tiers.tier").alias("code_detection_tiers"), F.col("view.mcq_tier").alias("mcq_detection_tier"))


# --- features fitted on training rows -------------------------------------------------------


def token_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, n) from an array of tokens."""
    return docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def fit_rare_words(counts: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """(token, df) over the training rows ``train(key)``."""
    return counts.join(train.select(key), key, "left_semi").groupBy("token").agg(F.count("*").alias("df"))


def rare_ratio(docs: DataFrame, counts: DataFrame, df: DataFrame, key: str, below: int = RARE_BELOW) -> DataFrame:
    """(key, F05): share of tokens, repeats included, that fewer than ``below`` training rows have; 0 without tokens."""
    common = df.where(F.col("df") >= below).select("token", F.lit(1).alias("common"))
    scored = counts.join(common, "token", "left").groupBy(key).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("common").isNull(), F.col("n")).otherwise(0)).alias("rare"))
    return docs.select(key).join(scored, key, "left").select(key, F.coalesce(F.col("rare") / F.col("all"), F.lit(0.0)).alias("F05"))


@dataclass
class TfIdf:
    """Vocabulary (token, idf), and the weight above which a term is a high one."""

    vocabulary: DataFrame
    threshold: float = 0.0

    def weights(self, counts: DataFrame, key: str) -> DataFrame:
        """(key, token, w) of unit length for each key, for the tokens of the vocabulary."""
        raw = counts.join(self.vocabulary, "token").select(key, "token", ((1 + F.log("n")) * F.col("idf")).alias("raw"))
        norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        return raw.join(norm, key).select(key, "token", (F.col("raw") / F.col("norm")).alias("w"))

    def summary(self, docs: DataFrame, weights: DataFrame, key: str) -> DataFrame:
        """(key, F23, F24, F25): mean, largest, and number above the threshold; null, null, 0 without a known term."""
        found = weights.groupBy(key).agg(F.avg("w").alias("F23"), F.max("w").alias("F24"), F.sum((F.col("w") > self.threshold).cast("int")).alias("F25"))
        return docs.select(key).join(found, key, "left").withColumn("F25", F.coalesce("F25", F.lit(0)))


def fit_tfidf(counts: DataFrame, train: DataFrame, key: str, share: float = 0.9, min_df: int = MIN_DF, most: int = MOST_TERMS, threshold: bool = True) -> TfIdf:
    """Sublinear tf, smooth idf over all rows of ``train(key)``, the ``most`` most frequent terms of ``min_df`` rows or
    more; the threshold is the ``share`` quantile of the training weights."""
    own = counts.join(train.select(key), key, "left_semi")
    fit = own.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
    n = train.count()
    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    # terms of equal frequency are taken in order; the vocabulary is ``most`` rows at any size of corpus
    vocabulary = cut(fit.where(F.col("df") >= min_df).orderBy(F.col("cf").desc(), "token").limit(most).select("token", idf.alias("idf")), "tfidf-vocabulary")
    model = TfIdf(vocabulary)
    if threshold:
        w = cut(model.weights(own, key).select("w"), "tfidf-train")
        model.threshold = exact_quantiles(w.select(F.lit("w").alias("name"), F.col("w").alias("value")), {"w": share})["w"] or 0.0
    return model


# --- all of them ----------------------------------------------------------------------------


@dataclass
class Fitted:
    """What extraction needs besides the text."""

    rare_df: DataFrame | None
    tfidf: TfIdf | None
    key: str = "question_id"


def _term_counts(views: DataFrame, key: str) -> DataFrame:
    return token_counts(views, key, F.regexp_extract_all(F.lower("view.nl_view"), F.lit(TERM), F.lit(0)))


def _word_counts(views: DataFrame, key: str) -> DataFrame:
    return token_counts(views, key, T.words(T.fold(F.col("view.nl_view"))))


def fit(train_views: DataFrame, key: str = "question_id", switches: dict | None = None) -> Fitted:
    """Rare words and TF-IDF of the training rows, a table of views."""
    switches = switches or {}
    rare = cut(_word_counts(train_views, key).groupBy("token").agg(F.count("*").alias("df")), "rare-words")
    tfidf = None
    if switches.get("use_tfidf", True):
        tfidf = fit_tfidf(cut(_term_counts(train_views, key), "train-terms"), train_views, key, switches.get("tfidf_high_percentile", 90) / 100)
    return Fitted(rare, tfidf, key)


def extract(views: DataFrame, fitted: Fitted, lexicons: Lexicons | None = None, switches: dict | None = None, syntax: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """(key, F01..F35, indicators, audit fields) of a table of views; no fitting.

    ``syntax(key, F09..F13)`` and ``similarity(key, F21, F22, F29)`` are used where given; without them those features are
    null and ``parse_ok`` is 0. F06 to F08 are null: they need a library's own syllable lists.
    """
    key, switches = fitted.key, switches or {}
    rows = text_features(views, lexicons, switches)
    if switches.get("use_lexical", True) and fitted.rare_df is not None:
        rows = rows.join(rare_ratio(views, cut(_word_counts(views, key), "words"), fitted.rare_df, key, switches.get("rare_word_df_threshold", RARE_BELOW)), key, "left")
    if switches.get("use_tfidf", True) and fitted.tfidf is not None:
        terms = cut(_term_counts(views, key), "terms")
        rows = rows.join(fitted.tfidf.summary(views, fitted.tfidf.weights(terms, key), key), key, "left")
    for family, extra in (("use_syntax", syntax), ("use_semantic_embedding", similarity)):
        if extra is not None and switches.get(family, True):
            rows = rows.join(extra, key, "left")
    rows = rows.withColumn("parse_ok", F.col("F13").isNotNull().cast("int") if "F13" in rows.columns else F.lit(0))
    missing = {f: F.lit(DISABLED.get(f)).cast("string" if f in ("F14", "F15") else "double") for f in FEATURES if f not in rows.columns}
    rows = rows.withColumns(missing) if missing else rows
    return rows.select(key, *FEATURES, *INDICATORS, F.col("view.semantic_truncated").alias("semantic_truncated"), "code_parse_exact", F.col("view.code_tiers.tier").alias("code_detection_tiers"), F.col("view.mcq_tier").alias("mcq_detection_tier"))


def views_of(records: DataFrame, lexicons: Lexicons | None = None, preprocess: dict | None = None, question: str = "question") -> DataFrame:
    """A table of ``records`` with their views; raises if a text is oversized."""
    preprocess = preprocess or {}
    views = cut(with_views(records, question, lexicons, preprocess.get("max_chars", 20000), preprocess.get("sentence_abbreviations")), "views")
    if views.where("view.oversized").limit(1).count():
        raise ValueError("oversized")
    return views


# --- one family at a time, for plain tables of texts ------------------------------------------


def lexical(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f01, f03, f04) of the texts as given."""
    found = lexical_columns(F.coalesce(text, F.lit("")), F.lit(1))
    return docs.select(key, found["F01"].alias("f01"), F.round(found["F03"], 6).alias("f03"), F.round(found["F04"], 6).alias("f04"))


def readability(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rd_flesch, rd_fk_grade, rd_fog) by the published formulas, syllables counted as groups of vowels; null
    below three words. They are not F06 to F08, whose syllables come from a library's lists."""
    tokens = F.transform(T.words(T.fold(F.col(text))), lambda w: F.greatest(F.regexp_count(w, F.lit("[aeiouyàâäéèêëíîïóôöúùûü]+")), F.lit(1)))
    rows = docs.select(key, tokens.alias("s"), F.greatest(F.size(T.sentences(F.col(text))), F.lit(1)).alias("k"))
    n, syllables = F.size("s"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    hard = F.size(F.filter("s", lambda x: x >= 3))
    enough = n >= 3
    formulas = {
        "rd_flesch": 206.835 - 1.015 * n / F.col("k") - 84.6 * F.try_divide(syllables, n),
        "rd_fk_grade": 0.39 * n / F.col("k") + 11.8 * F.try_divide(syllables, n) - 15.59,
        "rd_fog": 0.4 * (n / F.col("k") + 100 * F.try_divide(hard, n)),
    }
    return rows.select(key, *(F.when(enough, F.round(c, 6)).alias(name) for name, c in formulas.items()))


def sentence_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentences, f02, multi_segment): words a sentence, and whether there are two sentences or more."""
    rows = docs.select(key, F.size(T.words(text)).alias("w"), F.size(T.sentences(F.col(text))).alias("sentences"))
    return rows.select(key, "sentences", F.round(F.col("w") / F.greatest("sentences", F.lit(1)), 6).alias("f02"), (F.col("sentences") >= 2).alias("multi_segment"))


def option_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f18, f19, f20) of the texts as given."""
    found = option_columns(F.col("o"))
    return docs.select(key, T.options(F.col(text)).alias("o")).select(key, found["F18"].alias("f18"), F.round(found["F19"], 6).alias("f19"), F.round(found["F20"], 6).alias("f20"))


def phrase_ratios(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f27, f28) of the texts as given."""
    found = phrase_columns(F.col(text), F.size(T.words(text)))
    return docs.select(key, F.round(found["F27"], 6).alias("f27"), F.round(found["F28"], 6).alias("f28"))


def _folded_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return token_counts(docs, key, T.words(T.fold(F.col(text))))


def _lower_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return token_counts(docs.where(F.col(text).isNotNull()), key, F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def rare_word_ratio(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", below: int = RARE_BELOW) -> DataFrame:
    """(key, f05) for all rows, fitted on the rows ``train(key)``; the texts are read once."""
    counts = cut(_folded_counts(docs, key, text), "word-counts")
    return rare_ratio(docs, counts, fit_rare_words(counts, train, key), key, below).select(key, F.round("F05", 6).alias("f05"))


def tfidf(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", threshold: bool = False, share: float = 0.9) -> tuple[TfIdf, DataFrame]:
    """The model fitted on the rows ``train(key)``, and (key, token, w) of all rows; the texts are read once."""
    counts = cut(_lower_counts(docs, key, text), "term-counts")
    model = fit_tfidf(counts, train, key, share, threshold=threshold)
    return model, model.weights(counts, key)

