"""The engine's queries by name, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import features, metrics, neardup, records, splits, transform
from corpusmill.plans import questions, steps
from corpusmill.plans.catalog import ORACLE_SQL, QUERIES, query
from corpusmill.session import table

NUMERIC = steps.NUMERIC


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions; the raw label comes from the label table."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    raw = F.when(F.col("quality") == 0, "HARD").when(F.col("toxic") == 1, "Medium").when(F.col("quality") == 1, "easy")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("question_id"), F.col("text").alias("question"), raw.alias("raw_label"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.with_reason(labelled(spark, sf_dir)).where("reason is null").drop("reason")
    return records.with_identity(rows, supplied="question_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic classes and confidences from order keys."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 3).cast("int").alias("y"), ((F.col("o_orderkey") * 7 + F.col("o_custkey") % 2) % 3).cast("int").alias("p"), ((F.col("o_orderkey") % 101) / 100).alias("conf"))


_D2 = """d2 as (select cast(d.doc_id as varchar) question_id, d.text question,
 case when quality = 0 then 'HARD' when toxic = 1 then 'Medium' when quality = 1 then 'easy' end raw_label
 from documents d left join labels l on d.doc_id = l.doc_id),
 lab as (select *, case lower(raw_label) when 'hard' then 'Hard' when 'medium' then 'Moderate' when 'easy' then 'Easy' end as label from d2),
 rea as (select *, case when question is null or trim(regexp_replace(question, '\\s+', ' ', 'g')) = '' then 'missing_question'
  when length(question) > 20000 then 'oversized' when label is null then 'unknown_label' end as reason from lab),
 acc as (select *, sha256(replace(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), 'ß', 'ss')) raw_hash from rea where reason is null)"""
_PRED = "pr as (select o_orderkey % 3 y, (o_orderkey * 7 + o_custkey % 2) % 3 p, (o_orderkey % 101) / 100.0::double conf from orders)"
_CELLS = _PRED + ", cells as (select a.y, b.p, (select count(*) from pr where pr.y = a.y and pr.p = b.p) n from (values (0), (1), (2)) a(y), (values (0), (1), (2)) b(p))"
_TOKENS = """tok as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?')) token from documents)"""


_FOLD = "replace(lower(token), 'ß', 'ss')"


@query(f"with {_D2} select coalesce(label, 'none') as label, count(*) n from lab group by 1")
def label_normalize_counts(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.coalesce(records.normal_label("raw_label"), F.lit("none")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query(f"with {_D2} select coalesce(reason, 'accepted') reason, count(*) n from rea group by 1")
def reject_reasons(spark, sf_dir):
    return records.with_reason(labelled(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {_D2} select raw_hash, min(question_id) question_id from acc group by 1 having count(distinct label) = 1")
def exact_dedup_keep_first(spark, sf_dir):
    return records.deduplicate(accepted(spark, sf_dir)).select("raw_hash", "question_id")


_PARITY = "c as (select sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) raw_hash, cast(doc_id as varchar) question_id, doc_id % 2 y from documents where text is not null)"


def _by_parity(spark, sf_dir) -> DataFrame:
    """Documents labelled by their number, so that some copies disagree."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    label = F.when(F.col("doc_id") % 2 == 0, "Easy").otherwise("Hard")
    return records.with_identity(docs.select(F.col("text").alias("question"), F.col("doc_id").cast("string").alias("supplied"), label.alias("label")), supplied="supplied")


@query(f"with {_PARITY} select raw_hash, min(question_id) kept_id, count(*) copies from c group by 1 having count(distinct y) > 1")
def dedup_label_conflicts(spark, sf_dir):
    return records.duplicate_groups(_by_parity(spark, sf_dir)).where("conflict").select("raw_hash", "kept_id", "copies")


@query(f"with {_PARITY} select min(question_id) question_id from c group by raw_hash having count(distinct y) = 1")
def dedup_without_conflicts(spark, sf_dir):
    return records.deduplicate(_by_parity(spark, sf_dir)).select("question_id")


@query(f"with {_PARITY} select question_id, raw_hash from c where raw_hash in (select raw_hash from c group by 1 having count(distinct y) > 1)")
def conflicting_records(spark, sf_dir):
    return records.conflicting(_by_parity(spark, sf_dir)).select("question_id", "raw_hash")


@query("select item_id, sha256(k) raw_hash, substr(sha256(k), 1, 16) question_id from (select item_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') k from benchmark)")
def record_identity(spark, sf_dir):
    return records.with_identity(table(spark, sf_dir, "benchmark"), "text").select("item_id", "raw_hash", "question_id")


@query(f"with {_D2}, c as (select label, count(*) n from acc group by 1) select label, n, round(case when (select max(n) / min(n)::double from c) <= 1.5 then 1.0 else (select sum(n) from c) / (3.0 * n) end, 9) weight from c")
def class_weights(spark, sf_dir):
    return records.class_weights(accepted(spark, sf_dir))


@query(f"with {_TOKENS}, a as (select doc_id, count(*) f01, sum(length(token)) s, count(distinct {_FOLD}) k from tok group by 1) select d.doc_id, coalesce(f01, 0)::int f01, round(coalesce(s / f01::double, 0), 6) f03, round(coalesce(k / f01::double, 0), 6) f04 from documents d left join a using (doc_id)")
def lexical_features(spark, sf_dir):
    return features.lexical(table(spark, sf_dir, "documents"))


@query(f"with {_TOKENS}, l as (select doc_id, {_FOLD} token from tok), df as (select token, count(distinct doc_id) df from l group by 1), a as (select l.doc_id, sum(case when df < 5 then 1 else 0 end) / count(*)::double r from l join df using (token) group by 1) select d.doc_id, round(coalesce(r, 0), 6) f05 from documents d left join a using (doc_id)")
def rare_word_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return features.rare_word_ratio(docs, docs)


_TFIDF = """tok as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) token from documents), c as (select doc_id, token, count(*) n from tok group by 1, 2),
 fit as (select token, count(*) df, sum(n) cf from c group by 1),
 voc as (select token, ln((1 + (select count(*) from documents)) / (1.0 + df)::double) + 1 idf from fit where df >= 2 order by cf desc, token limit 50000),
 raw as (select doc_id, token, (1 + ln(n)) * idf as x from c join voc using (token)),
 w as (select doc_id, token, x / sqrt(sum(x * x) over (partition by doc_id)) w from raw)"""


@query(f"with {_TFIDF} select round(quantile_cont(w, 0.9), 6) tau, count(*) n from w")
def tfidf_threshold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, w = features.tfidf(docs, docs, threshold=True)
    return w.agg(F.round(F.lit(model.threshold), 6).alias("tau"), F.count("*").alias("n"))


@query(f"with {_TFIDF} select doc_id, round(avg(w), 6) f23, round(max(w), 6) f24, count(*) terms from w group by 1")
def tfidf_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    _, w = features.tfidf(docs, docs)
    return w.groupBy("doc_id").agg(F.round(F.avg("w"), 6).alias("f23"), F.round(F.max("w"), 6).alias("f24"), F.count("*").alias("terms"))


@query("with x as (select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) i, vec_id from embeddings), n as (select label, vec_id, sqrt(sum(v * v)) s from x group by 1, 2), u as (select label, i, sum(v / s) t from x join n using (label, vec_id) where s > 0 group by 1, 2) select label, k as n, round((q - k) / (k * (k - 1.0)), 6) mean_cosine from (select label, sum(t * t) q from u group by 1) join (select label, count(*) k from n where s > 0 group by 1) using (label) where k > 1")
def pairwise_cosine(spark, sf_dir):
    """Mean cosine over all pairs of a label's vectors, from the length of their sum: no pair is made."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("s > 0")
    sums = e.select("label", F.posexplode(F.transform("v", lambda x: x / F.col("s"))).alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("t"), F.count("*").alias("k"))
    out = sums.groupBy("label").agg(F.sum(F.col("t") * F.col("t")).alias("q"), F.max("k").alias("n")).where("n > 1")
    return out.select("label", "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0)), 6).alias("mean_cosine"))


@query(f"with {_CELLS} select y, p, n, round(coalesce(n / nullif(sum(n) over (partition by y), 0)::double, 0), 9) share from cells")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir)).withColumn("share", F.round("share", 9))


_CLASS = "k as (select c, (select sum(n) from cells where y = c and p = c) hit, (select sum(n) from cells where y = c) t, (select sum(n) from cells where p = c) s from (values (0), (1), (2)) v(c)), prf as (select c as class, coalesce(hit / nullif(s, 0)::double, 0) pr, coalesce(hit / nullif(t, 0)::double, 0) re, coalesce(2 * hit / nullif(s + t, 0)::double, 0) f1, t from k)"


@query(f'with {_CELLS}, {_CLASS} select class, round(pr, 9) "precision", round(re, 9) recall, round(f1, 9) f1, t::bigint support from prf')
def per_class_prf(spark, sf_dir):
    return metrics.per_class(predictions(spark, sf_dir)).select("class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"with {_CELLS}, {_CLASS} select round((select avg(f1) from prf), 9) macro_f1, round((select avg(abs(y - p)) from pr), 9) ordinal_mae, round((select avg(re) from prf where t > 0), 9) balanced_accuracy, round((select avg((y = p)::int) from pr), 9) accuracy, round(1 - (select sum(n * (y - p) ** 2) * sum(n) from cells) / (select sum(a.t * b.s * (a.c - b.c) ** 2) from k a, k b), 9) kappa")
def metric_summary(spark, sf_dir):
    return metrics.summary(predictions(spark, sf_dir))


@query(f"with {_PRED}, g as (select least(floor(conf * 10), 9)::int b, count(*) n, avg(conf) c, avg((y = p)::int) a from pr group by 1) select r.b as bin, coalesce(n, 0) n, round(c, 6) confidence, round(a, 6) accuracy from (select unnest(range(10))::int b) r left join g using (b)")
def reliability_bins(spark, sf_dir):
    return metrics.reliability(predictions(spark, sf_dir))


_SHINGLES = "t as (select item_id id, replace(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 'ß', 'ss') t from benchmark), sh as (select distinct id, substr(t, i::int, 5) s from (select id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) i from t))"
_SIG = _SHINGLES + ", sig as (select id, i, min(substr(sha256('42|' || i || '|' || s), 1, 16)) h from sh, (select unnest(range(128))::int i) group by 1, 2)"


@query(f"with {_SHINGLES} select id, count(*) n from sh group by 1")
def shingle_counts(spark, sf_dir):
    return neardup.shingles(table(spark, sf_dir, "benchmark"), "item_id", "text").groupBy("id").agg(F.count("*").alias("n"))


@query(f"with {_SIG} select id, i, h from sig")
def minhash_signature(spark, sf_dir):
    return neardup.signatures(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"with recursive {_SIG}, e as (select a.id u, b.id v from sig a join sig b on a.i = b.i and a.h = b.h group by 1, 2 having count(*) >= 0.85 * 128), r as (select u, v from e union select r.u, e.v from r join e on r.v = e.u) select u as id, min(v) family from r group by 1")
def near_dup_families(spark, sf_dir):
    return neardup.families(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(" union all ".join(f"select '{c}' as name, count({c}) n, round(median({c}), 6) median, round(var_pop({c}), 4) variance from lineitem" for c in NUMERIC))
def numeric_profile(spark, sf_dir):
    return transform.profile(table(spark, sf_dir, "lineitem"), NUMERIC)


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) r from lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def pearson_pairs(spark, sf_dir):
    return transform.correlations(table(spark, sf_dir, "lineitem"), NUMERIC)


@query("""select c_custkey, (c_mktsegment = 'BUILDING')::int::double as "c_mktsegment=BUILDING", (c_mktsegment = 'MACHINERY')::int::double as "c_mktsegment=MACHINERY" from customer""")
def one_hot(spark, sf_dir):
    out = transform.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return out.drop("c_mktsegment")


@query(f"with {_TOKENS}, a as (select doc_id, count(*) w from tok group by 1), s as (select doc_id, len({questions.sentence_sql('text')}) k from documents) select doc_id, k::int sentences, round(coalesce(w, 0) / greatest(k, 1)::double, 6) f02, k >= 2 multi_segment from s left join a using (doc_id)")
def sentence_features(spark, sf_dir):
    return features.sentence_features(table(spark, sf_dir, "documents"))


_VOWELS = "list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouyàâäéèêëíîïóôöúùûü]+'))))"


@query(f"with a as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+(?:''[\\p{{L}}\\p{{N}}_]+)?'), lambda x: replace(lower(x), 'ß', 'ss')) w, greatest(1, len({questions.sentence_sql('text')})) k from documents), b as (select doc_id, len(w)::double n, k, list_sum({_VOWELS}) s, len(list_filter({_VOWELS}, lambda x: x >= 3)) h from a) select doc_id, case when n >= 3 then round(206.835 - 1.015 * n / k - 84.6 * s / n, 6) end rd_flesch, case when n >= 3 then round(0.39 * n / k + 11.8 * s / n - 15.59, 6) end rd_fk_grade, case when n >= 3 then round(0.4 * (n / k + 100 * h / n), 6) end rd_fog from b")
def readability(spark, sf_dir):
    return features.readability(table(spark, sf_dir, "documents"))


#: Weights within a billionth of the threshold may fall on either side of it, so they are compared with a margin on both sides.
@query(f"with {_TFIDF}, t as (select quantile_cont(w, 0.9) tau from w), h as (select doc_id, count(*) n from w, t where w > tau + 1e-9 group by 1) select d.doc_id, coalesce(n, 0)::int f25 from documents d left join h using (doc_id)")
def high_tfidf_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, w = features.tfidf(docs, docs, threshold=True)
    model.threshold += 1e-9
    return model.summary(docs, w, "doc_id").select("doc_id", F.col("F25").alias("f25"))


@query(f"with {_PRED} select round(avg((conf - (y = 0)::int) ** 2 + ((1 - conf) / 2 - (y = 1)::int) ** 2 + ((1 - conf) / 2 - (y = 2)::int) ** 2), 9) brier from pr")
def brier_score(spark, sf_dir):
    rest = (1 - F.col("conf")) / 2
    return metrics.brier(predictions(spark, sf_dir).select("y", F.col("conf").alias("p0"), rest.alias("p1"), rest.alias("p2")))


@query(f"with {_PRED} select y, count(*) n from pr group by 1 order by n desc, y limit 1")
def majority_class(spark, sf_dir):
    return metrics.majority(predictions(spark, sf_dir))


@query("with n as (select o_custkey family, o_orderkey % 3 as label, count(*) n from orders group by 1, 2) select family, sum(n)::bigint as size, max_by(label, n * 10 + label)::int as label from n group by 1")
def family_majority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 3).cast("int").alias("label"))
    return splits.family_sizes(o)


def split_assignment(spark, sf_dir):
    """Customers as families of orders. Each choice depends on all before it: tests compare with a plain fold."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 3).cast("int").alias("label"))
    return splits.assign(o)


QUERIES["split_assignment"] = split_assignment


def document_shingle_counts(spark, sf_dir):
    """``shingle_counts`` over the corpus; this and the next two are too slow in SQL, tests compare by brute force."""
    return neardup.shingle_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


def document_signatures(spark, sf_dir):
    return neardup.sketches(table(spark, sf_dir, "documents"), "doc_id", "text")


def document_families(spark, sf_dir):
    return neardup.families(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES |= {f.__name__: f for f in (document_shingle_counts, document_signatures, document_families)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_keep_first(spark, sf_dir)
