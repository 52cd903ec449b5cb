"""Queries for what surrounds the features: reading and writing, gates, splits, transforms, schema, answers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import files, inference, registry, trainer
from corpusmill.operators import learners, metrics, records, splits, transform
from corpusmill.operators.learners import Model
from corpusmill.plans.catalog import query
from corpusmill.session import scratch, table
from corpusmill.sources import json_records

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- reading and writing ------------------------------------------------------------------------

#: A line a nation: good ones, other types, no object, no JSON, blank, a label with white space around it.
_LINE = """case n_nationkey % 8
 when 0 then concat('{"question": "', n_name, ' ?", "label": "Easy"}') when 1 then concat('{"question": ', cast(n_nationkey as string), ', "label": 1}')
 when 2 then '  ' when 3 then concat('{"question": "', n_name, '"') when 4 then '[1, 2]' when 5 then concat('{"question": "', n_name, '", "label": 2, "question_id": ', cast(n_nationkey as string), '}')
 when 6 then concat('{"question": "x", "label": "\\\\t HARD ", "question_id": "', n_name, '"}') else concat('{"question": " ", "label": null}') end"""
_SQL_LINE = _LINE.replace(" as string)", " as varchar)").replace("\\\\t", "\\t")
_PARSED = f"""l as (select n_nationkey, n_name, row_number() over (order by n_nationkey) line, {_SQL_LINE} record from nation),
 p as (select line, n_nationkey % 8 m, record, n_name, n_nationkey, case n_nationkey % 8 when 0 then n_name || ' ?' when 5 then n_name when 6 then 'x' when 7 then ' ' end question, case n_nationkey % 8 when 0 then 'Easy' when 1 then '1' when 5 then '2' when 6 then chr(9) || ' HARD ' end raw_label,
 case n_nationkey % 8 when 5 then cast(n_nationkey as varchar) when 6 then n_name end question_id, case n_nationkey % 8 when 3 then 'malformed_json' when 4 then 'malformed_record' when 1 then 'missing_question' when 7 then 'missing_question' end reason from l where n_nationkey % 8 <> 2)"""


def corpus_file(spark, sf_dir) -> str:
    path = scratch(spark, "corpus")
    table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(F.expr(_LINE)).write.text(path)  # 25 rows
    return path


@query(f"with {_PARSED} select line, question, raw_label, question_id, case when m in (3, 4) then reason end reason, record from p")
def json_lines(spark, sf_dir):
    return json_records.read_records(spark, corpus_file(spark, sf_dir))


@query(f"with {_PARSED} select line, reason, case m when 0 then 'Easy' when 5 then 'Moderate' when 6 then 'Hard' end as \"label\" from p")
def ingest_reasons(spark, sf_dir):
    rows = records.with_reason(json_records.read_records(spark, corpus_file(spark, sf_dir)))
    return rows.select("line", "reason", F.when(F.col("reason").isNull(), F.col("label")).alias("label"))


@query(f"with {_PARSED} select line, reason, record from p where reason is not null")
def reject_file(spark, sf_dir):
    path = scratch(spark, "rejects")
    json_records.write_rejects(records.with_reason(json_records.read_records(spark, corpus_file(spark, sf_dir))), path)
    return spark.read.schema("line long, reason string, record string").json(path)


@query("select row_number() over (order by n_nationkey) line, case when n_nationkey % 3 > 0 then n_name end question, case when n_nationkey % 3 > 0 then n_nationkey::varchar end raw_label, case when n_nationkey % 3 = 0 then 'malformed_record' end reason from nation")
def json_array(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    item = F.when(F.col("n_nationkey") % 3 == 0, F.lit("null")).otherwise(F.to_json(F.struct(F.col("n_name").alias("question"), F.col("n_nationkey").alias("label"))))
    whole = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("x")))).alias("a"))  # 25 rows
    path = scratch(spark, "array")
    whole.select(F.concat(F.lit("[\n "), F.array_join("a.x", ",\n "), F.lit("]"))).coalesce(1).write.text(path)
    return json_records.read_records(spark, path).select("line", "question", "raw_label", "reason")


@query("select n_nationkey::varchar question_id, case n_regionkey % 3 when 0 then 'Easy' when 1 then 'Moderate' else 'Hard' end as \"label\", (n_regionkey % 3)::int y from nation where n_nationkey % 2 = 0")
def selected_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    label = F.element_at(F.array(F.lit("Easy"), F.lit("Moderate"), F.lit("Hard")), F.col("n_regionkey") % 3 + 1)
    path = scratch(spark, "canonical")
    n.select(F.col("n_nationkey").cast("string").alias("question_id"), label.alias("label"), F.col("n_name").alias("question")).write.json(path)
    return json_records.read_selected(spark, path, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("question_id")))


@query("select case when o_orderkey % 4 = 3 then 'validation' else 'train' end split, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderkey % 4 <> 2 group by 1")
def feature_partitions(spark, sf_dir):
    part = F.when(F.col("o_orderkey") % 4 == 3, "validation").when(F.col("o_orderkey") % 4 == 2, "test").otherwise("train")
    path = scratch(spark, "matrix")
    trainer.write_matrix(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), part.alias("split"), "o_totalprice"), path, ["o_totalprice"])
    return trainer.read_matrix(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select 'a.json' as path, sha256('{' || chr(10) || '  \"n\": ' || count(*) || chr(10) || '}') sha256 from nation union all select 'deep/b.bin', sha256('x') union all select 'deep/c.bin', sha256('')")
def artifact_hashes(spark, sf_dir):
    folder = scratch(spark, "artifacts")
    files.write_json(spark, f"{folder}/a.json", {"n": 1})
    files.write_json(spark, f"{folder}/a.json", {"n": table(spark, sf_dir, "nation").count()})
    files.write_bytes(spark, f"{folder}/deep/b.bin", b"x")
    files.write_bytes(spark, f"{folder}/deep/c.bin", b"")
    found = files.hashes(spark, folder)
    files.verify_hashes(spark, folder, {r["path"]: r["sha256"] for r in found.collect()})
    return found


@query("select 'ingest' stage, 'warning' severity, 'oversized' reason, 'q1' question_id union all select 'split', 'info', 'done', null")
def event_log(spark, sf_dir):
    folder = scratch(spark, "events")
    trainer.write_event(spark, folder, "ingest", "warning", "oversized", "q1")
    trainer.write_event(spark, folder, "split", "info", "done")
    return spark.read.schema("stage string, severity string, reason string, question_id string").json(f"{folder}/events")


@query("select sha256(n_name) text_hash, sha256('{\"a\":[1,\"é\"],\"b\":null}') json_hash from nation")
def stable_hashes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("text_hash"), F.lit(registry.json_hash({"b": None, "a": [1, "é"]})).alias("json_hash"))


# --- gates and splits ---------------------------------------------------------------------------


def _labelled_orders(spark, sf_dir) -> DataFrame:
    label = F.element_at(F.array(F.lit("Easy"), F.lit("Moderate"), F.lit("Hard")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    part = F.when(F.col("o_orderkey") % 20 < 14, "train").when(F.col("o_orderkey") % 20 < 17, "validation")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("question_id"), label.alias("label"), part.alias("split"))


_LABELS = "(select ['Easy', 'Moderate', 'Hard'][(o_orderkey % 3 + 1)::int] as label, case when o_orderkey % 20 < 14 then 'train' when o_orderkey % 20 < 17 then 'validation' end split from orders)"


@query(f"select s as split, l as label, count(o.label) n, count(o.label) >= 30 enough from (values ('train'), ('validation'), ('test')) a(s), (values ('Easy'), ('Moderate'), ('Hard')) b(l) left join {_LABELS} o on o.split = s and o.label = l group by 1, 2")
def split_balance(spark, sf_dir):
    return records.split_balance(_labelled_orders(spark, sf_dir), 30)


@query(f"select label, count(*) n from {_LABELS} group by 1")
def training_gate(spark, sf_dir):
    """Counts by class of a corpus that passes the gate."""
    counts = records.check_training(_labelled_orders(spark, sf_dir), 100, 30)
    return spark.createDataFrame(list(counts.items()), "label string, n long")


@query("select o_orderkey, ['Easy', 'Moderate', 'Hard'][(o_orderkey % 3 + 1)::int] as label, (o_orderkey % 3)::int y, (case when o_orderkey % 2 = 0 then 2 end) is null no_number from orders")
def label_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    label = F.element_at(F.array(F.lit("Easy"), F.lit("Moderate"), F.lit("Hard")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    other = F.when(F.col("o_orderkey") % 2 == 0, "2").otherwise("none")
    return o.select("o_orderkey", label.alias("label"), records.label_number(label).alias("y"), records.label_number(other).isNull().alias("no_number"))


def _small_corpus(spark, sf_dir) -> DataFrame:
    """Nations as records, one a family."""
    label = F.element_at(F.array(F.lit("Easy"), F.lit("Moderate"), F.lit("Hard")), F.col("n_nationkey") % 3 + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("question_id"), label.alias("label"), F.col("n_nationkey").alias("family"))


@query(None)
def small_corpus_split(spark, sf_dir):
    """A held-out part by a seeded order; tests compare with a plain walk through it."""
    return splits.split_records(_small_corpus(spark, sf_dir)).records


@query(None)
def repeated_folds(spark, sf_dir):
    """(repeat, fold, question_id, split) of the rest of a small corpus."""
    split = splits.split_records(_small_corpus(spark, sf_dir))
    pool = split.records.where("split = 'train'").select("question_id", "label", F.col("family_id").alias("family"))
    return splits.fold_rows(pool, split.folds).select("repeat", "fold", "question_id", "split")


@query("select r.r::int repeat, f.f::int fold, o_orderkey question_id, case when (o_orderkey + r.r) % 5 = f.f then 'validation' else 'train' end split from orders, range(2) r(r), range(5) f(f)")
def fold_assignment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"))
    folds = o.select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("repeat"), F.col("question_id").alias("family")).withColumn("fold", F.pmod(F.col("family") + F.col("repeat"), F.lit(5)).cast("int"))
    return splits.fold_rows(o.withColumn("family", F.col("question_id")), folds).drop("family")


# --- transforms ---------------------------------------------------------------------------------


_CLEAN = "select l_orderkey, l_linenumber, case when l_quantity < 5 then null else l_quantity end l_quantity, case when l_tax = 0 then null else l_tax end l_tax from lineitem"


def _holes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 5, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("l_tax"))


@query(f"with c as ({_CLEAN}), m as (select median(l_quantity) q, median(l_tax) t from c) select l_quantity, round(l_tax, 6) l_tax, count(*) n from (select coalesce(l_quantity, q) l_quantity, coalesce(l_tax, t) l_tax from c, m) group by 1, 2")
def median_impute(spark, sf_dir):
    rows = _holes(spark, sf_dir)
    done = transform.impute(rows, rows, ["l_quantity", "l_tax"])
    return done.groupBy("l_quantity", F.round("l_tax", 6).alias("l_tax")).agg(F.count("*").alias("n"))


@query("select 'nothing' as name union all select 'never'")
def missing_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"nothing": F.lit(None).cast("double"), "never": F.lit(float("nan"))})
    return spark.createDataFrame([(c,) for c in transform.all_missing(rows, ["l_tax", "nothing", "l_quantity", "never"])], "name string")


@query(f"with c as ({_CLEAN}) select l_orderkey, l_linenumber from c where l_quantity is null or l_tax is null")
def not_finite_rows(spark, sf_dir):
    return transform.not_finite(_holes(spark, sf_dir), ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber")


_DERIVED = "select l_quantity a, 1.0::double b, -2 * l_quantity + l_tax c, l_extendedprice d, l_discount e, l_discount * 100 + l_tax f from lineitem"


@query(f"with x as ({_DERIVED}), l as (unpivot (select row_number() over () i, * from x) on a, b, c, d, e, f into name n value v), v as (select n, var_pop(v) s from l group by 1), r as (select p.n p, q.n q, abs(corr(p.v, q.v)) r from l p join l q on p.i = q.i and p.n < q.n where p.n <> 'b' and q.n <> 'b' group by 1, 2) select n as \"name\" from v where s > 0 and not exists (select 1 from r where r.q = n and r.r > 0.9)")
def selected_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_quantity").alias("a"), F.lit(1.0).alias("b"), (-2 * F.col("l_quantity") + F.col("l_tax")).alias("c"), F.col("l_extendedprice").alias("d"), F.col("l_discount").alias("e"), (F.col("l_discount") * 100 + F.col("l_tax")).alias("f"))
    return spark.createDataFrame([(c,) for c in transform.uncorrelated(rows, list("abcdef"))], "name string")


@query("with m as (select avg(l_quantity) a, stddev_pop(l_quantity) s, avg(l_tax) b, stddev_pop(l_tax) t from lineitem) select round((l_quantity - a) / s, 6) l_quantity, round((l_tax - b) / t, 6) l_tax, count(*) n from lineitem, m group by 1, 2")
def standard_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    done = transform.fit_scaler(rows, ["l_quantity", "l_tax"])(rows)
    return done.groupBy(F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax")).agg(F.count("*").alias("n"))


@query(None)
def pca_projection(spark, sf_dir):
    """(vec_id, eight components); tests compare with a singular value decomposition."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return transform.fit_components(e, "embedding", 8)(e).drop("embedding")


_FEATURE_NAMES = "(select 'F' || lpad(i::varchar, 2, '0') f, i from range(1, 36) r(i))"


@query("select n_name question_id, case when n_regionkey = 0 then 'What' else 'Other' end \"F14\", 'Other' \"F15\", n_nationkey::double \"F01\", null::double \"F35\", 0.0::double parse_ok, 40::bigint n_columns from nation")
def assembled_features(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("question_id"), F.when(F.col("n_regionkey") == 0, "What").alias("F14"), F.col("n_nationkey").alias("F01"))
    done = transform.assemble(rows)
    return done.select("question_id", "F14", "F15", "F01", "F35", "parse_ok", F.lit(len(done.columns) - 1).cast("long").alias("n_columns"))


# --- schema -------------------------------------------------------------------------------------

_LOST = "case p when 'P1' then i in (21, 22, 29) when 'P2' then i between 9 and 13 when 'P3' then i between 6 and 8 when 'P4' then i in (21, 22, 29) or i between 9 and 13 else false end"


@query(f"with f as (select p, f, i from (values ('P0'), ('P1'), ('P2'), ('P3'), ('P4')) v(p), {_FEATURE_NAMES} where not ({_LOST}) and i not between 23 and 25) select p as profile, f as \"column\" from f where i not in (14, 15) union all select distinct p, 'mcq_detected' from f where i between 18 and 22 union all select distinct p, 'code_detected' from f where i >= 30 union all select distinct p, 'input_size_detected' from f where i in (31, 32) union all select distinct p, 'parse_ok' from f where i between 9 and 13 union all select distinct p, 'multi_segment' from f where i = 29")
def active_columns(spark, sf_dir):
    """Numeric columns of each profile with the TF-IDF family switched off."""
    rows = [(p, c) for p in registry.LOST for c in registry.numeric_columns(registry.active_features(p, {"use_tfidf": False}))]
    return spark.createDataFrame(rows, "profile string, column string")


@query(f"with f as (select f, i from {_FEATURE_NAMES} where i between 14 and 22 and i not in (14, 15)) select f as \"column\" from f union all select 'mcq_detected' union all select unnest(list_transform(['What', 'Why', 'How', 'Which', 'When', 'Where', 'YesNo', 'Other'], lambda v: 'question_type=' || v)) union all select unnest(list_transform(['Define', 'Explain', 'Calculate', 'Compare', 'Analyze', 'Design', 'Prove', 'Describe', 'Identify', 'Other'], lambda v: 'instruction_type=' || v))")
def ablation_columns(spark, sf_dir):
    """Columns of the task and options families among all of them."""
    every = registry.numeric_columns(registry.active_features("P0")) + registry.ONE_HOT + ["sem_pca_000"]
    return spark.createDataFrame([(c,) for c in registry.family_columns(every, ["task", "mcq"])], "column string")


@query("select * from (values ('A0', 0), ('A1', 2), ('A2', 3), ('A3', 4), ('A4', 5), ('A5', 6), ('A6', 7), ('A7', 8), ('A8', 9), ('A8b-32', 9), ('A8b-48', 9), ('A8b-64', 9), ('S_lexical', 1), ('S_programming', 1), ('S_semantic_embedding', 1)) v(run_id, families)")
def ablation_plan(spark, sf_dir):
    return spark.createDataFrame([(r, len(f)) for r, f in learners.ablation_plan(["F01", "F05", "F30"])], "run_id string, families int")


@query("select s, p, r, q, case when not q then case when (not s)::int + (not p)::int + (not r)::int >= 2 then 'P4' else 'BLOCKED' end when (not s)::int + (not p)::int + (not r)::int >= 2 then 'P4' when not s then 'P1' when not p then 'P2' when not r then 'P3' else 'P0' end as profile from (values (true), (false)) a(s), (values (true), (false)) b(p), (values (true), (false)) c(r), (values (true), (false)) d(q)")
def dependency_profiles(spark, sf_dir):
    rows = [(*x, inference.resolve_profile(*x)[0]) for x in product((True, False), repeat=4)]
    return spark.createDataFrame(rows, "s boolean, p boolean, r boolean, q boolean, profile string")


# --- answers, runs ------------------------------------------------------------------------------


_PROBS = "(select o_orderkey, [o_orderkey % 7 / 20.0::double, o_orderkey % 5 / 20.0::double, o_orderkey % 3 / 20.0::double] p from orders)"


@query(f"with a as (select o_orderkey, p, list_max(p) m from {_PROBS}) select o_orderkey::varchar question_id, case when p[1] = m then 'Easy' when p[2] = m then 'Moderate' else 'Hard' end predicted_label, round(p[1], 6) easy, round(p[3], 6) hard, round(m, 6) model_confidence, false calibrated, 'v' model_version from a")
def answer_contract(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("question_id"), F.array(k % 7 / 20, k % 5 / 20, k % 3 / 20).alias("probability"))
    rows = rows.withColumn("p", learners.arg_max(F.col("probability")))
    done = inference.answers(rows, {"calibrated": False, "model_version": "v"})
    return done.select("question_id", "predicted_label", F.round(F.col("probabilities")["Easy"], 6).alias("easy"), F.round(F.col("probabilities")["Hard"], 6).alias("hard"), F.round("model_confidence", 6).alias("model_confidence"), "calibrated", "model_version")


_RUNS = "(select n_nationkey step, n_name run_id, (n_nationkey * 7 % 5) / 10.0::double macro_f1, (n_nationkey % 3) / 10.0::double ordinal_mae, (n_nationkey % 2) / 10.0::double balanced_accuracy from nation)"


def _runs(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("step"), F.col("n_name").alias("run_id"), ((k * 7 % 5) / 10).alias("macro_f1"), ((k % 3) / 10).alias("ordinal_mae"), ((k % 2) / 10).alias("balanced_accuracy"))


@query(f"select run_id, macro_f1 from {_RUNS} order by macro_f1 desc, ordinal_mae, balanced_accuracy desc, run_id limit 1")
def selected_run(spark, sf_dir):
    return metrics.best_run(_runs(spark, sf_dir)).select("run_id", "macro_f1")


@query(f"select step, run_id, macro_f1, round(macro_f1 - first_value(macro_f1) over (order by step), 9) over_first, round(macro_f1 - lag(macro_f1) over (order by step), 9) over_previous from {_RUNS}")
def ladder_deltas(spark, sf_dir):
    return metrics.ladder_deltas(_runs(spark, sf_dir))


@query("select 'skipped' status, 'shap_unavailable_or_not_installed' reason")
def shap_report(spark, sf_dir):
    return spark.createDataFrame([tuple(learners.shap_summary().values())], "status string, reason string")


def _learning_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    y = F.when(size < 17, 0).when(size < 34, 1).otherwise(2)
    noise = (F.pmod(F.xxhash64("p_partkey"), F.lit(1000)) / 1000.0) * 20
    return p.select(F.col("p_partkey").alias("question_id"), y.cast("int").alias("y"), (size + noise).alias("a"), price.alias("b"), F.log1p(size).alias("c"))


def baseline_models(spark, sf_dir) -> dict[str, Model]:
    """Each kind of learner fitted on most of the parts."""
    rows = _learning_rows(spark, sf_dir)
    train = rows.where("question_id % 4 <> 0")
    weight, _, _ = learners.weight_column(train)
    return {
        "baseline_logistic": learners.logistic(train, ["a", "b", "c"], weight, iterations=50), "baseline_rf": learners.forest(train, ["a", "b", "c"], weight, trees=10, depth=5),
        "gbt": learners.boosted(train, ["a", "b"], weight, depth=2, rounds=2),
    }


@query(None)
def model_scores(spark, sf_dir):
    """(run_id, macro_f1, ordinal_mae, balanced_accuracy, accuracy, kappa) on the parts held out, and of a calibrated forest."""
    rows = _learning_rows(spark, sf_dir)
    held = rows.where("question_id % 4 = 0")
    models = baseline_models(spark, sf_dir)
    models["calibrated_rf"] = learners.calibrate(models["baseline_rf"], held)
    scores = {name: learners.evaluate(m, held) for name, m in models.items()}
    found = [(name, *(float(v[s]) for s in learners.SCORES)) for name, v in scores.items()]
    return spark.createDataFrame(found, "run_id string, " + ", ".join(f"{s} double" for s in learners.SCORES))
