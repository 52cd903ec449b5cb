"""Queries over questions derived from parts: views, features of each family, and what is fitted on them.

The questions are written by one SQL expression that Spark and the checking SQL both run, with capitals, tabs, powers,
hyphens, code, options and sub-questions; the SQL then works on that text by its own formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import lexicons as L
from corpusmill.functions import text as T
from corpusmill.functions.views import with_views
from corpusmill.operators import embeddings, features, syntax
from corpusmill.plans.catalog import query
from corpusmill.session import cut, table

_NL, _TAB = "chr(10)", "chr(9)"
_CODE = f"concat('```python', {_NL}, 'for i in range(', cast(p_size as string), '):', {_NL}, '    if i > 2:', {_NL}, '        for j in range(i):', {_NL}, '            print(i, j)', {_NL}, {_NL}, 'while x:', {_NL}, '    x = 0', {_NL}, '```')"
_LOOSE = f"concat('```', {_NL}, 'for (int i = 0; i < n; i++) {{', {_NL}, '  while (a && b) {{ c(); }}', {_NL}, '}}', {_NL}, '```')"
#: One question a part.
QUESTION = f"""case p_partkey % 9
 when 0 then concat('What is ', p_name, '? Define the Binary  Search tree and a GRAPH. Is it NP-hard?')
 when 1 then concat('Is the max flow of ', p_name, ' a Segment-Tree, or a hash_map? compute and then evaluate it.')
 when 2 then concat('Pick one for $x^2$ of ', p_name, ': ', {_NL}, 'A)', {_TAB}, p_name, {_NL}, {_TAB}, 'B) ', p_type, {_NL}, 'c) none of them')
 when 3 then concat('Sort the Array, N <= 1E', cast(p_size % 6 as string), ' and Up to ', cast(p_size as string), ',000 items; 1 ≤ k ≤ 10^3. See Dr. Who vs. 5 others.')
 when 4 then concat('Explain why this loops:', {_NL}, {_CODE}, {_NL}, 'Where does it end? and at most 2_0 steps')
 when 5 then concat('Prove each part.', {_NL}, '(a) ', p_name, {_NL}, '(b) ', p_brand, {_NL}, '(d) why?', {_NL}, '3. one', {_NL}, '4. two', {_NL}, {_NL}, '(ii) x', {_NL}, '(iii) how? when?')
 when 6 then concat('Tell me how ', p_name, ' works with dynamic programming and recursion.', {_NL}, {_LOOSE}, {_NL}, 'm < ', cast(p_size as string))
 when 7 then concat('Choose:', {_NL}, '1. ', p_brand, {_NL}, '2. ', p_type, ' or so', {_NL}, '4. never', {_NL}, 'Describe an integral over data  structure memory; n<5')
 else concat('  ', upper(p_name), ' max-flow', {_NL}, {_NL}, {_NL}, {_NL}, 'x = y;', {_NL}, 'k ≤ 1,000 and q < 7^2  ', {_NL}, 'a: one', {_NL}, 'b: two') end"""
_SQL_QUESTION = QUESTION.replace(" as string)", " as varchar)")
_W = "[\\p{L}\\p{N}_]"
_WORDS = lambda text: f"regexp_extract_all({text}, '{_W}+(?:''{_W}+)?')"
_SIGNATURE = "(" + "|".join(s.replace("'", "''") for s in L.CODE_SIGNATURES) + ")"

#: Views: lines within fences and lines with a signature are a space, formulas a word.
_VIEW = f"""qs as (select p_partkey k, {_SQL_QUESTION} q from part),
 raw as (select k, q, trim(regexp_replace(regexp_replace(q, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) t from qs),
 ln as (select k, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) - 1 i from raw),
 fe as (select *, starts_with(x, '```') f, sum(starts_with(x, '```')::int) over (partition by k order by i) c from ln),
 co as (select *, f or c % 2 = 1 as fenced, f or c % 2 = 1 or regexp_matches(x, '{_SIGNATURE}') as code from fe),
 vl as (select k, i, x, code, fenced, f, case when code then ' ' else regexp_replace(x, '\\$[^$]+\\$', ' MATHEXPR ', 'g') end y from co),
 vw as (select k, string_agg(y, chr(10) order by i) v from vl group by 1)"""


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(QUESTION).alias("question"))


def views(spark, sf_dir) -> DataFrame:
    return with_views(questions(spark, sf_dir), "question")


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("k", *(F.round(n, 6).alias(n.lower()) for n in names))


#: Options: marked lines as long as line, kind and value go on together.
_RUN = """mk as (select k, i, x, case {cases} end mark from {source}),
 hit as (select k, i, x, mark, regexp_extract(lower(mark), '([0-9]+|[a-z])[.)\\]]?\\s*$', 1) val, row_number() over (partition by k order by i) - 1 r from mk where mark is not null),
 kv as (select *, regexp_matches(val, '^[0-9]') num, case when val = '' then null when regexp_matches(val, '^[0-9]') then val::int else ascii(val) end n from hit),
 st as (select *, first_value(i) over w i0, first_value(n) over w n0, first_value(num) over w num0 from kv window w as (partition by k order by i)),
 ok as (select *, bool_and(coalesce(i - r = i0 and n - r = n0 and num = num0, false)) over (partition by k order by i) fits from st),
 op as (select k, i, trim(substr(x, length(mark) + 1), ' ' || chr(9)) o from ok where fits and r < 12 qualify count(*) over (partition by k) >= 2)"""


def _option_sql(source: str) -> str:
    cases = " ".join(f"when regexp_matches(x, '{m}') then regexp_extract(x, '{m}')" for m in L.OPTION_MARKERS)
    return _RUN.format(cases=cases, source=source)


@query(f"with {_VIEW}, {_option_sql('ln')}, s as (select k, trim(string_agg(case when (k, i) in (select k, i from op) then null else y end, chr(10) order by i), ' ' || chr(10) || chr(9)) nl_stem from vl group by 1) select k, v as nl_view, nl_stem, (select count(*) from op where op.k = vw.k)::int options, len(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> '')) > 256 semantic_truncated from vw join s using (k)")
def question_views(spark, sf_dir):
    return views(spark, sf_dir).select("k", "view.nl_view", "view.nl_stem", F.size("view.options").alias("options"), "view.semantic_truncated")


#: Spans of code: lines with code whose line before has none begin one; fences and a blank line after the first are no code.
@query(f"with {_VIEW}, b as (select *, case when code and not coalesce(lag(code) over (partition by k order by i), false) then 1 else 0 end first from vl), g as (select *, sum(first) over (partition by k order by i) span from b where code) select k, span::int as \"span\", min(i)::int as \"start\", (max(i) + 1)::int as \"end\", case when bool_or(fenced) then 'fenced' else 'signature' end tier, coalesce(string_agg(x, chr(10) order by i) filter (not f), '') code from g group by 1, 2")
def code_spans(spark, sf_dir):
    rows = views(spark, sf_dir).select("k", F.posexplode(F.arrays_zip("view.code_tiers", "view.code_spans")).alias("i", "z"))
    return rows.select("k", (F.col("i") + 1).alias("span"), F.col("z.code_tiers.start").alias("start"), F.col("z.code_tiers.end").alias("end"), F.col("z.code_tiers.tier").alias("tier"), F.col("z.code_spans").alias("code"))


_SPACES = "[\\s\\x{a0}\\x{2028}\\x{2029}\\x{3000}\\x{2000}-\\x{200a}]"
_ENDS = "regexp_replace(regexp_replace(coalesce(@, ''), '(?i)(^|" + _SPACES + ")(" + "|".join(a.replace(".", "\\.") for a in L.ABBREVIATIONS) + ")', '\\1\\2' || chr(1), 'g'), '([.!?])[ \\t]+([\\p{Lu}\\p{Nd}\"''(\\[])', '\\1' || chr(10) || '\\2', 'g')"


def sentence_sql(text: str) -> str:
    """The list of sentences of a column."""
    return "list_filter(list_transform(string_split(" + _ENDS.replace("@", text) + ", chr(10)), lambda x: trim(replace(x, chr(1), ''), ' ' || chr(9))), lambda x: x <> '')"



_LEXICON = lambda lists: "(values " + ", ".join(f"('{w}', '{c}', {i})" for i, (c, ws) in enumerate(lists.items(), 1) for w in ws) + ")"


@query(f"""with {_VIEW}, se as (select k, v, {sentence_sql("v")} s from vw), le as (select k, lower(v) v, lower(coalesce(list_filter(s, lambda x: ends_with(x, '?'))[1], s[1], '')) lead from se),
 tk as (select k, unnest(list_transform({_WORDS("v")}, lambda w: lower(w))) w, generate_subscripts({_WORDS("v")}, 1) i from vw),
 ins as (select k, arg_min(c, i) c from tk join {_LEXICON(L.TASKS)} t(w, c, o) using (w) group by 1), blo as (select k, max(o) o from tk join {_LEXICON(L.BLOOM)} t(w, c, o) using (w) group by 1)
 select k, case when regexp_matches(lead, '^(what|why|how|which|when|where)\\b') then upper(lead[1]) || regexp_extract(lead, '^.([a-z]+)', 1)
  when ends_with(lead, '?') and regexp_matches(lead, '^({"|".join(L.AUXILIARIES)})\\b') then 'YesNo'
  when regexp_matches(v, '\\b(what|why|how|which|when|where)\\b') then upper(regexp_extract(v, '\\b(what|why|how|which|when|where)\\b', 1)[1]) || regexp_extract(v, '\\b(what|why|how|which|when|where)\\b', 1)[2:] else 'Other' end f14,
 coalesce(ins.c, 'Other') f15, coalesce(blo.o, 1)::int f16 from le left join ins using (k) left join blo using (k)""")
def question_types(spark, sf_dir):
    return features.text_features(views(spark, sf_dir)).select("k", F.col("F14").alias("f14"), F.col("F15").alias("f15"), F.col("F16").alias("f16"))


_ROMAN = "case e when 'ii' then 2 when 'iii' then 3 when 'iv' then 4 when 'vi' then 6 when 'vii' then 7 when 'viii' then 8 when 'ix' then 9 end"


@query(f"""with {_VIEW}, gl as (select k, unnest(string_split(q, chr(10))) x, generate_subscripts(string_split(q, chr(10)), 1) - 1 i from qs), {_option_sql('gl')},
 en as (select k, i, lower(regexp_extract(y, '(?i)^\\s*(\\([ivxlcdm]+\\)|\\([a-z]\\)|\\d+[.)])\\s+', 1)) m from vl where (k, i) not in (select k, i from op)),
 ev as (select k, i, regexp_replace(m, '[().]', '', 'g') e from en where m <> ''),
 nu as (select k, i, case when regexp_matches(e, '^[0-9]') then 1 when length(e) = 1 then 2 else 3 end kind, case when regexp_matches(e, '^[0-9]+$') then e::int when length(e) = 1 then ascii(e) - 96 else {_ROMAN} end n from ev),
 br as (select *, case when lag(i) over w = i - 1 and lag(kind) over w = kind and lag(n) over w = n - 1 then 0 else 1 end b from nu where n is not null window w as (partition by k order by i)),
 runs as (select k, g, count(*) c from (select *, sum(b) over (partition by k order by i) g from br) group by 1, 2 having count(*) > 1), su as (select k, sum(c) c from runs group by 1)
 select k, (coalesce(c, 0) + greatest(len(regexp_extract_all(v, '\\?')) - 1, 0))::int f17 from vw left join su using (k)""")
def subquestions(spark, sf_dir):
    return features.text_features(views(spark, sf_dir)).select("k", F.col("F17").alias("f17"))


@query(f"with {_VIEW}, {_option_sql('ln')}, z as (select k, count(*) n, avg(len({_WORDS('o')})) m, var_pop(len({_WORDS('o')})) s from op group by 1) select k, coalesce(n, 0)::int f18, round(m, 6) f19, round(s, 6) f20 from vw left join z using (k)")
def option_features(spark, sf_dir):
    found = features.option_columns(F.col("view.options"))
    return views(spark, sf_dir).select("k", found["F18"].alias("f18"), F.round(found["F19"], 6).alias("f19"), F.round(found["F20"], 6).alias("f20"))


def _hit(term: str, text: str, gap: str = "\\s+") -> str:
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])" + term.replace(" ", gap) + "([^\\p{L}\\p{N}_]|$)')"


_ALL_TEXT = "(select k, v || coalesce(chr(10) || c, '') a, v from vw left join (select k, string_agg(x, chr(10) order by i) c from vl where code and not f group by 1) using (k))"
_KINDS = " + ".join(f"({_hit(t, 'v')})::int" for t in L.CONCEPTS)


@query(f"with {_VIEW} select k, {_KINDS} f26, greatest(0, " + ", ".join(f"case when {_hit(t, 'a', '(\\s|[_-])+')} then {w} else 0 end" for t, w in L.ALGORITHMS.items()) + f") f30 from {_ALL_TEXT}")
def concept_counts(spark, sf_dir):
    return features.text_features(views(spark, sf_dir)).select("k", F.col("F26").alias("f26"), F.col("F30").alias("f30"))


_TIMES = " + ".join("len(regexp_extract_all(v, '(?i)(?:^|[^\\p{L}\\p{N}_])" + t.replace(" ", "\\s+") + "(?:[^\\p{L}\\p{N}_]|$)'))" for t in L.TECHNICAL)


@query(f"with {_VIEW} select k, round(({_KINDS}) / greatest(w, 1)::double, 6) f27, round(({_TIMES}) / greatest(w, 1)::double, 6) f28 from (select k, v, len({_WORDS('v')}) w from vw)")
def phrase_ratios(spark, sf_dir):
    return _rounded(features.text_features(views(spark, sf_dir)), "F27", "F28")


_N = "([0-9][0-9,_]*(?:(?:\\^|[eE])[+-]?[0-9]+)?)\\b"


@query(f"""with {_VIEW}, m as (select k, regexp_extract_all(v, '(?i)\\b[nmkq]\\s*(?:<=|≤|<)\\s*{_N}', 1) || regexp_extract_all(v, '(?i)\\b1\\s*≤\\s*[nmkq]\\s*≤\\s*{_N}', 1) || regexp_extract_all(v, '(?i)\\b(?:up to|at most)\\s+{_N}', 1) ms from vw),
 u as (select k, regexp_replace(unnest(ms), '[,_]', '', 'g') t from m), n as (select k, max(case when contains(t, '^') then pow(split_part(t, '^', 1)::double, split_part(t, '^', 2)::double) else try_cast(t as double) end) x from u group by 1)
 select k, len(ms)::int f32, round(log10(1 + x), 6) f31 from m left join n using (k)""")
def constraint_features(spark, sf_dir):
    found = features.constraint_columns(F.col("view.nl_view"), L.CONSTRAINTS)
    return views(spark, sf_dir).select("k", found["F32"].alias("f32"), F.round(found["F31"], 6).alias("f31"))


_JOINED = "cj as (select k, string_agg(x, chr(10) order by i) c, sum((trim(x) <> '')::int) f33 from vl where code and not f group by 1)"
_KEYWORDS = " + ".join("len(regexp_extract_all(c, '(?i)(?:^|[^\\p{L}\\p{N}_])" + k.replace("|", "\\|").replace("?", "\\?") + "(?:[^\\p{L}\\p{N}_]|$)'))" for k in L.BRANCHES if k not in ("&&", "||", "?")) + " + len(regexp_extract_all(c, '&&')) + len(regexp_extract_all(c, '\\|\\|')) + len(regexp_extract_all(c, '\\?'))"


#: The Python block parses, as does a lone assignment: a decision for each for, if and while, depth by the loops around. The other does not: keywords, depth by braces.
@query(f"""with {_VIEW}, {_JOINED}, inl as (select k, i, length(regexp_extract(x, '^( *)', 1)) d, regexp_matches(x, '^ *(for|while) ') lp from vl where code and not f and trim(x) <> ''),
 d as (select k, sum((select count(*) from inl o where o.k = q.k and o.lp and o.i <= q.i and (o.i = q.i or o.d < q.d and not exists (select 1 from inl m where m.k = q.k and m.i > o.i and m.i < q.i and m.d <= o.d)))) py from inl q where lp group by 1),
 br as (select k, i, x, sum(len(regexp_extract_all(x, '\\{{')) - len(regexp_extract_all(x, '\\}}'))) over (partition by k order by i) lv from vl where code and not f),
 bd as (select k, sum(len(regexp_extract_all(x, '(?i)\\b(?:for|while|foreach)\\b')) * greatest(0, lv - len(regexp_extract_all(x, '\\{{')))) br from br group by 1)
 select k, f33::int f33, case when c like '%range%' then 1 + len(regexp_extract_all(c, '(?:^|\\n) *(?:for|if|while) ')) else 1 + {_KEYWORDS} end::int f34, case when c like '%range%' then py when contains(c, '{{') then br else 0 end::int f35, (not contains(c, '{{'))::int code_parse_exact from cj left join d using (k) join bd using (k)""")
def code_features(spark, sf_dir):
    rows = features.text_features(views(spark, sf_dir)).where("code_detected = 1")
    return rows.select("k", *(F.col(c).alias(c.lower()) for c in ("F33", "F34", "F35", "code_parse_exact")))


@query(f"with {_VIEW}, {_option_sql('ln')} select k, (k in (select k from op))::int mcq_detected, (k in (select k from vl where code))::int code_detected, (len(regexp_extract_all(v, '(?i)(\\b[nmkq]\\s*(<=|≤|<)|\\b1\\s*≤\\s*[nmkq]\\s*≤|\\b(up to|at most))\\s*[0-9]')) > 0)::int input_size_detected, (len({sentence_sql('v')}) >= 2)::int multi_segment from vw")
def indicators(spark, sf_dir):
    return features.text_features(views(spark, sf_dir)).select("k", "mcq_detected", "code_detected", "input_size_detected", "multi_segment")


@query(f"with {_VIEW}, a as (select k, {_WORDS('v')} w, greatest(1, len({sentence_sql('v')})) s from vw) select k, len(w)::int f01, round(len(w) / s::double, 6) f02, round(list_sum(list_transform(w, lambda x: length(x))) / greatest(1, len(w))::double, 6) f03, round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(1, len(w))::double, 6) f04 from a")
def question_lexical(spark, sf_dir):
    return _rounded(features.text_features(views(spark, sf_dir)).withColumn("F01", F.col("F01").cast("int")), "F01", "F02", "F03", "F04")


@query(f"with {_VIEW}, {_option_sql('ln')}, c as (select k, 'question' role, 1 n from vw union all select k, 'option', count(*) from op group by 1, 2 union all select k, 'stem', 1 from op group by 1, 2 union all select k, 'sentence', least(40, len({sentence_sql('v')})) from vw) select k, role, n::bigint n from c where n > 0")
def embedding_units(spark, sf_dir):
    rows = views(spark, sf_dir).withColumnRenamed("k", "question_id")
    return embeddings.units(rows).groupBy(F.col("question_id").alias("k"), "role").agg(F.count("*").alias("n"))


@query(f"with {_VIEW} select k, sha256(k || '|question|' || sha256(v) || '|m|r|256') cache_key from vw")
def embedding_cache_keys(spark, sf_dir):
    rows = embeddings.units(views(spark, sf_dir).withColumnRenamed("k", "question_id")).where("role = 'question'")
    return rows.select(F.col("question_id").alias("k"), embeddings.cache_key("question_id", "m", "r").alias("cache_key"))


@query(None)
def question_feature_table(spark, sf_dir):
    """All features of all questions; tests compare single families."""
    rows = cut(views(spark, sf_dir).withColumn("question_id", F.col("k").cast("string")), "question-views")
    fitted = features.fit(rows)
    return features.extract(rows, fitted).drop("code_detection_tiers")


# --- supplied parses and vectors ----------------------------------------------------------------


_TOKENS = "select l_orderkey question_id, l_linenumber // 4 sent_no, l_linenumber i, case l_linestatus when 'F' then 'Not' else 'word' end as text, case l_returnflag when 'A' then 'Root' when 'R' then 'neg' else 'obj' end dep, case when l_linenumber >= 4 then case when l_linenumber > 5 then l_linenumber - 2 else 4 end else greatest(1, l_linenumber - 1) end head_i, l_quantity > 40 is_punct, l_quantity < 3 is_space from (select l_orderkey, l_linenumber, min(l_linestatus) l_linestatus, min(l_returnflag) l_returnflag, min(l_quantity) l_quantity from lineitem group by 1, 2)"


def parses(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Line items as parsed tokens, orders as texts; noun phrases by quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("i")).agg(F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("r"), F.min("l_quantity").alias("n"))
    i = F.col("i")
    head = F.when(i >= 4, F.when(i > 5, i - 2).otherwise(4)).otherwise(F.greatest(F.lit(1), i - 1))
    tokens = rows.select(
        "question_id", F.floor(i / 4).alias("sent_no"), "i", F.when(F.col("s") == "F", "Not").otherwise("word").alias("text"),
        F.when(F.col("r") == "A", "Root").when(F.col("r") == "R", "neg").otherwise("obj").alias("dep"), head.alias("head_i"), (F.col("n") > 40).alias("is_punct"), (F.col("n") < 3).alias("is_space"),
    )
    return tokens, rows.where("n > 20").select("question_id", i.alias("start"), (i + F.floor(F.col("n") % 4) + 1).alias("end"))


@query(f"""with recursive t as ({_TOKENS}), up as (select question_id, sent_no, i, head_i above, (head_i <> i)::int d from t union all select up.question_id, up.sent_no, up.i, t.head_i, up.d + 1 from up join t on t.question_id = up.question_id and t.sent_no = up.sent_no and t.i = up.above and t.head_i <> t.i),
 f11 as (select question_id, max(d) f11 from up group by 1), s as (select question_id, sent_no, count(*) n, sum(abs(i - head_i)) r, sum((i <> head_i)::int) b from t group by 1, 2), f12 as (select question_id, avg(r / (n - 1)::double) f12 from s where n >= 2 and b >= 1 group by 1),
 ch as (select l_orderkey question_id, avg(floor(n % 4) + 1) f10 from (select l_orderkey, l_linenumber, min(l_quantity) n from lineitem group by 1, 2) where n > 20 group by 1)
 select question_id, sum((lower(dep) in ('root', 'ccomp', 'xcomp', 'advcl', 'relcl', 'acl', 'csubj', 'csubjpass'))::int)::bigint f09, round(coalesce(any_value(f10), 0), 6) f10, any_value(f11)::int f11, round(any_value(f12), 6) f12, sum((dep = 'neg' or lower(text) in ('no', 'not', 'never', 'none', 'neither', 'nor', 'without', 'cannot', 'unless', 'except'))::int)::bigint f13
 from t left join f11 using (question_id) left join f12 using (question_id) left join ch using (question_id) group by 1""")
def syntax_features(spark, sf_dir):
    found = syntax.features(*parses(spark, sf_dir))
    return found.select("question_id", F.col("F09").alias("f09"), F.round("F10", 6).alias("f10"), F.col("F11").alias("f11"), F.round("F12", 6).alias("f12"), F.col("F13").alias("f13"))


@query(f"select question_id, count(*) n from ({_TOKENS}) where not is_punct and not is_space group by 1")
def parser_tokens(spark, sf_dir):
    return syntax.word_tokens(parses(spark, sf_dir)[0]).groupBy("question_id").agg(F.count("*").alias("n"))


def unit_vectors(spark, sf_dir) -> DataFrame:
    """Ten vectors a text: a stem, four options, five sentences."""
    e = table(spark, sf_dir, "embeddings")
    at = F.col("vec_id") % 10
    role = F.when(at == 0, "stem").when(at < 5, "option").otherwise("sentence")
    pos = F.when(at == 0, 0).when(at < 5, at - 1).otherwise(at - 5).cast("int")
    return e.select(F.floor(F.col("vec_id") / 10).alias("question_id"), role.alias("role"), pos.alias("pos"), "embedding")


@query("""with u as (select vec_id // 10 question_id, vec_id % 10 a, embedding::double[] e from embeddings),
 f21 as (select o.question_id, avg(list_cosine_similarity(o.e, s.e)) x from u o join u s on s.question_id = o.question_id and s.a = 0 where o.a between 1 and 4 group by 1),
 f22 as (select p.question_id, avg(list_cosine_similarity(p.e, q.e)) x from u p join u q on q.question_id = p.question_id and p.a < q.a where p.a between 1 and 4 and q.a between 1 and 4 group by 1),
 f29 as (select p.question_id, avg(list_cosine_similarity(p.e, q.e)) x from u p join u q on q.question_id = p.question_id and p.a < q.a where p.a > 4 group by 1)
 select i.question_id, round(f21.x, 6) f21, round(f22.x, 6) f22, round(f29.x, 6) f29 from (select distinct question_id from u) i left join f21 using (question_id) left join f22 using (question_id) left join f29 using (question_id)""")
def unit_similarities(spark, sf_dir):
    found = embeddings.similarities(unit_vectors(spark, sf_dir))
    return found.select("question_id", *(F.round(c, 6).alias(c.lower()) for c in ("F21", "F22", "F29")))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_to_next(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
