"""Views, code, tasks, schema and configuration on cases worked out by hand, and odd input."""

import ast
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import config, files, inference, registry
from corpusmill import lexicons as L
from corpusmill.functions import code, views
from corpusmill.functions import text as T
from corpusmill.operators import embeddings, features, quantiles, records, syntax, transform
from corpusmill.sources import json_records


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}").orderBy("i").select(f(F.col("t"))).collect()]


def test_case_folding(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁ", "İ", "ŉ", "plain", "", None, "Ꭰ"]
    assert column(spark, texts, T.fold) == [None if t is None else t.casefold() for t in texts]


def test_lines_and_strip(spark):
    texts = ["a\r\nb\rc\n\nd\n", "", None, "x\u2028y\x0bz", "\n"]
    assert column(spark, texts, T.lines) == [(t or "").splitlines() for t in texts]
    assert column(spark, ["\t a\u00a0\u3000\n", " "], T.strip) == ["a", ""]


def test_enumerators(spark):
    texts = ["(a) one\n(c) three\n", "(a) one\n(b) two\n", "1. one\n2. two\n", "(i) x\n(ii) y\n(iii) z", "(iv) x\n(v) y", "1) a\n\n2) b\n3) c", "(h) p\n(i) q", None]
    assert column(spark, texts, lambda t: T.enumerated(T.lines(t))) == [0, 2, 2, 2, 0, 2, 2, 0]
    assert column(spark, ["why? how? (a)", None], features.subquestion_count) == [1, 0]


def test_constraint_notations(spark):
    texts = ["n <= 10^6", "N <= 1E6", "n<1,000,000", "Up to 1_0 and AT MOST 7", "1 ≤ n ≤ 10^5", "k <= 0^-1", "m < 9^999", "none", None]
    got = column(spark, texts, lambda t: F.array_max(T.constraint_values(T.constraint_matches(t))))
    assert got == [1e6, 1e6, 1e6, 10.0, 1e5, None, None, None, None]
    assert column(spark, texts, lambda t: F.size(T.constraint_matches(t))) == [1, 1, 1, 2, 2, 1, 1, 0, 0]


def test_normal_form():
    assert views.normalised("  A  question.\r\n\r\n\r\nB!  ") == "A  question.\n\nB!"
    assert views.normalised("ﬁ x \n y\u00a0\n") == "fi x\n y"


def test_code_tiers():
    import re

    signatures = [re.compile(p) for p in L.CODE_SIGNATURES]
    found = lambda t: views.code_tiers(t.splitlines(), signatures)
    assert found("a\n```\nx\n```\nb") == [(1, 4, "fenced")]
    assert found("```\nnever closed") == [] and found("~~~\nx\n```\n~~~") == [(0, 4, "fenced")]
    block = "    def f():\n    a\n    b\n    c"
    assert found(f"t\n{block}\nu") == [(1, 5, "indented")] and found(block.replace("def f():", "words")) == []
    assert found("    def f():\n    a\n    b") == [(0, 1, "signature")]
    assert found("x = y;\n```\nz\n```") == [(0, 4, "signature")]
    assert views.code_text(["```py", "", "x", "```"], 0, 4, "fenced") == "x"
    assert views.code_text(["\tif a:", "    b"], 0, 2, "indented") == "if a:\nb"


def test_views(spark):
    rows = spark.createDataFrame([(1, "Look:\n```python\nx\n```\nWhat is $x^2$?\nA) p\nB) q"), (2, None), (3, "")], "k int, question string")
    v = {r["k"]: r["view"] for r in views.with_views(rows).collect()}
    assert v[1]["nl_view"] == "Look:\n \n \n \nWhat is  MATHEXPR ?\nA) p\nB) q" and v[1]["nl_stem"] == "Look:\n \n \n \nWhat is  MATHEXPR ?"
    assert v[1]["options"] == ["p", "q"] and (v[1]["option_start"], v[1]["option_end"]) == (5, 7) and v[1]["code_spans"] == ["x"]
    assert v[2]["nl_view"] == v[3]["nl_view"] == "" and v[2]["sentences"] == [] and v[2]["option_start"] is None
    assert features.views_of(rows).count() == 3
    with pytest.raises(ValueError):
        features.views_of(rows, preprocess={"max_chars": 5})


def test_math_over_lines_moves_options(spark):
    # options are found in the text before formulas are masked, and their line numbers are kept
    rows = spark.createDataFrame([("$a\nb$\nstem\nA) p\nB) q",)], "question string")
    view = views.with_views(rows).first()["view"]
    assert view["options"] == ["p", "q"] and view["nl_stem"].split("\n")[:3] == ["MATHEXPR ", "stem", "A) p"]


def test_complexity_of_code():
    nested = "for i in range(3):\n    for j in range(2):\n        print(i, j)"
    assert code.complexity(nested) == (3, 3, True)
    assert code.complexity("def f(n):\n    return f(n - 1) if n else [x for x in y if x and z]") == (4, 2, True)
    assert code.complexity("for (;;) {\n while (a || b) { }\n}") == (4, 0, False)
    assert code.complexity("else if (x)") == (3, 0, False)  # counts under both keywords
    assert code.complexity("\tfor x\n        foreach y!") == (2, 3, False)
    assert code.complexity("a\0b")[2] is False
    assert code.complexity("x = " + "-" * 100000 + "1")[2] is False
    ast.parse(nested)


def test_question_and_instruction_types(spark):
    ask = lambda t: features.question_type(t, T.sentences(t))
    texts = ["Why define and then evaluate this?", "Is it so?", "Tell me how. Where?", "Is it how", "State it.", "", None, "The whatever"]
    assert column(spark, texts, ask) == ["Why", "YesNo", "Where", "How", "Other", "Other", "Other", "Other"]
    lemmas = [["why", "define", "evaluate"], ["x"], []]
    assert column(spark, lemmas, lambda w: features.instruction_type(w, L.TASKS), "array<string>") == ["Define", "Other", "Other"]
    assert column(spark, lemmas, lambda w: features.cognitive_demand(w, L.BLOOM), "array<string>") == [5, 1, 1]


def test_missing_is_not_zero(spark):
    rows = views.with_views(spark.createDataFrame([("1", "Plain words here.")], "question_id string, question string"))
    fitted = features.fit(rows)
    r = features.extract(rows, fitted).first()
    assert (r["F18"], r["F32"], r["F25"], r["F30"], r["code_detected"], r["parse_ok"]) == (0, 0, 0, 0, 0, 0)
    assert all(r[f] is None for f in ("F06", "F09", "F19", "F20", "F21", "F23", "F24", "F29", "F31", "F33", "F34", "F35"))
    off = features.extract(rows, fitted, switches={f"use_{f}": False for f in registry.FAMILIES}).first()
    assert (off["F14"], off["F15"], off["F16"], off["F17"], off["F18"], off["F25"]) == ("Other", "Other", 1, 0, 0, 0) and off["F01"] is None and off["F32"] is None


def test_held_out_rows_change_no_fit(spark):
    rows = [(str(i), f"alpha beta w{i % 7} the term{i % 3}", "train" if i < 30 else "test") for i in range(40)]
    noisy = [(i, t if s == "train" else "zzz " * 50, s) for i, t, s in rows]
    fits = []
    for data in (rows, noisy):
        v = views.with_views(spark.createDataFrame(data, "question_id string, question string, split string"))
        f = features.fit(v.where("split = 'train'"))
        fits.append((sorted(map(tuple, f.rare_df.collect())), sorted(map(tuple, f.tfidf.vocabulary.collect())), f.tfidf.threshold))
    assert fits[0] == fits[1]


def test_quantiles_are_numpy(spark):
    rng = np.random.default_rng(4)
    sets = {"a": rng.normal(size=9000).tolist(), "b": [5.0] * 50 + [7.0], "c": [1e300, -1e300, 1e-300, 0.0], "d": [float("nan")] * 3, "e": rng.integers(0, 3, 6000).astype(float).tolist()}
    rows = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "name string, value double")
    for share in (0.0, 0.5, 0.9, 1.0):
        got = quantiles.exact_quantiles(rows, dict.fromkeys([*sets, "none"], share))
        assert got["d"] is None and got["none"] is None
        assert all(np.isclose(got[k], np.quantile(sets[k], share), rtol=1e-12, atol=0) for k in "abce")


def test_components_are_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "i int, embedding array<double>")
    model = transform.fit_components(rows, "embedding", 3)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    signs = np.sign(v[np.arange(3), np.abs(v[:3]).argmax(axis=1)])
    got = model(rows).orderBy("i").collect()
    assert np.allclose([list(r)[2:] for r in got[:60]], (u * s)[:, :3] * signs) and list(got[60])[2:] == [None] * 3
    assert np.allclose(model.ratios, (s**2 / (s**2).sum())[:3])
    with pytest.raises(ValueError):
        transform.fit_components(rows.where("i < 2"), "embedding", 3)


def test_selector_and_finite(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i + (i == 3), 1.0, float(i * i % 7)) for i in range(20)], "a double, b double, c double, d double")
    assert transform.uncorrelated(rows, ["a", "b", "c", "d"]) == ["a", "d"]
    with pytest.raises(ValueError):
        transform.uncorrelated(rows, ["c"])
    transform.check_finite(rows, ["a"])
    with pytest.raises(ValueError):
        transform.check_finite(rows.withColumn("a", F.lit(float("inf"))), ["a"])


def test_syntax_of_a_parse(spark):
    # two sentences: a chain of four and a lone word; a broken head counts as its own
    rows = [("q", 0, 0, "Do", "neg", 1), ("q", 0, 1, "run", "ROOT", 1), ("q", 0, 2, "n't", "aux", 1), ("q", 0, 3, "x", "ccomp", 2), ("q", 1, 4, "Yes", "ROOT", 4), ("r", 0, 0, "y", None, None)]
    tokens = spark.createDataFrame([(*r, False, False) for r in rows], "question_id string, sent_no int, i int, text string, dep string, head_i int, is_punct boolean, is_space boolean")
    chunks = spark.createDataFrame([("q", 0, 1), ("q", 2, 5)], "question_id string, start int, `end` int")
    got = {r["question_id"]: tuple(r)[1:] for r in syntax.features(tokens, chunks).collect()}
    assert got == {"q": (3, 2.0, 2, 1.0, 2), "r": (0, 0.0, 0, None, 0)}
    assert syntax.word_tokens(tokens.withColumn("text", F.lit("--"))).count() == 0


def test_encoder_behind_its_cache(spark, tmp_path):
    units = spark.createDataFrame([("a", "question", 0, "xx"), ("a", "option", 0, "y"), ("b", "question", 0, "xx")], "question_id string, role string, pos int, text string")
    encoder = lambda texts: np.array([[len(t), 1.0] for t in texts])
    cache = str(tmp_path / "cache")
    first = {tuple(r)[:3]: r["embedding"] for r in embeddings.encode(units, encoder, cache).collect()}
    assert len(first) == 3 and np.allclose(np.linalg.norm(list(first.values()), axis=1), 1)
    broken = lambda texts: 1 / 0
    assert {tuple(r)[:3]: r["embedding"] for r in embeddings.encode(units, broken, cache).collect()} == first


def test_json_input(spark, tmp_path):
    lines = [{"question": "Q1?", "label": "Easy"}, {"question": "Q2?", "label": 2, "question_id": 0}, {"question": 5, "label": "Easy"}, [1], "x", None, {"question": "Q", "label": True, "question_id": "i"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\t \n{bad\n")
    (tmp_path / "b.json").write_text(" \n" + json.dumps(lines))
    a, b = (json_records.read_records(spark, str(tmp_path / n)).orderBy("line").drop("record").collect() for n in ("a.jsonl", "b.json"))
    assert [tuple(r) for r in b] == [(1, "Q1?", "Easy", None, None), (2, "Q2?", "2", None, None), (3, None, "Easy", None, None), (4, None, None, None, "malformed_record"), (5, None, None, None, "malformed_record"), (6, None, None, None, "malformed_record"), (7, "Q", None, "i", None)]
    assert a[:7] == b and tuple(a[7]) == (9, None, None, None, "malformed_json")
    (tmp_path / "empty.jsonl").write_text("")
    assert json_records.read_records(spark, str(tmp_path / "empty.jsonl")).count() == 0
    (tmp_path / "bytes.jsonl").write_bytes(b'{"question": "\xff"}\n')
    with pytest.raises(Exception, match="encoding_error"):
        json_records.read_records(spark, str(tmp_path / "bytes.jsonl")).collect()
    (tmp_path / "broken.json").write_text('[{"question": 1}, ')
    with pytest.raises(Exception):
        json_records.read_records(spark, str(tmp_path / "broken.json")).collect()
    with pytest.raises(json_records.IngestError, match="missing_corpus"):
        json_records.read_records(spark, str(tmp_path / "none.jsonl"))


def test_line_numbers_of_many_blocks(spark, tmp_path):
    rng = random.Random(1)
    texts = [json.dumps({"question": "q" * rng.randint(1, 40), "label": i}) if i % 5 else "" for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(texts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        got = json_records.read_records(spark, str(tmp_path / "a.jsonl")).select("line", "raw_label").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["line"], r["raw_label"]) for r in got} == {(i + 1, str(i)) for i in range(3000) if i % 5}


def test_gates(spark):
    rows = spark.createDataFrame([(str(i), ("Easy", "Moderate", "Hard")[i % 3], "train") for i in range(30)], "question_id string, label string, split string")
    assert records.check_training(rows, 30, 10) == {"Easy": 10, "Moderate": 10, "Hard": 10}
    for args in ((31, 1), (1, 11)):
        with pytest.raises(ValueError):
            records.check_training(rows, *args)
    for bad in (rows.where("label <> 'Hard'"), rows.unionByName(rows), rows.withColumn("label", F.lit("odd"))):
        with pytest.raises(ValueError):
            records.check_training(bad, 1, 1)
    with pytest.raises(ValueError):
        records.check_splits(rows)


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("split: {small_dataset_threshold: 9}\ncorpus: {min_records: 3}\n")
    c = config.load(tmp_path / "c.yaml", {"corpus": {"min_records": 4}})
    assert c["split"]["small_dataset_threshold"] == 9 and c["corpus"]["min_records"] == 4 and c["split"]["ratios"] == [0.7, 0.15, 0.15]
    assert config.DEFAULTS["corpus"]["min_records"] == 10000
    bad = [{"split": {"ratios": [0.5, 0.5, 0.5]}}, {"corpus": {"min_records": 0}}, {"dedup": {"near_threshold": 0}}, {"selection": {"correlation_threshold": 1}}, {"ingest": {"max_reject_ratio": 2}}, {"preprocess": {"sentence_abbreviations": [1]}}]
    for override in bad:
        with pytest.raises(ValueError):
            config.load(override=override)
    with pytest.raises(ValueError, match="missing_config_sections"):
        config.validate({})
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "concepts.yaml").write_text("[a, b]")
    lexicons = L.load(tmp_path / "lex")
    assert lexicons.concepts == ["a", "b"] and lexicons.algorithm == L.ALGORITHMS
    (tmp_path / "lex" / "odd.yaml").write_text("[a]")
    with pytest.raises(ValueError):
        L.load(tmp_path / "lex")


def test_schema_hash():
    saved = registry.schema(["F01"], "P4")
    registry.check_schema(saved)
    for change in ({"columns": ["F02"]}, {"extractor_versions": {"FeatureExtractor": "old"}}, {"profile": "P0"}):
        with pytest.raises(ValueError):
            registry.check_schema(saved | change)
    assert registry.active_features("P4", {f"use_{f}": False for f in registry.FAMILIES if f != "lexical"}) == ["F01", "F02", "F03", "F04", "F05"]


def test_profiles():
    assert inference.resolve_profile(True, True, True) == ("P0", [])
    assert inference.resolve_profile(False, True, True, requested="P2")[0] == "BLOCKED"
    assert inference.resolve_profile(False, False, False, requested="P4") == ("P4", [])
    assert inference.resolve_profile(True, True, True, missing=("numpy",)) == ("BLOCKED", ["numpy"])
    with pytest.raises(ValueError):
        inference.resolve_profile(True, True, True, requested="P9")


def test_files(spark, tmp_path):
    folder = str(tmp_path / "run")
    files.write_json(spark, f"{folder}/x/a.json", {"b": 1, "a": "é"})
    files.write_json(spark, f"{folder}/x/a.json", {"b": 2, "a": "é"})
    assert files.read_json(spark, f"{folder}/x/a.json") == {"a": "é", "b": 2} and not (tmp_path / "run" / "x" / "a.json.tmp").exists()
    files.write_bytes(spark, f"{folder}/empty", b"")
    known = {r["path"]: r["sha256"] for r in files.hashes(spark, folder).collect()}
    assert set(known) == {"x/a.json", "empty"}
    files.verify_hashes(spark, folder, known)
    for wrong in ({k: v for k, v in known.items() if k != "empty"}, known | {"more": "0"}, known | {"empty": "0"}):
        with pytest.raises(ValueError):
            files.verify_hashes(spark, folder, wrong)
