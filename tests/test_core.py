"""Core queries against SQL, and the hand-checked cases."""

import math
import random
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill import lexicons as L
from corpusmill.functions import text as T
from corpusmill.operators import features, metrics, neardup, records, splits, transform
from corpusmill.operators.graph import connected_components
from corpusmill.plans import queries as core
from corpusmill.sources import json_records
from corpusmill.streaming import scoring

SF = "/root/testdata/sf0.001"


def plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = core.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(core.ORACLE_SQL[name]).df()
    assert sorted(want.columns) == cols
    assert plain(got.select(*(F.col(f"`{c}`") for c in cols)).collect()) == plain(want[cols].itertuples(index=False))


def test_lexical_values(spark):
    r = features.lexical(spark.createDataFrame([(1, "one four"), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert tuple(r[0]) == (1, 2, 3.5, 1.0)
    assert [tuple(x)[1:] for x in r[1:]] == [(0, 0.0, 0.0)] * 2


def test_phrases_and_numbers(spark):
    df = spark.createDataFrame([("a Binary  search tree, treetop; recursion recursion",), ("use segment_tree, max flow",), (None,)], "q string")
    r = df.select(T.distinct_phrases("q", L.CONCEPTS).alias("a"), T.weighted_phrase_max("q", L.ALGORITHMS).alias("b"), T.phrase_occurrences("q", ("recursion",)).alias("c")).collect()
    assert [tuple(x) for x in r] == [(3, 3, 2), (0, 5, 0), (0, 0, 0)]
    n = spark.createDataFrame([("10^6",), ("1e6",), ("1,000,000",)], "x string").select(T.number(F.col("x"))).collect()
    assert [x[0] for x in n] == [1e6] * 3


def test_reject_order_and_ratio(spark):
    rows = records.with_reason(spark.createDataFrame([("", "easy"), ("x" * 20001, "none"), ("q", None), ("q", "\t VERY-hard\u00a0"), ("\t\n", "easy")], "question string, raw_label string"))
    got = rows.select("reason", "label").collect()
    assert [r["reason"] for r in got] == ["missing_question", "oversized", "unknown_label", None, "missing_question"]
    assert got[3]["label"] == "Hard"
    with pytest.raises(ValueError):
        records.check_reject_ratio(rows)


def test_conflicting_duplicates_go(spark):
    rows = spark.createDataFrame([("Straße  a", "Easy", "2"), ("STRASSE A", "Easy", "1"), ("b", "Easy", "3"), ("B ", "Hard", "4")], "question string, label string, id string")
    kept = records.deduplicate(records.with_identity(rows, supplied="id"))
    assert [r["question_id"] for r in kept.collect()] == ["1"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}


def test_families_of_copies(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "The  quick brown fox"), (3, "something else entirely"), (4, None)], "id long, t string")
    assert {tuple(r) for r in neardup.families(rows, "id", "t").collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_document_families_are_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(120):  # six texts and copies of them with ever more words changed
        words = [f"w{i % 6}{k}" for k in range(150)]
        for at in rng.sample(range(150), i // 6):
            words[at] = f"x{rng.random()}"
        texts[i] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sketch = {r["id"]: bytes(r["sig"]) for r in neardup.sketches(rows, "doc_id", "text").collect()}
    by_i = neardup.signatures(rows.where("doc_id < 2"), "doc_id", "text").collect()
    assert all(sketch[r["id"]][8 * r["i"] : 8 * r["i"] + 8].hex() == r["h"] for r in by_i) and len(by_i) == 256
    family, edges = {i: i for i in texts}, 0
    for a in texts:
        for b in range(a):
            if sum(sketch[a][k : k + 8] == sketch[b][k : k + 8] for k in range(0, 1024, 8)) >= 0.85 * 128:
                edges += texts[a] != texts[b]
                x, y = sorted((family[a], family[b]))
                family = {k: x if f == y else f for k, f in family.items()}
    got = {r["id"]: r["family"] for r in neardup.families(rows, "doc_id", "text").collect()}
    assert edges > 20 and got == family


def test_shingles_of_any_text(spark):
    texts = ["", "a", "abcd", "abcde", "abcdef" * 9, None, "  \t ", "Ĳ ﬁ ẞ 𝒳𝒴" * 3, "\U0001f600" * 7, "word " * 50, "ß" * 4]
    texts += ["".join(random.Random(7).choices("abcdefgh ", k=400_000))]  # the time of a text grew with the square of its length
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, "zzzzzzzz")], "id long, t string")
    want = [len(neardup._pieces(T.normal_form(t or ""))) for t in texts]
    want[0] += 1  # rows of one key are added up
    assert sorted(map(tuple, neardup.shingle_counts(rows, "id", "t").collect())) == list(enumerate(want))
    assert sorted(map(tuple, neardup.shingles(rows, "id", "t").groupBy("id").count().collect())) == list(enumerate(want))


def test_signatures_hash_a_shingle_once(monkeypatch):
    """A corpus with more shingles than a worker kept, read twice; few kept, the values stay."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(9000)]
    texts = [" ".join(rng.choices(words, k=n)) for n in [0, 1, 3, 20, 90, 400, 3000, 9000] for _ in range(3)] + ["abc " * 2000, "é" * 3, "x" * 5000]
    plain = [[min(int(neardup.hashlib.sha256(f"42|{i}|{p}".encode()).hexdigest()[:16], 16) for p in neardup._pieces(t)) for i in range(4)] for t in texts]
    neardup._known.cache_clear()
    assert neardup._signatures(texts, 4).tolist() == plain
    assert len(neardup._known(4).ids) > 30_000
    with monkeypatch.context() as m:
        m.setattr(neardup, "_hashed", None)
        assert neardup._signatures(texts, 4).tolist() == plain
    monkeypatch.setattr(neardup, "KNOWN", 500)
    monkeypatch.setattr(neardup, "STEP", 2000)
    neardup._known.cache_clear()
    for _ in range(2):
        assert neardup._signatures(texts, 4).tolist() == plain
    neardup._known.cache_clear()


def test_signatures_of_known_shingles_take_less_than_cutting_them():
    """Texts whose shingles a worker knows are gone through by array, not by shingle."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü\u4e2d\U0001f600", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([200, 1000, 4000]))) for _ in range(60)]

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    neardup._signatures(texts, 128)
    assert seconds(lambda: neardup._signatures(texts, 128)) < 0.4 * seconds(lambda: [neardup._pieces(t) for t in texts])
    neardup._known.cache_clear()


def test_signatures_of_short_texts_hash_what_is_not_known(monkeypatch):
    """Shingles that longer texts had are not hashed again for short ones but for the minima that are still large."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdef", k=7)) for _ in range(2000))
    short = [long[k : k + n] for k, n in [(0, 5), (9, 6), (50, 30), (200, 60), (400, 100), (700, 128)]] + ["abcd", "", "中文" * 3, "\0" * 6, "\U0010ffff" * 7]
    plain = [[min(int(neardup.hashlib.sha256(f"42|{i}|{p}".encode()).hexdigest()[:16], 16) for p in neardup._pieces(t)) for i in range(128)] for t in short]
    neardup._known.cache_clear()
    neardup._hashes.cache_clear()
    neardup._signatures([long], 128)
    made, sha = [], neardup.hashlib.sha256
    monkeypatch.setattr(neardup.hashlib, "sha256", lambda b: made.append(b) or sha(b))
    assert neardup._signatures(short[:6], 128).tolist() == plain[:6]
    assert len(made) < 128 * sum(len(neardup._pieces(t)) for t in short[:6]) / 8
    assert neardup._signatures(short, 128).tolist() == plain
    neardup._known.cache_clear()


def test_families_are_linked_across_buckets(spark):
    """Chains whose ends are far from each other, in and beside a crowd that shares parts of every text."""
    rng = random.Random(11)
    crowd = [f"c{k}" for k in range(300)]
    texts = {}
    for i in range(90):
        own = [f"o{i // 9}{k}" for k in range(120)]
        for at in range(i % 9):  # each changes a few words more than the one before
            own[at * 4 : at * 4 + 3] = [f"x{i // 9}{at}{k}" for k in range(3)]
        texts[rng.random()] = " ".join(crowd + own)
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(t for _, t in sorted(texts.items()))], "id long, t string")
    sketch = {r["id"]: bytes(r["sig"]) for r in neardup.sketches(rows, "id", "t").collect()}
    family = {i: i for i in sketch}
    for a in sketch:
        for b in range(a):
            if sum(sketch[a][k : k + 8] == sketch[b][k : k + 8] for k in range(0, 1024, 8)) >= 0.85 * 128:
                x, y = sorted((family[a], family[b]))
                family = {k: x if f == y else f for k, f in family.items()}
    assert 1 < len(set(family.values())) < 90
    assert {r["id"]: r["family"] for r in neardup.families(rows, "id", "t").collect()} == family


def test_pieces_looked_up_hold_every_near_pair():
    """Fewer and longer ones than bands where those find all near pairs, else the bands."""
    bounds = neardup._bounds(128, 32, 19)
    assert len(bounds) == 20 and [k for lo, hi in bounds for k in range(lo, hi)] == list(range(128))
    assert neardup._bounds(16, 4, 8) == [(0, 4), (4, 8), (8, 12), (12, 16)]


def test_document_families_of_the_corpus(spark):
    rows = core.document_families(spark, SF).collect()
    assert len(rows) == core.table(spark, SF, "documents").count() > len({r["family"] for r in rows})


def test_sentences(spark):
    texts = ["See Dr. Smith, e.g. Today. It rains! 4 drops? yes\nnew line.\n\n(ok). \"So\" it ends.", "a.b. c", "", None, "One. Two etc. Three"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.sentences(F.col("t"))).collect()]
    assert got == [["See Dr. Smith, e.g. Today.", "It rains!", "4 drops? yes", "new line.", "(ok).", '"So" it ends.'], ["a.b. c"], [], [], ["One.", "Two etc. Three"]]


def test_options(spark):
    texts = ["Stem\n(A) x\n(B) y y\n(C) z", "1. a\n3. b", "A) x\n\nB) y", "Option a x\noption B y", "1. q\n2) r\nb. s", None, "A)\tx\t\n\tB)\ty", "c) p\nd) q", "a: x\nb: y"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.options(F.col("t"))).collect()]
    assert got == [["x", "y y", "z"], [], [], [], ["q", "r"], [], ["x", "y"], ["p", "q"], []]


def test_split_is_the_plain_fold(spark):
    rows = core.split_assignment(spark, SF).collect()
    o = core.table(spark, SF, "orders").select("o_orderkey", "o_custkey").collect()
    by_family = {}
    for r in o:
        by_family.setdefault(r["o_custkey"], []).append(r["o_orderkey"] % 3)
    due = {c: sum(x["o_orderkey"] % 3 == c for x in o) for c in range(3)}
    got, have, want = dict.fromkeys(((s, c) for s in range(3) for c in range(3)), 0), [0] * 3, {}
    for f in sorted(by_family):
        labels = by_family[f]
        c = max(range(3), key=lambda k: (labels.count(k), k))
        to = min(range(3), key=lambda s: (-(splits.RATIOS[s] * due[c] - got[s, c]) / (splits.RATIOS[s] * due[c]), -(splits.RATIOS[s] * len(o) - have[s]) / (splits.RATIOS[s] * len(o)), s))
        got[to, c] += len(labels)
        have[to] += len(labels)
        want[f] = splits.SPLITS[to]
    assert {r["family"]: r["split"] for r in rows} == want
    assert abs(sum(splits.check_ratios(core.split_assignment(spark, SF), most_off=0.1).values()) - 1) < 1e-9


def test_fingerprint_has_no_order(spark):
    rows = spark.range(50).select(F.sha2(F.col("id").cast("string"), 256).alias("raw_hash"))
    assert splits.fingerprint(rows).first() == splits.fingerprint(rows.orderBy(F.desc("raw_hash")).repartition(3)).first()
    assert splits.fingerprint(rows).first() != splits.fingerprint(rows.limit(49)).first()
    assert splits.fingerprint(rows.where("false")).first()["n"] == 0


def test_stream_equals_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"question_id": "1", "question": "Sort the array. Pick:\\nA) x\\nB) y"}\n{"question_id": "2"}\n')
    scoring.score_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = scoring.question_features(spark.read.schema("question_id string, question string").json(str(tmp_path / "in")))
    assert sorted(spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).collect(), key=str) == sorted(batch.collect(), key=str)
    assert {r["question_id"]: r["f18"] for r in batch.collect()} == {"1": 2, "2": 0}


def test_run_order(spark):
    runs = spark.createDataFrame([(0, "b", 0.5, 0.3, 0.5), (1, "a", 0.5, 0.3, 0.5), (2, "c", 0.4, 0.1, 0.9)], "step int, run_id string, macro_f1 double, ordinal_mae double, balanced_accuracy double")
    assert metrics.best_run(runs).first()["run_id"] == "a"
    assert [(r["over_first"], r["over_previous"]) for r in metrics.ladder_deltas(runs).orderBy("step").collect()] == [(0.0, None), (0.0, 0.0), (-0.1, -0.1)]


def test_metrics_of_one_class(spark):
    r = metrics.summary(spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")).first()
    assert (r["kappa"], r["accuracy"], r["balanced_accuracy"]) == (1.0, 1.0, 1.0)


def test_impute_and_select(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (None, 4.0, 5.0), (3.0, 6.5, 5.0), (float("nan"), 8.0, 5.0)], "a double, b double, c double")
    full = transform.impute(df, df, ["a"])
    assert [r["a"] for r in full.collect()] == [1.0, 2.0, 3.0, 2.0]
    assert transform.uncorrelated(full, ["b", "a", "c"]) == ["b", "a"]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q", "label": 1}\n\nnot json\n{"question": "r"\n')
    (tmp_path / "b.json").write_text('[{"question": "q", "label": "1"}]')
    got = json_records.read_records(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [(r["line"], r["reason"]) for r in got] == [(1, None), (3, "malformed_json"), (4, "malformed_json")]
    assert [r["raw_label"] for r in json_records.read_records(spark, str(tmp_path / "b.json")).collect()] == ["1"]
