"""All ten operators and the pipeline's stages on nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns whose names the code uses itself; and the wrapper's alignment against plain recursion."""

import random
import time
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import chat, html, media, mixing, packing, quality, queries, simhash, tokencount, warc
from corpusmill.session import cut

CLASH = "fp text_hash root component_id key own grp u v star size src place block bits target shards shard shard_order taken row piece start length ids_crc32 copy sequence_id offset bucket bytes x score predicted held_out y media declared n_bytes payload sha kept ordinal file n_tokens host h slots texts common seed alone _kept _rest _score pair_id side part fork role_".split()
LONG = "lorem ipsum dolor " * 60000


def documents(spark, rows=None):
    """Documents with a null, an empty and a very long text, copies, repeated rows, a null id and source, and columns of many names."""
    if rows is None:
        rows = [(i, f"word{i} and some more text number {i % 7} here", f"s{i % 3}") for i in range(40)]
        rows += [(100, None, "s0"), (101, "", None), (102, " \t\n", "s1"), (103, LONG, "s2"), (104, rows[3][1], "s1"), rows[5], rows[5], (None, "no id at all", "s0"), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return frame.withColumns({c: F.lit(7) for c in CLASH})


def labels(spark, rows=((1, 1), (2, 0), (3, 1), (4, 0), (4, None), (5, 9), (999, 1), (None, 1), (103, 0), (6, 1), (7, 0))):
    return spark.createDataFrame([(i, y, 0) for i, y in rows], "doc_id long, quality int, toxic int")


def ids(frame, name="doc_id"):
    return Counter(r[name] for r in frame.collect())


RUNS = {
    "op1": lambda s, d: simhash.near_duplicates(d),
    "op3": lambda s, d: packing.pack_documents(d),
    "op7": lambda s, d: quality.score_documents(d, labels(s)),
    "op8": lambda s, d: media.features(media.as_images(d), ["doc_id", "n_bytes"]),
    "op9": lambda s, d: mixing.mix_report(d),
    "op10": lambda s, d: tokencount.token_counts(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_operators_on_odd_documents(spark, name):
    docs = documents(spark)
    rows = RUNS[name](spark, docs).collect()
    got = Counter(r["doc_id"] for r in rows if name != "op3" or r["piece"] == 0)
    assert got == ids(docs)
    assert RUNS[name](spark, docs.where("false")).count() == 0


def test_op1_odd_values(spark):
    rows = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(documents(spark)).collect()}
    by_id = {i: (f, c) for i, f, c in rows if i is not None}
    zero = min(i for i, (f, _) in by_id.items() if f == 0)
    assert {by_id[i] for i in (100, 101, 102)} == {(0, zero)} and (None, 0, zero) in rows
    assert by_id[104][1] == by_id[3][1] and by_id[104][0] == by_id[3][0]
    nameless = simhash.near_duplicates(documents(spark, [(None, "a b c", "s"), (None, "a b c", "s")]))
    assert [r["component_id"] for r in nameless.collect()] == [None, None]


def test_keep_one_of_repeated_rows(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({r["component_id"] for r in simhash.near_duplicates(docs).select("component_id").collect()})
    assert ids(kept)[5] <= 1 and ids(kept)[104] == 0
    assert sorted(map(str, rows)) == sorted(map(str, simhash.keep_one(docs.repartition(7)).collect()))
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_op3_odd_values(spark):
    docs = documents(spark)
    rows = packing.pack(cut(packing.pieces(docs, keep_ids=True), "odd-pieces")).collect()
    one = [r for r in rows if r["doc_id"] in (100, 101)]
    assert all((r["length"], r["piece"], r["ids"]) == (1, 0, [2]) for r in one)
    assert Counter((r["doc_id"], r["piece"], r["copy"]) for r in rows if r["doc_id"] == 5) == Counter({(5, 0, 1): 1, (5, 0, 2): 1, (5, 0, 3): 1})
    long = sorted((r for r in rows if r["doc_id"] == 103), key=lambda r: r["piece"])
    assert len(long) > 100 and {r["length"] for r in long[1:]} == {1024} and all(len(r["ids"]) == r["length"] for r in long)
    assert len(set((r["sequence_id"], r["offset"]) for r in rows)) == len(rows)


def test_op3_ids_are_those_of_tokenizers():
    """Every code point between letters, digits, spaces and itself; random texts; special tokens; long runs."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k")
    rng = random.Random(3)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{chr(c)}c1 {chr(c)}2{chr(c)}  {chr(c)} {chr(c)}\n{chr(c)}x" for c in points[:: 1 if len(points) < 1000 else 17]]
    texts += ["".join(rng.choice([chr(rng.choice(points)), rng.choice(" \n\t'a1s!"), rng.choice("abcdefgh ZX")]) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += ["<|endoftext|>", " a<|endoftext|>b <|endoftext", "'s 'LL it's", "ab1" * 20000, "!" * 20000, "é" * 20000, " " * 1000000 + "x", ""]
    for t in texts:
        assert fast(t).tolist() == exact.encode(t, add_special_tokens=False).ids, t[:40]


def test_packing_numbers_hot_lengths_in_parts(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(500)], "doc_id long, text string")
    rows = packing.pack(cut(packing.pieces(docs), "hot-pieces"), share=16).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sorted(p) == [(i * p[0][1], p[0][1]) for i in range(len(p))] for p in places.values()) and len(places) == -(-500 * rows[0]["length"] // 1024)


def test_op7_without_enough_labels(spark):
    docs = documents(spark).select("doc_id", "text")
    score = lambda rows: {r["score"] for r in quality.score_documents(docs, labels(spark, rows)).collect()}
    assert score([(1, None)]) == {0.5} and score([(1, 1)]) == {1.0} and score([(2, 0), (3, 0)]) == {0.0}
    assert len(score([(1, 1), (4, 0), (103, 0), (101, 0), (100, 1)])) > 3  # one of each is enough for a graded score
    w = [quality.shrinkage_weight(n, quality.WIDTH) for n in range(1, 4000)]
    assert w[0] == 1 and all(0 < b < a <= 1 and a - b <= 0.3 for a, b in zip(w, w[1:], strict=False))


def test_op9_odd_values(spark):
    rows = mixing.mix_report(documents(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[100]["size"] == by_id[101]["size"] == by_id[102]["size"] == 0 and by_id[103]["size"] == 180000
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0) and by_id[101]["target"] == 0
    twice = [r["taken"] for r in rows if r["doc_id"] == 5]
    assert twice[0] == twice[1]


def test_op2_is_plain_rendering(spark):
    """Offsets, parts and masks against a walk through lists; odd roles, turns, repeats and one-sided pairs."""
    rng = random.Random(4)
    sides = []
    for _ in range(2):
        rows = []
        for key in range(25):
            for turn in range(rng.randint(0, 5)):
                for _ in range(rng.choice([1, 1, 1, 2])):
                    rows.append((key, turn, ["user", "assistant", None][(turn + (rng.random() < 0.1)) % 3], rng.choice(["a", "bb", None, ""]) if turn else "first"))
        sides.append(rows + [(None, 1, "user", "x"), (3, None, "user", "x"), (7, 2, "user", "again"), (7, 2, "user", "again"), (8, 200, "assistant", LONG)])
    frames = [spark.createDataFrame(r, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("side", "block", "n", "start", "h", "src", "at")}) for r in sides]
    got = defaultdict(list)
    for r in chat.format_preferences(*frames).collect():
        got[r["pair_id"]].append(r)
    plain = [defaultdict(lambda: defaultdict(Counter)) for _ in sides]
    for side, rows in zip(plain, sides, strict=True):
        for key, turn, role, text in rows:
            if key is not None and turn is not None:
                side[key][turn][role or "", text or ""] += 1
    assert set(got) == set(plain[0]) | set(plain[1])
    for key, rows in got.items():
        turns = sorted(set(plain[0][key]) | set(plain[1][key]))
        fork = next((t for t in turns if plain[0][key][t] != plain[1][key][t]), None)
        prompt = [r for r in rows if r["part"] == "prompt"]
        size = sum(len(r["segment"]) for r in prompt)
        for part, side, keep in (("prompt", 0, lambda t: fork is None or t < fork), ("chosen", 0, lambda t: fork is not None and t >= fork), ("rejected", 1, lambda t: fork is not None and t >= fork)):
            own = sorted((r for r in rows if r["part"] == part), key=lambda r: r["start"])
            want = [(t, f"<|{role}|>\n{text}<|end|>\n", role) for t in turns if keep(t) for (role, text), n in plain[side][key][t].items() for _ in range(n)]
            assert Counter((r["turn"], r["segment"], r["role"]) for r in own) == Counter(want)
            at = 0 if part == "prompt" else size
            for r in own:
                assert r["start"] == at and r["end"] == at + len(r["segment"])
                trained = part != "prompt" and r["role"] == "assistant"
                assert (r["train_from"], r["train_to"]) == ((at + len("<|assistant|>\n"), r["end"] - len("<|end|>\n")) if trained else (r["end"], r["end"]))
                at = r["end"]
            assert [r["turn"] for r in own] == sorted(r["turn"] for r in own)
            numbers = defaultdict(list)
            for r in own:
                numbers[r["turn"]].append(r["nth"])
            assert all(v == list(range(1, len(v) + 1)) for v in numbers.values())
    empty = [f.where("false") for f in frames]
    assert chat.format_preferences(*empty).count() == 0 and chat.format_preferences(frames[0], empty[1]).where("part <> 'chosen'").count() == 0


def test_op2_query_is_the_general_operator(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    last = {}
    for r in conv.where("role = 'assistant'").collect():
        if r["turn"] >= last.get(r["conv_id"], (-1,))[0]:
            last[r["conv_id"]] = (r["turn"], r["text"])
    rejected = []
    for r in conv.collect():
        if r["conv_id"] not in last or r["turn"] < last[r["conv_id"]][0]:
            rejected.append(tuple(r))
    rejected += [(c, t, "assistant", last[c ^ 1][1]) for c, (t, _) in last.items() if c ^ 1 in last]
    want = chat.format_preferences(conv, spark.createDataFrame(rejected, conv.schema)).collect()
    assert sorted(map(str, queries.op2_preference_format(spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, want))


# --- pages ----------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(3) for c in CLASH})


def test_pages_of_all_kinds(spark):
    wide = "<body><article>" + "".join(f"<p>paragraph {i}</p>" for i in range(3000)) + "</article></body>"
    deep = "<body>" + "<div>" * 3000 + "deep text" + "</div>" * 3000 + "</body>"
    main = "<main>" * 2000 + "inner" + "</main>" * 2000
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "<p>no host</p>"), (None, "http://a/3", "<p>no id</p>"), (4, "not a url", "<p>x</p>"), (5, "http://a/4", wide), (5, "http://a/4", wide), (6, "http://a/5", deep), (7, "http://a/6", main), (8, "http://a/7", "<p>bad \ud800".encode("utf-8", "replace").decode()), (9, "http://a/8", "<")]
    frame = pages(spark, rows)
    got = Counter((r["page_id"], r["n_chars"], r["text"][:20]) for r in html.extract(frame).collect())
    assert sum(got.values()) == len(rows) and got[(5, len(" ".join(f"paragraph {i}" for i in range(3000))), "paragraph 0 paragrap")] == 2
    assert got[(6, 9, "deep text")] == got[(7, 5, "inner")] == got[(1, 0, "")] == got[(3, 7, "no host")] == got[(None, 5, "no id")] == 1
    assert html.extract(frame.where("false")).count() == 0
    found = warc.read_archives(warc.write_archives(frame)).collect()
    assert Counter(r["page_id"] for r in found) == Counter(r[0] for r in rows)


def plain_tree(rng, depth):
    return (rng.choice("abc"), [plain_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])


def as_node(tree):
    node = html.Node({"a": "div", "b": "p", "c": "ul"}[tree[0]], {})
    node.blocks = [as_node(c) for c in tree[1]]
    html._shaped(node)
    return node


def plain_matching(x, y):
    """Simple tree matching by its definition."""
    if x[0] != y[0]:
        return 0

    @lru_cache(None)
    def best(i, j):
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + plain_matching(x[1][i - 1], y[1][j - 1])) if i and j else 0

    return 1 + best(len(x[1]), len(y[1]))


def test_matching_sizes_are_plain_recursion(monkeypatch):
    rng = random.Random(8)
    for _ in range(300):
        x, y = plain_tree(rng, 3), plain_tree(rng, 3)
        a, b = as_node(x), as_node(y)
        assert html.Matcher().size(a, b) == plain_matching(x, y)
        pairs = html.Matcher().pairs(a, b)
        assert len(pairs) == plain_matching(x, y) and all(k.tag for k in pairs.values()) and len({id(k) for k in pairs.values()}) == len(pairs)


def test_matchings_in_halves(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(200):
        m, n = rng.integers(1, 9, 2)
        w = rng.integers(0, 4, (m, n))
        total = []
        for cells in (1 << 20, 4):
            monkeypatch.setattr(html, "CELLS", cells)
            found = html.in_order(lambda i, w=w: w[i], m, n)
            assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
            total.append(sum(w[i, j] for i, j in found))
        best = np.zeros((m + 1, n + 1), int)
        for i in range(m):
            for j in range(n):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + w[i, j])
        assert total == [best[m, n]] * 2


def test_wide_pages_take_bounded_time():
    page = lambda k: "<body>" + "".join(f"<p>{i}</p>" if (i + k) % 3 else f"<ul><li>{i * k}</li></ul>" for i in range(12000)) + "</body>"
    start = time.process_time()
    seed = html.seed_of(html.parse(page(1)))
    html.read(page(2), seed)
    assert time.process_time() - start < 60


def test_template_moves_with_its_place():
    """A menu whose place shifts from page to page, and a sentence of the menu that an author wrote too."""
    page = lambda i: "<body>" + "<div>new</div>" * (i % 2) + f"<ul><li>Home</li><li>About us</li></ul><div><p>own {i}</p><p>{'About us' if i == 3 else 'more'} {i if i != 3 else ''}</p></div><div>All rights</div></body>"
    every = [page(i) for i in range(8)]
    got = [html.main_text(p, tuple(every)) for p in every]
    assert got == [("new " if i % 2 else "") + f"own {i} " + ("About us" if i == 3 else f"more {i}") for i in range(8)]


@pytest.mark.parametrize("mark", ["class='share-price'", "id=related-work", "class='ad-hoc'", "class=share", "id=comments", "class='promo notice'", "role=banner"])
def test_authors_names_keep_their_text(mark):
    page = lambda i, own="": f"<body><nav>menu</nav><article><h1>Title {i}</h1><p>text {i}</p>{own}<p>end {i}</p></article></body>"
    every = [page(i) for i in range(5)] + [page(5, f"<section {mark}>of the author</section>")]
    assert html.main_text(every[5], tuple(every)) == "Title 5 text 5 of the author end 5"
    # the site's own: the same element on other pages, with other text
    site = [page(i, f"<section {mark}>changing {i}</section>") for i in range(6)]
    if mark not in ("class='share-price'", "id=related-work", "class='ad-hoc'"):
        assert html.main_text(site[5], tuple(site)) == "Title 5 text 5 end 5"


# --- the pipeline -----------------------------------------------------------------------------------


def test_stages_on_odd_documents(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (documents(spark), documents(spark).where("false")):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows, cut(stage(spark, rows, str(tmp_path)), f"odd-{name}")
            if name != "pack":
                assert rows.columns == docs.columns
            if name in ("quality_filter", "near_dedup"):
                assert rows.exceptAll(before).count() == 0
        packed = rows.collect()
        assert all(len(r["ids"]) == r["length"] for r in packed) and bool(packed) == bool(docs.count())
