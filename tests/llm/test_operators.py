"""The package's operators against plain versions and on odd input."""

import gzip
import hashlib
import io
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from corpusmill.llm import html, media, mixing, packing, queries, simhash, tokencount, topk, warc
from corpusmill.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fp):
    root = {d: d for d in fp}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


def test_op1_is_brute_force(spark, docs):
    fp = {d: plain_fingerprint(t) for d, t in docs.items()}
    want = components(fp)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op1_simhash")} == {(d, f"{f:016x}", want[d]) for d, f in fp.items()}


def test_simhash_links_in_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    fp = {}
    for i in range(300):
        x = int(base[i % 6])
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        fp[i] = x
    want = components(fp)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in sorted(set(fp.values()))], "fp long")
    got = {r["node"]: r["component"] for r in simhash.connected_components(simhash.links(frame, pair_limit=4)).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for i, x in fp.items():
        mine[got.get(simhash._signed(x), simhash._signed(x))].add(i)
        theirs[want[i]].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_op3_pieces(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in run(spark, "op3_best_fit_packing"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for d, rows in by_doc.items():
        ids = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            own = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(own.tobytes()))
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for rows in by_doc.values() for r in rows)
    assert len(by_sequence) <= 1.1 * -(-total // 1024) + 1


def test_op4_is_brute_force(spark):
    rows = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)).astype(int) for r in table(spark, SF, "embeddings").collect()}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in run(spark, "op4_exact_top_k")}
    want = {}
    for q in (q for q in rows if q % 20 == 0):
        best = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q)[:20]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want


def test_top_k_skips_bad_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (5, [0.5])], "vec_id long, embedding array<double>")
    got = topk.top_k(rows, rows["vec_id"] % 20 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(4, 64 * 64 * 5), (5, 64 * 32)]


def test_html_regions_and_references():
    page = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n <b>tw</b>o<p>three<div class='ad'>buy</div><script>x</script></article><div id=comments>c</div></body></html>"
    assert html.main_text(page) == "A & B one two three"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""


def test_html_template_without_article():
    page = "<body><div><span>Site name</span></div><div><p>{}</p><p>second {}</p></div><div>All rights</div></body>"
    a, b = page.format("alpha", 1), page.format("beta", 2)
    assert html.main_text(a, (a, b)) == "alpha second 1"
    assert html.main_text(a, (a, a)) == "Site name alpha second 1 All rights"


def test_html_wrapper_of_all_pages(spark):
    page = "<body>{}<div><p>own {}</p><p>{}</p></div><p>All rights</p></body>"
    menu = "<div><p>Home</p><p>About</p></div>"
    # a passage on 3 of 9 pages is content; the menu, which 3 pages lack, is template
    rows = [(i, f"http://h/{i}", page.format("" if i % 3 == 2 else menu, i, f"passage {i // 3}")) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i} passage {i // 3}" for i in range(9)}


def test_html_template_in_articles():
    page = "<body><article><h1>{0}</h1><p>text {0}</p><div>Share this</div><p>Licence: <b>free</b></p></article><p>{1}</p></body>"
    pages = [page.format(i, "") for i in range(4)]
    assert [html.main_text(p, tuple(pages)) for p in pages] == [f"{i} text {i}" for i in range(4)]
    # two pages may be copies of one text; an article of template only stays
    assert html.main_text(pages[0], tuple(pages[:2])) == "0 text 0 Share this Licence: free"
    same = [page.format("x", f"note {i}") for i in range(3)]
    assert html.main_text(same[0], tuple(same)) == "x text x Share this Licence: free"


def test_html_text_beside_cards():
    page = "<body><p>Site</p><div><p>a long text of its own, number {0}</p><p>and more of it {0}</p></div><article>card {0}</article></body>"
    pages = [page.format(i) for i in range(3)]
    assert html.main_text(pages[1], tuple(pages)) == "a long text of its own, number 1 and more of it 1 card 1"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout no-sidebar'><article>{}</article></div>",
        "<div class='sidebar'><article>{}</article></div>",
        "<article class='post has-comments'>{}</article><aside><article>card</article></aside>",
        "<form id=aspnet><div>menu</div><article>{}</article></form>",
        "<form><div>{}</div></form><div class=footer>end</div>",
        "<div class='share'>{}</div>",
        "<main><div>{}</div><div class='ad'><article>card</article></div></main>",
        "<main><div>one two</div><article>three</article></main>",
    ],
)
def test_html_marks_hide_no_text(page):
    assert html.main_text(f"<body><nav>menu</nav>{page}</body>".format("one two three")) == "one two three"


def test_op5_on_all_pages(spark):
    rows = run(spark, "op5_html_main_text")
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    assert {r["page_id"] for r in rows} == set(pages)
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for r in rows)
    assert all("track(" not in r["text"] and "©" not in r["text"] for r in rows)


def test_warc_revisits(spark):
    rows = spark.createDataFrame([(1, "http://a/\n", "same", 0), (7, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "ü", "é" * 300000, 0), (None, "u", "same", 0)], "page_id long, url string, html string, archive int")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(rows, size=1000), keep_payload=True).collect()}
    assert len(got) == 6
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 7), 7: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 7)}
    assert got[1]["payload_bytes"] == 4 and got[5]["payload"].decode() == "é" * 300000
    assert got[1]["payload_digest"] == warc.digest(b"same")
    assert warc.read_archives(warc.write_archives(rows.where("false"))).count() == 0


def test_warc_damage():
    one = warc.record(1, "u", b"x" * 100)
    assert gzip.GzipFile(fileobj=io.BytesIO(one)).read().startswith(b"WARC/1.1")
    assert len(list(warc.read_records([one + one]))) == 2
    assert len(list(warc.read_records((one + one)[i : i + 7] for i in range(0, 2 * len(one), 7)))) == 2
    with pytest.raises(ValueError):
        list(warc.read_records([one[:-20]]))
    bad = gzip.compress(gzip.decompress(one).replace(b"xxx", b"yxx", 1))
    with pytest.raises(ValueError):
        [warc.verified(*r) for r in warc.read_records([bad])]


def test_op7_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    rows = run(spark, "op7_quality_classifier")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) >= 0.8


def test_op8_round_trip(spark, docs):
    for r in run(spark, "op8_media_columns"):
        raw = (docs[r["doc_id"]] or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))


def test_sniffing():
    png = media.png_of(b"\0" * 576)
    assert [x[0] for x in media.sniff(png)] == ["image/png"]
    assert media.sniff(b"junk" + png + b"tail" + png[:-3]) == [("image/png", 4, 4 + len(png))]
    assert media.sniff(png[:40] + b"?" + png[41:]) == []
    wav = b"RIFF" + (4).to_bytes(4, "little") + b"WAVE"
    assert media.inspect(wav + png, "image/png")[:2] == ("audio/wav", True)
    assert media.inspect(b"", None)[0] is None and media.inspect(None, "x")[0] is None


def pdf_update(start):
    head = b"1 0 obj <</a 1>> endobj\n"
    return head + b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % (start + len(head))


def test_sniffing_whole_files():
    jpeg = b"\xff\xd8\xff\xe0" + (16).to_bytes(2, "big") + b"JFIF\0" + bytes(9) + b"\xff\xda" + (8).to_bytes(2, "big") + bytes(6) + b"ab\xff\0c\xff\xd0d\xff\xd9"
    gif = b"GIF89a" + b"\1\0\1\0\x80\0\0" + bytes(6) + b"\x2c" + bytes(8) + b"\0" + b"\2\2L\1\0" + b";"
    header = b"%PDF-1.7\n"
    pdf = header + pdf_update(len(header)) + b"\n"
    pdf += pdf_update(len(pdf))  # saved twice
    linear = header + b"1 0 obj <<>> endobj\nstartxref\n0\n%%EOF\n"
    linear += pdf_update(len(linear))
    for kind, x in (("image/jpeg", jpeg), ("image/gif", gif), ("application/pdf", pdf), ("application/pdf", linear)):
        assert media.sniff(x) == [(kind, 0, len(x))]
        assert media.sniff(b"junk " + x) == [(kind, 5, 5 + len(x))]
        assert media.inspect(x, "text/plain")[:2] == (kind, True)
    assert media.sniff(jpeg[:-1]) == []
    assert media.sniff(pdf + b"\n" + linear) == [("application/pdf", 0, len(pdf)), ("application/pdf", len(pdf) + 1, len(pdf) + 1 + len(linear))]


def test_op9_targets(spark, docs):
    rows = run(spark, "op9_source_mixing")
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["size"] == len((docs[r["doc_id"]] or "").encode().split()) for r in rows)
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in run(spark, "op9_source_mixing")}


def test_op9_targets_are_sql(spark):
    """Sizes, sources and targets by a plain reading of the contract; the words taken are within a document of the target."""
    rows = table(spark, SF, "documents").select("doc_id", "source").collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    got = {r["doc_id"]: r for r in run(spark, "op9_source_mixing")}
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, r in got.items():
        sizes[source[d]] += r["size"]
        taken[source[d]] += r["taken"]
        largest[source[d]] = max(largest[source[d]], r["size"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, budget, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:  # shares above the cap are cut, and what they leave is shared again
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else level * weight[s]
            budget -= target[s] if over else 0
        free -= over or free
    for d, r in got.items():
        assert r["source_size"] == sizes[source[d]] and abs(r["target"] - target[source[d]]) < 1e-6 * max(1, target[source[d]])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)


def taken_of(spark, sizes, budget, **how):
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    return {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs, budget=budget, **how).collect()}


@pytest.mark.parametrize(
    ("sizes", "share", "near"),
    [([300] * 4000 + [10**6], 0.3, 0), ([300] * 4000 + [10**6], 0.77, 500000), ([1] * 3000, 0.3, 0), ([7, 11, 13] * 700, 0.77, 3), ([10**5] * 3 + [3] * 2000, 0.3, 50000), ([0, 5, 0, 9], 0.3, 2), ([4], 0.77, 1), ([4], 0.3, 2)],
)
def test_mix_comes_near_its_target(spark, sizes, share, near):
    """Half the longest document at most, where a few documents are most of the words; a few words elsewhere."""
    assert abs(sum(taken_of(spark, sizes, share).values()) - share * sum(sizes)) <= near + 1


def test_cuts_are_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 16)  # so that ranges are narrowed several times
    rng = np.random.default_rng(5)
    places = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]
    places[:900] = [int(x) for x in (places[0] + np.arange(900))]  # a crowded range
    sizes = [int(x) for x in rng.integers(0, 50, 3000)]
    units = spark.createDataFrame([(s, p, n) for p, n in zip(places, sizes, strict=True) for s in "ab"], "src string, place long, size long")
    state = spark.createDataFrame([("a", None, 30000.0, 40.0), ("b", places[10], 10.0**9, 30.0)], "src string, after long, room double, biggest double")
    got = {r["src"]: (r["upto"], r["taken"]) for r in mixing.move_cuts(units, state).collect()}
    for src, after, room, most in (("a", None, 30000, 40), ("b", places[10], 10**9, 30)):
        total, last = 0, after
        for p, n in sorted(zip(places, sizes, strict=True)):
            if 0 < n <= most and (after is None or p > after):
                if total + n > room:
                    break
                total, last = total + n, p
        assert got[src][1] == total and (last <= got[src][0] if after is None else last == got[src][0])


def test_filling_is_the_plain_fold(spark):
    rng = np.random.default_rng(9)
    for left in (0, 40, 700, 90000):
        sizes = [int(x) for x in rng.integers(0, 300, 900)]
        want, rest = [], left
        for i, x in enumerate(sizes):
            if x <= rest:
                want, rest = [*want, i], rest - x
        row = spark.createDataFrame([(left, [(i, x) for i, x in enumerate(sizes)])], "rest long, found array<struct<place: bigint, size: bigint>>")
        assert tuple(row.select(mixing._fill(row["rest"], row["found"]).alias("u")).first()["u"]) == (rest, want)


def test_mix_shards_and_names(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", i, -i, "x") for i in range(600)], "doc_id long, text string, source string, target int, parts int, SHARD string")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "shard_", "shard_order"]
    rows = out.collect()
    assert all(r["target"] == r["doc_id"] and r["parts"] == -r["doc_id"] for r in rows)
    quota = defaultdict(int)
    for r in rows:
        quota[r["shard_"]] += 1
    assert set(quota) == set(range(16)) and max(quota.values()) <= 2 * min(quota.values()) + 64
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


@pytest.mark.parametrize("block_ids", [3, 1 << 16])
def test_token_counts(spark, block_ids):
    texts = [None, "", "one", "a b <|endoftext|> c", "word " * 500, "one", None]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, file int")
    encode = tokencount._encoder(tokencount.VOCABULARY)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(rows, block_ids=block_ids).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    assert tokencount.token_counts(rows.where("false")).count() == 0


def test_op10_is_the_tokenizers_library(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True  # their names are ordinary text
    assert {r["doc_id"]: r["n_tokens"] for r in run(spark, "op10_token_counts")} == {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in docs.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == cols
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == Counter(zip(*(want.column(c).to_pylist() for c in cols)))


def test_unended_document(spark):
    blocks = spark.createDataFrame([(0, 0, np.array([1, 9, 2], "<u4").tobytes()), (0, 1, np.array([3, 4], "<u4").tobytes())], "file int, block long, ids binary")
    got = [tuple(r) for r in tokencount.scan(blocks, separator=9).orderBy("ordinal").collect()]
    assert got == [(0, 0, 0, 1, True), (0, 1, 2, 3, False)]


def test_op2_offsets(spark):
    rows = run(spark, "op2_preference_format")
    assert rows
    sides = defaultdict(list)
    for r in rows:
        for side in ("chosen", "rejected") if r["part"] == "prompt" else (r["part"],):
            sides[r["pair_id"], side].append(r)
    for parts in sides.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["end"] - at == len(r["segment"])
            at = r["end"]
            assert (r["train_from"] < r["train_to"]) == (r["part"] != "prompt" and r["role"] == "assistant" and r["segment"] != "<|assistant|>\n<|end|>\n")


def warc_record(fields, block, gz=True):
    raw = b"WARC/1.0\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    return gzip.compress(raw) if gz else raw


def test_foreign_archives(spark):
    body = b"4\r\nWiki\r\n0\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    parts = [
        ([(b"WARC-Type", b"warcinfo"), (b"Content-Type", b"application/warc-fields")], b"software: x\r\n"),
        ([(b"WARC-Type", b"request"), (b"Content-Type", b"application/http"), (b"WARC-Target-URI", "http://ü/".encode("latin-1"))], b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"),
        ([(b"WARC-Type", b"response"), (b"Content-Type", b"application/http;\r\n msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + warc.digest(b"Wiki").encode())], chunked),
        ([(b"WARC-Type", b"response"), (b"Content-Type", b"application/http"), (b"WARC-Truncated", b"length"), (b"WARC-Payload-Digest", b"md5:00")], b"HTTP/1.0 200 OK\nContent-Length: 99\n\nshort"),
        ([(b"WARC-Type", b"metadata")], b""),
        ([(b"WARC-Type", b"resource"), (b"WARC-Block-Digest", b"SHA1:" + hashlib.sha1(b"data").hexdigest().encode())], b"data"),
        ([(b"WARC-Type", b"revisit"), (b"Content-Type", b"application/http")], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
    ]
    one_each = b"".join(warc_record(*p) for p in parts)
    whole = gzip.compress(b"".join(warc_record(*p, gz=False) for p in parts))
    plain = b"".join(warc_record(*p, gz=False) for p in parts)
    split = gzip.compress(plain[:100]) + gzip.compress(plain[100:])
    rows = spark.createDataFrame([(str(i), bytearray(x), 1) for i, x in enumerate((one_each, whole, plain, split, b""))], "archive string, data binary, url int")
    got = defaultdict(list)
    for r in warc.read_archives(rows, keep_payload=True).collect():
        got[r["archive"]].append(tuple(r)[1:])
    assert set(got) == set("0123") and all(v == got["0"] for v in got.values())
    assert [(r[2], r[3], bytes(r[6])) for r in got["0"]] == [("warcinfo", 13, b"software: x\r\n"), ("request", 0, b""), ("response", len(body), body), ("response", 5, b"short"), ("metadata", 0, b""), ("resource", 4, b"data"), ("revisit", None, b"")]
    assert got["0"][1][1] == "http://ü/" and got["0"][0][1] is None
    for bad in (plain[:-3] + b"x", plain.replace(b"Content-Length: 4", b"Content-Length: 3", 1), plain.replace(b"Content-Length: 13", b"Content-Length: 12", 1), plain.replace(b"Content-Length: 13", b"Content-Size: 13", 1), plain.replace(b"\r\n\r\ndata", b"\r\n\r\ndada", 1), b"HTTP" + plain, one_each[:-4], b"\x1f"):
        with pytest.raises(ValueError):
            [warc.row_of(*r) for r in warc.read_records([bad])]


def test_archive_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.record(5, "http://a", b"text"))
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.read_archives(warc.archive_files(spark, str(tmp_path))).collect()] == [(5, 4)]


def test_many_signatures_take_linear_time():
    import time

    start = time.process_time()
    for x in (b"GIF89a" + bytes(7) + b"\x21\x01" + b"\x01a" * 30000 + b";", b"\xff\xd8\xff\xda\x00\x02" * 50000 + b"a\xff\xd9", b"%PDF-" * 50000 + b"%%EOF", b"\xff\xd8\xff\xe0\x00\x04" * 60000):
        media.sniff(x * 2)
    media.sniff((b"GIF89a" + bytes(7) + b"\x21\x01\x01") * 30000 + b"\x00;")
    assert time.process_time() - start < 20


@pytest.mark.parametrize("case", ["lengths", "ties", "repeats", "large", "short"])
def test_top_k_is_brute_force(spark, monkeypatch, case):
    """Many blocks and ranges, lengths that allow pruning, ties, repeated rows and ids, values beyond exact doubles, mixed widths."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_GROUP", 8)
    monkeypatch.setattr(topk, "RANGE", 2)
    monkeypatch.setattr(topk, "LEAD", 3)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 6)) * np.exp(rng.normal(size=(300, 1)) * (2 if case == "lengths" else 0))
    ids = list(range(300))
    if case == "ties":
        x = np.sign(x[:, :3])
    elif case == "repeats":
        x[100:200] = x[0]
        ids[200:260] = [i % 40 for i in range(60)]
    elif case == "large":
        x = x * 1e6
    rows = [(i, v[: 2 + i % 5].tolist() if case == "short" else v.tolist()) for i, v in zip(ids, x, strict=True)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table_, table_["vec_id"] % 20 == 0, k=7).collect()}
    whole = [(i, [int(np.floor(64 * a)) for a in v]) for i, v in rows]
    want = {}
    for q in {i for i in ids if i % 20 == 0}:
        own = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:7]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_top_k_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, score int, rank string")
    assert topk.top_k(empty, empty["vec_id"] % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "x"), (0, [1.0], 1, "x"), (None, [9.0], 1, "x")], empty.schema)
    assert topk.top_k(one, one["vec_id"] % 20 == 0).count() == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        huge = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
        topk.top_k(huge, huge["vec_id"] == 0).collect()
