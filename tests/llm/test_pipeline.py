"""The pipeline's stages at the smallest scale, each against a plain version or its invariants."""

from collections import Counter, defaultdict

import corpus_pipeline
from corpusmill.session import cut, table
from test_operators import SF, components, plain_fingerprint


def test_stages(spark):
    docs = table(spark, SF, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    (_, quality), (_, dedup), (_, mix), (_, pack) = corpus_pipeline.STAGES

    good = cut(quality(spark, docs, SF), "test-quality")
    kept = {r["doc_id"]: r for r in good.collect()}
    assert good.columns == docs.columns and all(given[d] == r for d, r in kept.items())
    known = [(d in kept, labels[d] == 1) for d in labels]
    assert sum(a == b for a, b in known) >= 0.8 * len(known)

    one = cut(dedup(spark, good, SF), "test-dedup")
    want = set(components({d: plain_fingerprint(r["text"]) for d, r in kept.items()}).values())
    rows = one.collect()
    assert one.columns == docs.columns and Counter(r["doc_id"] for r in rows) == Counter(want)

    mixed = cut(mix(spark, one, SF), "test-mix")
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= want and max(copies.values()) <= 2

    packed = pack(spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
