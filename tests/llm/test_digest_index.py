import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from healthloom.llm import digest_index


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts):
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[lower(t)].append(3 * k + 1)
    return {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


def test_groups(docs, texts):
    rows = digest_index.DigestIndex(docs).groups("max").collect()
    assert {r.id: (r.keep_id, r.n, r.kept, bytes(r.digest).hex()) for r in rows} == brute(texts)


def test_colliding_digests_are_told_apart_by_bytes(docs, texts):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    rows = digest_index.DigestIndex(docs, digest=weak, filter_bits=32768).groups("max").collect()
    assert {r.id: (r.keep_id, r.n, r.kept) for r in rows} == {k: v[:3] for k, v in brute(texts).items()}


def test_smallest_identifier(docs, texts):
    rows = digest_index.DigestIndex(docs).groups("min").collect()
    least = {}
    for k, t in enumerate(texts):
        least.setdefault(lower(t), 3 * k + 1)
    assert {r.id: r.keep_id for r in rows} == {3 * k + 1: least[lower(t)] for k, t in enumerate(texts)}


def test_dedup_keeps_columns_and_rows(docs, texts):
    kept = digest_index.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = sorted(k for k, v in brute(texts).items() if v[2])
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_repeated_rows_and_nulls(repeated, empty):
    assert digest_index.DigestIndex(empty).groups().count() == 0
    assert digest_index.exact_dedup(empty).count() == 0
    rows = digest_index.DigestIndex(repeated).groups("max").collect()
    assert len(rows) == 7 and sum(r.kept for r in rows) == 3
    kept = sorted((r.doc_id, r.text) for r in digest_index.exact_dedup(repeated).collect())
    assert kept == [(5, "Same words here"), (7, None), (9, "other one")]
