import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from healthloom.llm import entry, substrings

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    """(doc_id, text) -> sorted (doc_id, n_words, n_removed, sha of the words left), window by window."""
    first, split = {}, [(k, SPACE.findall(t or "")) for k, t in rows]
    for k, w in split:
        if k is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                first[key] = min(k, first.get(key, k))
    out = []
    for k, w in split:
        gone = set()
        if k is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < k:
                    gone.update(range(s, s + window))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(found):
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def corpus(seed=5):
    """Passages of 49 to 90 words shared by some or most texts, near copies, copies, periodic texts, texts of one word."""
    rnd = random.Random(seed)
    words = lambda n, k=2000: [f"w{rnd.randrange(k)}" for _ in range(n)]
    passages = [words(n) for n in (49, 50, 51, 64, 90)]
    common, model = words(70), words(300)
    rows = []
    for k in range(120):
        t = words(rnd.choice([0, 10, 49, 50, 120, 400]))
        for p in rnd.sample(passages, rnd.choice([0, 1, 2])):
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        if k % 3 == 0:
            t = t + common
        if k % 7 == 0:
            t = list(model)
            for _ in range(rnd.choice([0, 0, 2, 6])):
                t[rnd.randrange(300)] = "changed"
        rows.append((rnd.randrange(10_000) if k % 10 else 77, rnd.choice([" ", "\n", "  "]).join(t)))
    rows += [(20_000 + k, " ".join(["a", "b"][: 1 + k % 2] * 60)) for k in range(5)]
    rows += [(30_000, " ".join(model + words(30) + model)), (3, " ".join(model + model)), (None, " ".join(model)), (40_000, None), (40_001, "")]
    return rows + rows[:3]


@pytest.mark.parametrize("group", [substrings.GROUP, 20, 0])
def test_equals_brute_force_whatever_the_group(spark, group, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substrings.repeats, "__defaults__", (group,))
    want = brute(rows)
    assert got(substrings.removal(df)) == want
    assert any(0 < r[2] < r[1] for r in want) and any(0 < r[2] == r[1] for r in want)


def test_small_batches(spark, monkeypatch):
    """Prefixes that lie over several batches."""
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got(substrings.removal(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_equals_brute_force_and_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(entry.op13_substring_dedup(spark, sf))
    assert found == brute(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.sql(substrings.ORACLE).fetchall(), key=repr) == found


def test_odd_texts(spark, docs, texts, empty, repeated):
    assert got(substrings.removal(docs)) == brute([(3 * k + 1, t) for k, t in enumerate(texts)])
    assert substrings.removal(empty).count() == 0
    assert got(substrings.removal(repeated)) == brute([(r.doc_id, r.text) for r in repeated.collect()])


def test_a_very_long_text(spark):
    rnd = random.Random(6)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(160_000)]
    part = long[100_000:100_200]
    rows = [(1, " ".join(part)), (2, " ".join(long)), (3, "x " * 150_000), (4, "x " * 60)]
    want = {k: (n, r) for k, n, r, _ in got(substrings.removal(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert want == {1: (200, 0), 2: (160_000, 200), 3: (150_000, 0), 4: (60, 60)}


def test_anchors_depend_on_the_window_alone():
    rnd = np.random.default_rng(3)
    h = rnd.integers(0, 2**63, 400).astype(np.uint64)
    h[100:180] = h[100]  # ties
    sizes = np.array([0, 150, 49, 50, 151])
    text, gram, at, first, last = substrings.anchors(sizes, h)
    base = np.cumsum(sizes) - sizes
    seen = [(t, s) for t, f, x in zip(text, first, last) for s in range(f, x + 1)]
    assert sorted(seen) == [(t, s) for t, n in enumerate(sizes) for s in range(n - 49)]
    of = {(t, s): (g, p - s) for t, g, p, f, x in zip(text, gram, at, first, last) for s in range(f, x + 1)}
    for (t, s), found in of.items():
        own = h[base[t] + s : base[t] + s + 50]
        alone = substrings.anchors(np.array([50]), own)
        assert found == (alone[1][0], alone[2][0])
