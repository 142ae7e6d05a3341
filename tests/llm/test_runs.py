import hashlib
import random
import re
import zlib

import numpy as np

from healthloom.llm import entry, runs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All maximal stretches of each period, then the smallest period of each."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - start >= p and i - start + p >= 12:
                best.setdefault((start, i - start + p), p)
    return sorted((s, q, length) for (s, length), q in best.items())


def brute_row(doc_id, text, plant=True):
    words = SPACE.findall(text or "")
    n = len(words)
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, q, length in found), default=None)
    return (
        doc_id,
        len(found),
        *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, q, length in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def key(row):
    return tuple((v is None, v) for v in row)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = [brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in entry.op12_periodic_runs(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[1] > 1 for r in want) and any(r[2] is None for r in want)


def test_odd_texts(spark, docs, texts, empty, repeated):
    got = {r.doc_id: tuple(r) for r in runs.run_digests(runs.periodic_runs(docs)).collect()}
    assert got == {3 * k + 1: brute_row(3 * k + 1, t, plant=False) for k, t in enumerate(texts)}
    assert runs.run_digests(runs.periodic_runs(runs.planted(empty))).count() == 0
    again = runs.run_digests(runs.periodic_runs(runs.planted(repeated))).collect()
    want = [brute_row(r.doc_id, r.text) for r in repeated.collect()]
    assert sorted(map(tuple, again), key=key) == sorted(want, key=key)


def test_small_alphabets_and_planted_periods():
    rnd = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            k, n = rnd.choice([1, 2, 3, 5, 40]), rnd.choice([0, 1, 5, 12, 30, 80, 200])
            t = [rnd.randrange(k) for _ in range(n)]
            if rnd.random() < 0.5 and n > 20:
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 2))
                t = t[:a] + [t[a + i % p] for i in range(n - a)]
            texts.append(np.array(t, np.int64))
        for t, found in zip(texts, runs.found_runs(texts)):
            assert [(s, q, length) for s, length, q in found.tolist()] == brute_runs(t.tolist())


def test_extensions():
    rnd = random.Random(1)
    s = np.array([rnd.randrange(2) for _ in range(300)])
    ext = runs.Extensions(s)
    a, b = (np.array([rnd.randrange(300) for _ in range(500)]) for _ in range(2))
    a, b = a[a != b], b[a != b]
    for x, y, n in zip(a.tolist(), b.tolist(), ext.of(a, b).tolist()):
        m = 0
        while max(x, y) + m < 300 and s[x + m] == s[y + m]:
            m += 1
        assert n == m


def test_a_very_long_text(spark):
    """A text of over 1 MB whose period is a third of it, and one of a single word over and over."""
    rnd = random.Random(2)
    part = [f"w{rnd.randrange(10**6)}" for _ in range(50_000)]
    rows = [(1, " ".join(part * 3)), (2, "a " * 200_000)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 150_000, 50_000)] and got[1].collapsed == " ".join(part)
    assert [tuple(r) for r in got[2].runs] == [(0, 200_000, 1)] and got[2].collapsed == "a"
