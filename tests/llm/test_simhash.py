import random

import numpy as np
import xxhash

from healthloom.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps):
    """fps: list of (id, fp) -> id -> least id reached."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([f for _, f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(fps)}


def test_documents(docs, texts):
    rows = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    want = [(3 * k + 1, brute_fingerprint(t)) for k, t in enumerate(texts)]
    assert {k: r.fp & (2**64 - 1) for k, r in rows.items()} == dict(want)
    assert {k: r.component_id for k, r in rows.items()} == brute_components(want)


def planted(seed, n=300, crowd=600):
    """Clusters, chains, values that share a half, and one crowded half."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        f = rnd.getrandbits(64)
        out.append(f)
        for _ in range(rnd.choice([0, 0, 3])):  # chains
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                f ^= 1 << b
            out.append(f)
    low = rnd.getrandbits(32)
    hubs = [rnd.getrandbits(32) for _ in range(5)]
    for _ in range(crowd):
        h = rnd.choice(hubs)
        for b in rnd.sample(range(32), rnd.randint(0, 4)):
            h ^= 1 << b
        out.append(h << 32 | low ^ (1 << rnd.randrange(32) if rnd.random() < 0.3 else 0))
    return sorted(set(out))


def test_links_are_all_found_with_and_without_crowds(spark):
    fps = planted(3)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(2, f) for f in signed], "t int, fp long")
    values = np.array(fps, np.uint64)
    want = set()
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            a, b = signed[i], signed[i + 1 + int(j)]
            want.add((min(a, b), max(a, b)))
    for crowd in (1, 40, 100_000):
        assert {(r.t, (r.a, r.b)) for r in simhash.links(nodes, crowd).collect()} == {(2, p) for p in want}


def test_components_of_a_long_chain(spark):
    rows = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002)]
    random.Random(1).shuffle(rows)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in (1000, 1001, 1002)}}


def brute_tables(rows, tables):
    """rows: (id, text) -> id -> least id reached by links of any table."""
    fps = [(k, simhash.fingerprints_of((t or "").encode().lower().split(), 3, tables)) for k, t in rows]
    label = {k: k for k, _ in fps}
    while True:
        before = dict(label)
        for k, f in fps:
            for j, g in fps:
                if any(bin(int(x) ^ int(y)).count("1") <= 3 for x, y in zip(f, g)):
                    label[k] = label[j] = min(label[k], label[j])
        if label == before:
            return label


def test_more_tables_find_more_near_copies(spark):
    import random

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(25):
        words = [word() for _ in range(150)]
        for c in range(3):
            copy = list(words)
            for at in rnd.sample(range(150), c * 2):
                copy[at] = word()
            rows.append((10 * k + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {}
    for tables in (1, 8):
        want = brute_tables(rows, tables)
        got = {r.doc_id: r.best.doc_id for r in simhash.grouped(df, tables=tables).collect()}
        assert got == want
        left[tables] = len(set(want.values()))
        assert all(v // 10 == k // 10 for k, v in want.items())
    assert left[8] < left[1]


def test_dedup_keeps_one_of_each_group(docs, texts):
    want = brute_tables([(3 * k + 1, t) for k, t in enumerate(texts)], 8)
    kept = simhash.near_dedup(docs, tables=8)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_and_repeated(empty, repeated):
    assert simhash.near_groups(empty).count() == 0
    assert simhash.near_groups(repeated).count() == 7
    assert sorted(r.text for r in simhash.near_dedup(repeated).collect() if r.text) == ["Same words here", "other one"]


def test_dedup_links_over_eight_fingerprints_by_default(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(20):
        words = [word() for _ in range(150)]
        rows.append((10 * k, " ".join(words)))
        for c in (1, 2):
            copy = list(words)
            for at in rnd.sample(range(150), 3):
                copy[at] = word()
            rows.append((10 * k + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(set(brute_tables(rows, 8).values()))
    assert want != sorted(set(brute_tables(rows, 1).values()))
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == want


def test_links_of_a_dense_group_are_thinned_and_keep_the_components(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(2):  # every value of a group is within 1 bit of its centre
        centre = rnd.getrandbits(64)
        fps |= {centre ^ 1 << i for i in range(64)}
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(k, [0, f]) for k, f in enumerate(signed)] + [(9999, [5, 6])], "node long, fps array<long>")
    values = nodes.selectExpr("posexplode(fps) AS (t, fp)").distinct()
    every = simhash.links(values)
    few = simhash.spanned(every.coalesce(1))
    roots = lambda e: {(r.node, r.root) for r in simhash.components(e.filter("t = 1").select("a", "b")).collect()}
    assert roots(few) == roots(every) == roots(simhash.spanned(every, held=3))
    assert few.filter("t = 1").count() < len(signed) < every.count() / 4
    # nodes that share a value in one table are one group, whatever the other tables say
    linked = simhash.node_links(nodes, 2)
    assert {r.root for r in simhash.components(linked).collect()} == {0}
