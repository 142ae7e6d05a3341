import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from healthloom.llm import nearcopies

M = (1 << 64) - 1


def brute_fingerprint(words, n, count, salt):
    """As the docstring says, in plain integers."""
    grams = [words[i : i + n] for i in range(max(1, len(words) - n + 1))] if words else []
    ones = [0] * (64 * count)
    for gram in grams:
        h = 0
        for w in gram:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) & M
        for t in range(count):
            x = (h + ((salt + t) << 32)) & M
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
            x = (x ^ x >> 27) * 0x94D049BB133111EB & M
            x ^= x >> 31
            for b in range(64):
                ones[64 * t + b] += x >> b & 1
    return [sum(1 << b for b in range(64) if 2 * ones[64 * t + b] > len(grams)) for t in range(count)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode("utf-8", "replace").split()


def joined(ids, links):
    label = {k: k for k in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                moved = True
    return label


def links_of(rows):
    """rows: (doc_id, text) with distinct ids -> pairs of ids that are linked, the lesser one first."""
    held = [(k, *nearcopies.fingerprints_of(t)) for k, t in rows]
    links = []
    for i, (k, find, judge) in enumerate(held):
        for j, other, verdict in held[:i]:
            x = [int(u) ^ int(v) for u, v in zip(find, other)]
            near = any(bin(h).count("1") <= 1 for v in x for h in (v & 0xFFFFFFFF, v >> 32))
            far = [bin(int(u) ^ int(v)).count("1") for u, v in zip(judge, verdict)]
            if near and far[0] <= nearcopies.CHECK_BITS and sum(far) <= nearcopies.MOST_BITS:
                links.append((min(k, j), max(k, j)))
    return links


def brute_groups(rows):
    """doc_id -> least id of its group."""
    return joined([k for k, _ in rows], links_of(rows))


def word(rnd):
    return "".join(rnd.choice("abcdefghij") for _ in range(6))


def edited(rnd, words, times):
    copy = list(words)
    for at in rnd.sample(range(len(words)), times):
        copy[at] = word(rnd)
    return copy


def similarity(a, b, repeats=False):
    """Jaccard of five-word shingles, as sets or with their repeats."""
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (lowered(a), lowered(b)))
    if not repeats:
        x, y = Counter(set(x)), Counter(set(y))
    return (x & y).total() / (x | y).total()


@pytest.fixture(scope="module")
def planted():
    """One dense group, small groups, a chain, and texts of their own."""
    rnd = random.Random(3)
    rows = []
    centre = [word(rnd) for _ in range(300)]
    rows += [" ".join(edited(rnd, centre, rnd.randint(0, 6))) for _ in range(80)]
    for _ in range(25):
        base = [word(rnd) for _ in range(rnd.choice([80, 250]))]
        rows += [" ".join(edited(rnd, base, k)) for k in (0, 1, 3)[: rnd.randint(1, 3)]]
    link = [word(rnd) for _ in range(200)]
    for _ in range(12):
        link = edited(rnd, link, 4)
        rows.append(" ".join(link))
    rnd.shuffle(rows)
    return [(7 * k + 2, t) for k, t in enumerate(rows)]


def test_fingerprints_are_those_of_the_docstring(texts):
    for text in texts:
        if text is None or len(text) < 3000:
            find, judge = nearcopies.fingerprints_of(text)
            words = lowered(text)
            assert [int(v) for v in find] == brute_fingerprint(words, 2, 6, 1)
            assert [int(v) for v in judge] == brute_fingerprint(words, 5, 8, 101)


def test_groups_are_those_of_all_pairs(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.best.doc_id for r in nearcopies.grouped(df).collect()}
    assert got == brute_groups(planted)


@pytest.mark.parametrize("part", [0, 3, 10])
def test_links_between_classes_are_found(spark, planted, part):
    """The search alone (no class), and classes that are joined by some of the links: the groups are the same."""
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    nodes = nearcopies.fingerprints(df).withColumn("node", F.col("doc_id")).select("node", "find", "judge").cache()
    want = brute_groups(planted)
    known = [pair for k, pair in enumerate(sorted(links_of(planted))) if k % 10 < part]
    classes = joined(want, known)
    inside = [(k, c) for k, c in classes.items() if sum(v == c for v in classes.values()) > 1]
    held = spark.createDataFrame(inside, "node long, class long")
    links = {(r.a, r.b) for r in nearcopies.between(nodes.join(held, "node", "left")).collect()}
    assert links <= set(links_of(planted)) and all(classes[a] != classes[b] for a, b in links)
    assert joined(want, [*known, *links]) == want


def test_a_dense_group_makes_few_rows(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    nodes = nearcopies.fingerprints(df).withColumn("node", F.col("doc_id")).cache()
    near = nearcopies.stars(nodes)
    assert near.count() <= 12 * len(planted)
    root = {r.node: r.root for r in nearcopies.components(near).collect()}
    classed = nodes.join(spark.createDataFrame(list(root.items()), "node long, class long"), "node", "left")
    assert nearcopies.between(classed).count() <= 12 * len(planted)


def test_near_copies_are_caught_and_others_left_alone(spark):
    """Of pairs of 0.8 five-word similarity at least nine in ten are in one group; unlike texts never are."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rnd = random.Random(5)
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    made = []
    for doc_id, text in rows:
        words = (text or "").split()
        if 60 <= len(words) <= 600:
            copy = edited(rnd, words, max(1, len(words) // 60))
            made.append((doc_id, 1_000_000 + doc_id, " ".join(copy)))
    df = spark.createDataFrame(rows + [(b, t) for _, b, t in made], "doc_id long, text string").repartition(6)
    best = {r.doc_id: r.best.doc_id for r in nearcopies.grouped(df).collect()}
    by_id = dict(rows)
    near = [(a, b) for a, b, t in made if similarity(by_id[a], t) >= 0.8]
    assert len(near) > 200
    assert np.mean([best[a] == best[b] for a, b in near]) >= 0.95
    members = {}
    for k, g in best.items():
        members.setdefault(g, []).append(k)
    texts = by_id | {b: t for _, b, t in made}
    for g, group in members.items():
        for k in group:
            assert k == g or max(similarity(texts[k], texts[j], True) for j in group if j != k) > 0.5


def test_dedup_keeps_one_of_each_group(docs, texts):
    want = brute_groups([(3 * k + 1, t) for k, t in enumerate(texts)])
    kept = nearcopies.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_and_repeated(empty, repeated):
    assert nearcopies.near_dedup(empty).count() == 0
    assert sorted(r.text for r in nearcopies.near_dedup(repeated).collect() if r.text) == ["Same words here", "other one"]
    assert nearcopies.near_dedup(repeated).count() == 3


def test_a_very_long_text(spark):
    rnd = random.Random(2)
    words = [word(rnd) for _ in range(150_000)]
    rows = [(2, " ".join(words)), (1, " ".join(edited(rnd, words, 900))), (3, "x")]
    kept = nearcopies.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("crowd, block", [(0, 3), (4, 16), (1000, 16)])
def test_buckets_of_any_size_lose_no_link(spark, planted, crowd, block):
    """Whatever is judged inside its bucket, and in however many blocks, the groups are the same."""
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    nodes = nearcopies.fingerprints(df).select(F.col("doc_id").alias("node"), "find", "judge", F.lit(None).cast("long").alias("class")).cache()
    links = {(r.a, r.b) for r in nearcopies.between(nodes, crowd, block).collect()}
    assert links <= set(links_of(planted))
    assert joined([k for k, _ in planted], links) == brute_groups(planted)


def test_a_crowded_bucket_of_unlike_texts_makes_no_row_of_each_pair(spark, monkeypatch):
    """300 nodes of one finding fingerprint, alike in the first judging word: 44,850 pairs, of which ten are near."""
    rnd = random.Random(8)
    judges = [[0] + [rnd.getrandbits(64) - (1 << 63) for _ in range(7)] for _ in range(290)]
    judges += [[0] + [v ^ 1 for v in judges[29 * k][1:]] for k in range(10)]
    nodes = spark.createDataFrame([(k, [5] * 6, j, None) for k, j in enumerate(judges)], "node long, find array<long>, judge array<long>, class long")
    asked = []
    plain = nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, held: asked.append(pairs.count()) or plain(pairs, held))
    links = {(r.a, r.b) for r in nearcopies.between(nodes).collect()}
    assert links == {(29 * k, 290 + k) for k in range(10)}
    assert sum(asked) <= 300


def test_a_crowded_bucket_makes_no_row_of_each_node_and_bucket_it_probes(spark, monkeypatch):
    """200 unlike nodes in 33 neighbouring buckets of each table: a node has a row in each of its own tables, and blocks meet by bucket."""
    rnd = random.Random(9)
    full = (1 << 32) - 1
    segment = lambda k: full if k % 2 else full ^ 1 << (k // 2 % 32)  # noqa: E731  the centre, or it with one bit cleared
    word = lambda k: int(np.uint64(segment(k) << 32 | segment(k)).view(np.int64))
    judges = [[0] + [rnd.getrandbits(64) - (1 << 63) for _ in range(7)] for _ in range(190)]
    judges += [[0] + [v ^ 1 for v in judges[19 * k][1:]] for k in range(10)]
    nodes = spark.createDataFrame([(k, [word(k)] * 6, j, None) for k, j in enumerate(judges)], "node long, find array<long>, judge array<long>, class long")
    made = []
    plain = nearcopies.cut
    monkeypatch.setattr(nearcopies, "cut", lambda df: made.append(plain(df)) or made[-1])
    links = {(r.a, r.b) for r in nearcopies.between(nodes).collect()}
    near = {(19 * k, 190 + k) for k in range(10)}
    # a pair of unlike buckets, neither of them the centre, is two bits apart
    assert links == {(a, b) for a, b in near if bin(segment(a) ^ segment(b)).count("1") <= 1}
    assert max(df.count() for df in made) <= 12 * 200
    assert [df.count() <= 12 * (33 + 32) for df in made if df.columns == ["p_block", "e_block"]] == [True]
