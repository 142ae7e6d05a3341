"""Near copies by SimHash and multi-index hashing, for texts that share most of their five-word shingles.

A text has two fingerprints.  The *finding* one has ``FIND`` times 64 bits over
its two-word shingles, the *judging* one ``JUDGE`` times 64 bits over its
five-word shingles.  Every half (32 bits) of the finding one is a segment with a
table.  Two texts are linked when some segment of theirs differs in at most one
bit and the complete distance of their judging fingerprints is at most
``MOST_BITS``.  A five-word similarity (Jaccard) of 0.8 makes 77.6 of 512 bits
differ in the mean, with a deviation of 8.

Search: a text enters each table under its segment; probes are the segment and
the segment with one of its *set* bits cleared (of two values one bit apart one
has the bit set, so the ball of radius 1 is covered from one side).  A candidate
must be within ``CHECK_BITS`` on the first judging word, which rides along, and
is then verified on all of them.

Dense groups: all pairs of a group of near copies would be a square of its
size, so groups are contracted first.  In each bucket of equal segments every
text is paired with the least one only, the pairs are verified, and what hangs
together is a *class*.  A class is never paired with itself; links are
then sought between nodes of different classes.  What meets next to a bucket of
more than ``CROWD`` entries is judged in blocks of the buckets' nodes: pairs of
different classes are compared, but no row is made of one, nor of a node and a
bucket it probes, only of a link that joins two classes.  So every two groups
that any link joins are joined; links inside a class change nothing.

Equal fingerprints are one node.  Groups are the connected components of the
links; in each the row with the least doc_id (null last) stays.

Defined cases: null and word-less texts have fingerprints of zeros and are near
copies of each other; fewer words than a shingle are one shingle; whole texts
count, however long; of repeated rows (equal id and text) exactly one stays;
rows that tie on doc_id go by a hash of the text; an empty table gives an empty
table; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut, drop_rows, shipped, short_batches, small
from .simhash import MASK, components
from .tokens import batches

shipped(__name__)

FIND_WORDS, FIND = 2, 6
JUDGE_WORDS, JUDGE = 5, 8
MOST_BITS = 88
CHECK_BITS = 20
#: Entries from which a bucket's pairs are judged in blocks, and the nodes of about which a block consists.
CROWD, BLOCK = 4, 2048


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words (hashes); fewer words make one run."""
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        total = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return total


def majority(hashes: np.ndarray, words: int, salt: int) -> np.ndarray:
    """``words`` times 64 bits; each is 1 if it is set in over half of the hashes, which are mixed anew for each word."""
    salts = np.arange(salt, salt + words, dtype=np.uint64) << np.uint64(32)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        with np.errstate(over="ignore"):  # the finaliser of SplitMix64
            x = hashes[at : at + 4096, None] + salts
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).ravel(), bitorder="little").view(np.uint64).reshape(len(x), 8 * words)
        # bytes of 0 and 1 are added eight at a time, at most 255 rows, so that none overflows
        sums = np.add.reduceat(bits, np.arange(0, len(x), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64 * words).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The finding and the judging fingerprint of a whole text."""
    import xxhash

    # bytes.split() cuts at the six ASCII white-space bytes and nothing else
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(FIND, "<u8"), np.zeros(JUDGE, "<u8")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return majority(gram_hashes(hashes, FIND_WORDS), FIND, 1), majority(gram_hashes(hashes, JUDGE_WORDS), JUDGE, 101)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text, which tells rows of one id apart), find, judge of every whole text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in batches(source):
            made = [fingerprints_of(t) for t in columns["text"]]
            ids, tags = (pa.array(columns[c], pa.int64()) for c in ("doc_id", "tag"))
            find, judge = (pa.array([m[k].view(np.int64) for m in made], pa.list_(pa.int64())) for k in (0, 1))
            yield pa.record_batch([ids, tags, find, judge], names=["doc_id", "tag", "find", "judge"])

    plain = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tag"))
    return plain.mapInArrow(run, "doc_id long, tag long, find array<long>, judge array<long>")


def _segments() -> Column:
    """Table and segment value in one number, the value in its low 32 bits."""
    halves = []
    for k in range(FIND):
        word = F.get("find", F.lit(k))
        halves += [word.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(word, 32)]
    return F.array(*[v + F.lit(k << 32) for k, v in enumerate(halves)])


def _ball(key: Column) -> Column:
    """The segment, and it with each of its set bits cleared."""
    powers = F.lit([1 << k for k in range(32)]).cast("array<bigint>")
    return F.concat(F.array(key), F.transform(F.filter(powers, lambda p: key.bitwiseAND(p) != 0), lambda p: key.bitwiseXOR(p)))


def entries(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, find, judge and others) under each of their segments: key, check and the other columns."""
    others = [c for c in nodes.columns if c not in ("find", "judge")]
    return nodes.select(*others, F.get("judge", F.lit(0)).alias("check"), F.explode(_segments()).alias("key"))


def probes(entered: DataFrame) -> DataFrame:
    others = [c for c in entered.columns if c != "key"]
    return entered.select(*others, F.explode(_ball(F.col("key"))).alias("key"))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, written before) whose judging fingerprints are at most ``MOST_BITS`` apart (``CHECK_BITS`` in the first word)."""
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # only nodes that are in some pair are shuffled
    held = KeyFilter(asked, ["node"]).passed(nodes.select("node", "judge"), ["node"])
    sides = [held.select(F.col("node").alias(c), F.col("judge").alias(f"{c}_judge")) for c in ("a", "b")]
    differ = [F.bit_count(F.get("a_judge", F.lit(k)).bitwiseXOR(F.get("b_judge", F.lit(k)))) for k in range(JUDGE)]
    near = (differ[0] <= CHECK_BITS) & (reduce(Column.__add__, differ) <= MOST_BITS)
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(near).select("a", "b")


def stars(nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) of each node with the least node of each of its buckets: at most a link per segment."""
    table = entries(nodes).select("node", "key")
    shared = cut(table.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    pairs = KeyFilter(shared, ["key"]).passed(table, ["key"]).join(shared, "key").filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return cut(verified(cut(pairs.distinct()), nodes))


def between(nodes: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between ``nodes`` of different classes (node, find, judge, class; a null class is a node alone).

    A class hangs together already, so links are only sought until two classes
    do as well.  A probe and an entry that meet where no bucket of more than
    ``crowd`` entries takes part are a pair; the others are judged in blocks.
    """
    named = nodes.select("node", "find", "judge", F.coalesce("class", "node").alias("label"))
    entered = entries(named)
    asked = probes(entered)
    counts = cut(entered.groupBy("key").agg(F.count("*").alias("n")))
    reached = counts.filter(F.col("n") > crowd).select(F.explode(_ball(F.col("key"))).alias("key")).distinct()
    crowded = cut(counts.select("key").join(reached, "key", "left_semi"))
    some = bool(crowded.take(1))
    plain = entered.join(crowded, "key", "left_anti") if some else entered
    plain = plain.select("key", *[F.col(c).alias(f"e_{c}") for c in ("node", "label", "check")])
    near = F.bit_count(F.col("check").bitwiseXOR(F.col("e_check"))) <= CHECK_BITS
    met = asked.join(plain, "key").filter((F.col("label") != F.col("e_label")) & near)
    pairs = cut(met.select(F.least("node", "e_node").alias("a"), F.greatest("node", "e_node").alias("b")).distinct())
    links = verified(pairs, nodes)
    if some:
        links = links.unionByName(_judged(named, counts, crowded, block)).distinct()
    return cut(links)


def _judged(named: DataFrame, counts: DataFrame, crowded: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between the nodes of ``crowded`` keys and of the keys that probe them, enough to join all labels which any link there joins.

    A bucket is a few rows, of about ``block`` nodes each, and a label with more
    nodes than that there has blocks of its own.  Buckets meet by their keys,
    however many nodes they hold, and two blocks of one label do not meet.
    """
    key = F.col("key")
    asking = counts.select(key.alias("from"), F.explode(_ball(key)).alias("key"))
    met = cut(KeyFilter(crowded, ["key"]).passed(asking, ["key"]).join(crowded, "key").select("from", key.alias("to")))
    needed = cut(met.select(F.explode(F.array("from", "to")).alias("key")).distinct())
    filled = named.select("node", "label", "judge", F.explode(_segments()).alias("key"))
    filled = cut(KeyFilter(needed, ["key"]).passed(filled, ["key"]).join(needed, "key", "left_semi"))
    sizes = cut(filled.groupBy("key", "label").agg(F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / block).cast("int")
    own = cut(sizes.filter(F.col("n") > block).select("key", "label", parts.alias("own")))
    others = sizes.filter(F.col("n") <= block).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    others = cut(others.select("key", parts.alias("others")))
    dealt = filled.join(small(own), ["key", "label"], "left").join(small(others), "key", "left")
    place = F.pmod(F.xxhash64("node"), F.coalesce("own", "others", F.lit(1)))
    dealt = dealt.groupBy("key", F.when(F.col("own").isNotNull(), F.col("label")).alias("lone"), place.alias("place"))
    blocks = dealt.agg(F.collect_list(F.struct("node", "label", "judge")).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = blocks.select("key", "low", "high", F.col("m.node").alias("node"), F.col("m.label").alias("label"), F.flatten("m.judge").alias("judge"))
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    ends = {s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("key", "low", "high", "block")]) for s in "pe"}
    alike = F.least("p_low", "e_low") == F.greatest("p_high", "e_high")
    once = (F.col("from") != F.col("to")) | (F.col("p_block") <= F.col("e_block"))
    met = met.join(ends["p"], F.col("from") == F.col("p_key")).join(ends["e"], (F.col("to") == F.col("e_key")) & ~alike & once)
    met = cut(met.select("p_block", "e_block"))
    for s in "pe":
        met = met.join(blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in ("block", "node", "label", "judge")]), f"{s}_block")
    with short_batches(named.sparkSession, 64):
        return cut(met.drop("p_block", "e_block").mapInArrow(_joining, "a long, b long").distinct())


def _joining(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every two blocks (node, label, judge of both) the near pairs (a < b), one for each time two labels are joined."""
    for batch in source:
        out: list[tuple[int, int]] = []
        for row in range(batch.num_rows):
            sides = [[batch.column(f"{s}_{c}")[row].values.to_numpy() for c in ("node", "label", "judge")] for s in "pe"]
            ours, theirs = sorted(sides, key=lambda side: len(side[0]))
            label = np.unique(np.concatenate([ours[1], theirs[1]]), return_inverse=True)[1]
            own, other = label[: len(ours[0])], label[len(ours[0]) :]  # views: a change of label is seen in both
            asked, words = (side[2].view(np.uint64).reshape(-1, JUDGE) for side in (ours, theirs))
            first = words[:, 0].copy()
            for at in range(len(own)):
                some = np.flatnonzero((np.bitwise_count(first ^ asked[at, 0]) <= CHECK_BITS) & (other != own[at]))
                some = some[np.bitwise_count(words[some] ^ asked[at]).sum(axis=1, dtype=np.int64) <= MOST_BITS] if len(some) else some
                for to in some:
                    if other[to] != own[at]:
                        label[label == other[to]] = own[at]
                        pair = int(ours[0][at]), int(theirs[0][to])
                        out.append((min(pair), max(pair)))
        yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tag, best (struct: unnamed, doc_id, tag of the group's first row) for every row."""
    with short_batches(docs.sparkSession):
        rows = cut(fingerprints(docs))
    entry = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    nodes = rows.groupBy("find", "judge").agg(F.min(entry).alias("low"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    near = stars(nodes)
    classes = components(near).select(F.col("node").alias("c_node"), F.col("root").alias("class"))
    classed = cut(nodes.join(classes, F.col("node") == F.col("c_node"), "left").select("node", "find", "judge", "class"))
    links = near.unionByName(between(classed))
    roots = components(links).withColumnRenamed("node", "r_node")
    placed = cut(nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("node", "find", "judge", "low", "root"))
    lowest = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("best"))
    linked = placed.filter("root IS NOT NULL").drop("low").join(lowest, "root").select("find", "judge", "best")
    every = linked.unionByName(placed.filter("root IS NULL").select("find", "judge", F.col("low").alias("best")))
    return rows.join(cut(every), ["find", "judge"]).select("doc_id", "tag", "best")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group stays (the one with the least doc_id), all columns kept."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    groups = grouped(held.select("row.doc_id", "row.text"))
    first = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.tag") == F.col("tag"))
    rows = groups.groupBy("doc_id", "tag", first.cast("long").alias("stay")).agg(F.count("*").alias("n"))
    gone = rows.select("doc_id", "tag", (F.col("n") - F.col("stay")).alias("gone")).filter("gone > 0")
    keyed = held.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("tag"))
    return drop_rows(keyed, gone, ["doc_id", "tag"])
