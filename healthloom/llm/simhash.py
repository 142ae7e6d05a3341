"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits over the XXH64 hashes of a text's word shingles.  Equal
fingerprints are one node, so a text's copies never meet each other.

Links (at most 3 differing bits) are found by two segments of 32 bits: one of
them differs in at most one bit.  Each fingerprint enters a table under both of
its segments; probes are the segment itself and the segments with one of its
*set* bits cleared (of two values one bit apart, one has the bit set, so a ball
of radius 1 is covered from one of its sides with half the probes).  Matches
are verified on all 64 bits.

A table bucket is *crowded* when more than ``CROWD`` fingerprints share a
segment.  Its members then differ in the other segment only, and that one is
indexed again: two sub-segments of 16 bits, one of which differs in at most one
bit.  What shares a segment and a sub-segment differs in 16 bits at most, so
the candidates of one fingerprint are bounded by a constant, whatever the
number of rows, and no pair is dropped.  Inside a dense group that constant can
still be hundreds for each member; such links are verified where they are found
and thinned there (``spanned``), so they are not shuffled.

Components: alternating large-star and small-star rounds (Kiryakov et al.'s
family of connected-component algorithms) on the links, until a round changes
nothing.  Each round is a written table.

One fingerprint finds what lies within 3 of 64 bits, which is far less than
all near copies.  With ``tables`` > 1 a text has that many fingerprints over
independently mixed hashes of the same shingles, and texts are linked when any
of them is within the bound: each table is an exact search as above, so links
between unlike texts stay as rare, while near copies have more chances to meet.
The component rounds work on the links that are left after thinning.
``nearcopies`` is the form for long shingles and similarities of 0.8.

Defined cases: null and word-less texts have fingerprint zero, linked like any
other; texts with fewer words than a shingle are one shingle; whole texts count,
however long; rows that tie on doc_id go by a hash of the text; repeated rows
share a component; an empty table gives an empty result; other columns are kept
by ``near_dedup`` and ignored by ``near_groups``, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, drop_rows, removed, shipped, short_batches
from .tokens import batches

shipped(__name__)

MAX_BITS = 3
CROWD = 256
#: Fingerprints of the stage that drops near copies; op4's groups have one.
TABLES = 8
MASK = 0xFFFFFFFF


def mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Hashes for one more fingerprint (table 0: as they are): the finaliser of SplitMix64 over shifted input."""
    if not table:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(table * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def fingerprints_of(words: list[bytes], shingle: int = 3, tables: int = 1, seed: int = 42) -> np.ndarray:
    """SimHashes of a word sequence, one per table: a bit is 1 if set in over half the shingles' hashes."""
    import xxhash

    if not words:
        return np.zeros(tables, "<u8")
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ones = np.zeros((tables, 64), np.int64)
    for at in range(0, n, 8192):
        upto = min(n, at + 8192)
        hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, upto)), "<u8", upto - at)
        for t in range(tables):
            bits = np.unpackbits(mixed(hashes, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[t] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3, tables: int = 1) -> DataFrame:
    """doc_id, tag (a hash of the text, which tells rows of one id apart), fps (64 bits in a long, one per table) of every whole text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
        for columns in batches(source):
            fps = [
                # bytes.split() cuts at the six ASCII white-space bytes and nothing else
                fingerprints_of((t or "").encode("utf-8", "replace").translate(lower).split(), shingle, tables).view(np.int64)
                for t in columns["text"]
            ]
            ids, tags = (pa.array(columns[c], pa.int64()) for c in ("doc_id", "tag"))
            yield pa.record_batch([ids, tags, pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "tag", "fps"])

    plain = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tag"))
    return plain.mapInArrow(run, "doc_id long, tag long, fps array<long>")


def _half(fp: Column, segment: Column) -> Column:
    low = fp.bitwiseAND(F.lit(MASK))
    return F.when(segment == 0, low).otherwise(F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(MASK)))


def _segments(nodes: DataFrame) -> DataFrame:
    """fp, key: table, segment (0 low, 1 high) and the segment's value in one number, the value in its low 32 bits."""
    held = nodes.select("t", "fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment"))
    place = F.shiftleft((F.col("t") * 2 + F.col("segment")).cast("long"), 32)
    return held.select("fp", (place + _half(F.col("fp"), F.col("segment"))).alias("key"))


def _cleared(value: Column, bits: int) -> Column:
    """The value, and it with each of its set bits cleared."""
    powers = F.lit([1 << k for k in range(bits)]).cast("array<bigint>")
    down = F.transform(F.filter(powers, lambda p: value.bitwiseAND(p) != 0), lambda p: value.bitwiseXOR(p))
    return F.concat(F.array(value), down)


def _ball(value: Column, bits: int) -> Column:
    """The value, and it with each bit flipped."""
    powers = F.lit([0, *[1 << k for k in range(bits)]]).cast("array<bigint>")
    return F.transform(powers, lambda p: value.bitwiseXOR(p))


def _sub(value: Column, part: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, (part * 16).cast("int")).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def _verified(pairs: DataFrame) -> DataFrame:
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return pairs.filter((F.col("a") != F.col("b")) & near)


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """t, a, b: all pairs a < b of fingerprints of one table (``nodes``: t, fp, distinct) at most 3 bits apart."""
    return _found(nodes, crowd).distinct()


def _found(nodes: DataFrame, crowd: int) -> DataFrame:
    """The pairs of ``links``, each as often as it is found, next to others that share its segment."""
    table = _segments(nodes)
    crowded = cut(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"))
    some = bool(crowded.take(1))
    probes = table.select(F.col("fp").alias("a"), F.explode(_cleared(F.col("key"), 32)).alias("key"))
    entries = table.select(F.col("fp").alias("b"), "key")
    plain = entries.join(crowded, "key", "left_anti") if some else entries
    found = _verified(probes.join(plain, "key")).select("key", "a", "b")
    if some:
        found = found.unionByName(_crowded_links(probes, entries, crowded))
    t = F.shiftright("key", 33).cast("int")
    return found.select(t.alias("t"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _crowded_links(probes: DataFrame, entries: DataFrame, crowded: DataFrame) -> DataFrame:
    segment = F.shiftright("key", 32).bitwiseAND(F.lit(1).cast("long"))
    other = lambda fp: _half(F.col(fp), 1 - segment)
    parts = F.explode(F.array(F.lit(0), F.lit(1))).alias("part")
    index = entries.join(crowded, "key", "left_semi").select("*", parts)
    index = index.withColumn("sub", _sub(other("b"), F.col("part")))
    asked = probes.join(crowded, "key", "left_semi").select("*", parts)
    asked = asked.withColumn("sub", F.explode(_ball(_sub(other("a"), F.col("part")), 16)))
    return _verified(asked.join(index, ["key", "part", "sub"])).select("key", "a", "b")


def spanned(edges: DataFrame, held: int = 1 << 18) -> DataFrame:
    """t, a, b: fewer links (``edges``: t, a, b) with the same components.

    A link goes only if those kept before it in its task connect its two ends
    already, so no component is lost; of a group whose pairs meet in one task
    one link less than it has members is left.  Each kept link is between the
    least values that its ends reach.  Beyond ``held`` values the task forgets
    what it has seen, which only leaves more links.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[tuple[int, int], tuple[int, int]] = {}

        def root(x: tuple[int, int]) -> tuple[int, int]:
            top = x
            while (above := parent.setdefault(top, top)) != top:
                top = above
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for batch in source:
            out = []
            for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("t", "a", "b")), strict=True):
                x, y = sorted((root((t, a)), root((t, b))))
                if x != y:
                    parent[y] = x
                    out.append((t, x[1], y[1]))
            columns = zip(*out) if out else ([], [], [])
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["t", "a", "b"])
            if len(parent) > held:
                parent.clear()

    return edges.select("t", "a", "b").mapInArrow(run, "t int, a long, b long")


def node_links(nodes: DataFrame, tables: int, crowd: int = CROWD) -> DataFrame:
    """a, b: links of nodes (node, fps) in any table, enough of them for the same components.

    Nodes with one value in a table are linked to the least of them, and links
    between values become links between those.  Links between values are
    thinned where they are found, so the pairs of a dense group do not reach
    the shuffles behind.
    """
    if tables == 1:
        return spanned(_found(nodes.select(F.lit(0).alias("t"), F.get("fps", F.lit(0)).alias("fp")), crowd)).select("a", "b")
    each = nodes.select("node", F.posexplode("fps").alias("t", "fp"))
    values = cut(each.groupBy("t", "fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    found = cut(spanned(_found(values.select("t", "fp"), crowd)).distinct())
    heads = lambda c: values.select("t", F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    far = found.join(heads("a"), ["t", "a"]).join(heads("b"), ["t", "b"]).select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    shared = values.filter("n > 1").select("t", "fp", "head")
    same = each.join(shared, ["t", "fp"]).filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return far.unionByName(same).distinct()


def pairs_of(*pairs: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> Column:
    """Rows of two columns each out of one row."""
    return F.inline(F.array(*[F.struct(F.col(a).alias(names[0]), F.col(b).alias(names[1])) for a, b in pairs]))


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) for every node of ``edges`` (a, b).

    Large-star: every node sends its larger neighbours to the least node it
    knows.  Small-star: every node sends its smaller neighbours and itself
    there.  A node's neighbours are not gathered: the least one is a partial
    aggregate, which is joined back.  Rounds go on until one changes nothing.

    Rounds are Parquet tables in the shared folder, gone when the next ones are
    written.  A checkpoint would keep the plan's size estimate, which each join
    multiplies: after some rounds it is a number of millions of digits.
    """
    spark = edges.sparkSession
    folder = f"{checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    steps = itertools.count()
    held: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        held.append(f"{folder}/{next(steps)}")
        df.write.parquet(held[-1])
        return spark.read.schema(df.schema).parquet(held[-1])

    def least(df: DataFrame) -> DataFrame:
        low = df.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # written first: a join of two plain exchanges is one whose crowded keys Spark can split
        return df.join(written(low), "u")

    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    settled = False
    while not settled:
        both = edges.select(pairs_of(("u", "v"), ("v", "u")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        small = least(large).select(pairs_of(("v", "m"), ("u", "m")))
        after = written(small.filter("u != v").distinct())
        settled = after.count() == edges.count() and not after.join(edges, ["u", "v"], "left_anti").take(1)
        edges = after
        while len(held) > 1:
            removed(spark, held.pop(0))
    roots = cut(edges.select(pairs_of(("u", "v"), ("v", "v"), names=("node", "root"))).distinct())
    removed(spark, folder)
    return roots


def grouped(docs: DataFrame, shingle: int = 3, crowd: int = CROWD, tables: int = TABLES) -> DataFrame:
    """doc_id, tag, fp (of the first table), best (struct: unnamed, doc_id, tag of its component's first row) for every row."""
    node = F.get("fps", F.lit(0)) if tables == 1 else F.xxhash64("fps")
    with short_batches(docs.sparkSession):
        rows = cut(fingerprints(docs, shingle, tables).withColumn("node", node))
    entry = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    nodes = cut(rows.groupBy("node", "fps").agg(F.min(entry).alias("low")))
    roots = components(node_links(nodes.select("node", "fps"), tables, crowd))
    least = nodes.select(F.col("node").alias("n_node"), "low")
    named = cut(roots.join(least, roots.node == F.col("n_node")).select("node", "root", "low"))
    lowest = cut(named.groupBy("root").agg(F.min("low").alias("best")))
    linked = named.join(lowest, "root").select(F.col("node").alias("l_node"), "best")
    every = least.join(linked, F.col("n_node") == F.col("l_node"), "left")
    every = cut(every.select("n_node", F.coalesce("best", "low").alias("best")))
    return rows.join(every, rows.node == every.n_node).select("doc_id", "tag", F.get("fps", F.lit(0)).alias("fp"), "best")


def near_groups(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links of one fingerprint reach."""
    return grouped(docs, shingle, crowd, tables=1).select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, tables: int = TABLES, **options) -> DataFrame:
    """One document of each group stays (the one with the least doc_id), all columns kept."""
    held = docs.select(F.struct(*docs.columns).alias("row"))
    groups = grouped(held.select("row.doc_id", "row.text"), tables=tables, **options)
    first = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.tag") == F.col("tag"))
    rows = groups.groupBy("doc_id", "tag", first.cast("long").alias("stay")).agg(F.count("*").alias("n"))
    gone = rows.select("doc_id", "tag", (F.col("n") - F.col("stay")).alias("gone")).filter("gone > 0")
    keyed = held.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("tag"))
    return drop_rows(keyed, gone, ["doc_id", "tag"])
