"""Repeated passages: words covered by a window that also starts in an earlier document go.

The suffixes of all texts are too many for one tree, so they are split by a
prefix into groups that fit into memory, and each group's subtree is built by
itself.

Which suffixes.  Of the ``grams`` of ``GRAM`` words in a window the one of least
hash (of equal ones the first) is the window's *anchor*.  Equal windows have
equal anchors at equal places, so it is enough to hang up the suffixes that
start at anchors, with the words in front of them read backward: a window is a
node of the tree of what follows its anchor and a node of the tree of what
stands before it.  A stretch of text around an anchor serves all windows that
chose it.

Prefixes.  An anchor's gram is the first prefix.  Grams that occur in one text
only lead to no common node and are left out by counting.  A gram with more than
``GROUP`` suffixes would not fit: there the prefix is made longer, up to the
whole window, whose suffixes then share one deep node by themselves, and all that
matters of that node, its least document, is taken by partial aggregation.

Subtrees.  The stretches of some grams are sorted by what follows the anchor; a
node of depth d is a run of neighbours with d words or more in common, and
likewise for what stands before it.  Windows that are in the same deep node of
both, at the same distance from the anchor, are equal; all but those of the least
document are marked.

Texts of equal words are one text, that of the least doc_id; in the others every
word goes if there is a window at all.

Defined cases: null and empty texts, and texts shorter than a window, lose
nothing; a null id is neither smaller nor larger than another, so its row loses
nothing and makes no other lose; rows of the same id (repeated rows, too) are no
reason for each other; a very long text is scanned whole; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, checkpoint_dir, cut, shipped

shipped(__name__)

WINDOW, GRAM = 50, 16
#: Suffixes of one prefix that are put in one subtree at most.
GROUP = 4096
#: Words that are hashed together, stretches that are sorted together, and windows of long prefixes that a task remembers.
TOGETHER, SORTED, HELD = 1 << 16, 4096, 200_000
#: Words' hashes that a Python worker remembers.
MEMO = 500_000

SCANNED = "doc_id long, tag long, n_words long, digest binary, anchors array<struct<gram:long,place:int,first:int,last:int>>"
STRETCH = "prefix long, kind int, doc_id long, tag long, place int, first int, last int, body binary"
#: Kinds of rows that are dealt by prefix: a stretch for a subtree, a window of a long prefix, a mark that is sure already.
TREE, NODE, MARK = 0, 1, 2


class _Words(dict):
    """word -> XXH64."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes() -> _Words:
    return vars(sys.modules.setdefault("_word_memo", types.ModuleType("_word_memo"))).setdefault("words", _Words())


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive word hashes (a power of two), by doubling."""
    held, factor, width = words, np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while width < gram:
            held = held[:-width] * factor + held[width:]
            factor, width = factor * factor, 2 * width
        held = (held ^ held >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return held ^ held >> np.uint64(29)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` consecutive values, of equal ones the first."""
    at, wide = np.arange(len(values)), 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while 2 * wide <= width:
        at, wide = least(at[:-wide], at[wide:]), 2 * wide
    rest = width - wide
    return least(at[:-rest], at[rest:]) if rest else at


def anchors(sizes: np.ndarray, hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, gram hash, place, first and last window start that chose it) of texts that lie side by side in ``hashes``."""
    base = np.cumsum(sizes) - sizes
    left = np.repeat(base + sizes, sizes) - np.arange(len(hashes))
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams = gram_hashes(hashes, gram)
    chosen = least_places(grams, window - gram + 1)[starts]
    fresh = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    place, first, last = chosen[fresh], starts[fresh], starts[np.r_[fresh[1:], len(starts)] - 1]
    text = np.repeat(np.arange(len(sizes)), sizes)[place]
    return text, grams[place].view(np.int64), place - base[text], first - base[text], last - base[text]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, tag (tells texts of one id apart), n_words, digest (SHA-256 of the words), anchors of every text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        known = word_hashes()
        kind = pa.struct([("gram", pa.int64()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])

        def told(ids: list, tags: list, digests: list, sizes: list, hashes: list) -> pa.RecordBatch:
            sizes = np.array(sizes, np.int64)
            text, *found = anchors(sizes, np.array(hashes, np.uint64))
            offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=len(sizes)))]
            each = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, kind)], fields=list(kind))
            columns = [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(sizes), pa.array(digests, pa.binary())]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
            return pa.record_batch([*columns, lists], names=["doc_id", "tag", "n_words", "digest", "anchors"])

        for batch in source:
            held: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or b"").split()
                for column, value in zip(held, (doc_id, tag, sha256(b" ".join(words)).digest(), len(words))):
                    column.append(value)
                held[4].extend(map(known.__getitem__, words))
                if len(held[4]) >= TOGETHER:
                    yield told(*held)
                    held = ([], [], [], [], [])
            if held[0]:
                yield told(*held)

    return keyed(docs).mapInArrow(run, SCANNED)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag, text; ``bytes.split()`` cuts the text at the six ASCII white-space bytes and nothing else."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))


def stretches(texts: DataFrame) -> DataFrame:
    """Rows to be dealt by prefix, of texts with ``cold`` and ``hot`` anchors."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        layout = pa.schema(
            [
                ("prefix", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()),
                ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("body", pa.binary()),
            ]
        )
        least: dict[bytes, tuple[int, int, set[int]]] = {}  # of each window the least document so far and where it stands there
        out: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), layout)], schema=layout)

        def sure(doc_id: int, tag: int, start: int) -> tuple:
            return (xxhash.xxh64_intdigest(str((doc_id, tag))) >> 1, MARK, doc_id, tag, 0, start, start, None)

        def node(window: bytes, doc_id: int, tag: int, starts: set[int]) -> tuple:
            """One row, however often a document repeats the window."""
            places = np.array(sorted(starts), "<i4").tobytes()
            return (int.from_bytes(window[:8], "little", signed=True), NODE, doc_id, tag, 0, 0, 0, window + places)

        for batch in source:
            names = batch.schema.names
            for k in range(batch.num_rows):
                row = {c: batch.column(names.index(c))[k].as_py() for c in ("doc_id", "tag", "text", "cold", "hot")}
                doc_id, tag, words = row["doc_id"], row["tag"], row["text"].split()
                for a in row["cold"]:
                    body = b" ".join(words[a["first"] : a["last"] + WINDOW])
                    out.append((a["gram"], TREE, doc_id, tag, a["place"], a["first"], a["last"], body))
                    size += len(body)
                for a in row["hot"]:
                    for start in range(a["first"], a["last"] + 1):
                        window = xxhash.xxh3_128_digest(b" ".join(words[start : start + WINDOW]))
                        before = least.get(window)
                        if before is None or doc_id < before[0]:
                            least[window] = (doc_id, tag, {start})
                            if before:
                                out.extend(sure(*before[:2], s) for s in before[2])
                        elif doc_id > before[0]:
                            out.append(sure(doc_id, tag, start))
                        elif tag == before[1]:
                            before[2].add(start)
                        else:  # another text of the same id
                            out.append(node(window, doc_id, tag, {start}))
                if len(least) > HELD:
                    out.extend(node(w, *x) for w, x in least.items())
                    least.clear()
                if size > 4 << 20 or len(out) > 20_000:
                    yield told()
                    out, size = [], 0
        out.extend(node(w, *x) for w, x in least.items())
        for at in range(0, len(out), 20_000):
            out, rest = out[:20_000], out[20_000:]
            if out:
                yield told()
            out = rest

    return texts.mapInArrow(run, STRETCH)


def common_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the rows of a matrix, and how many columns each has in common with the one before it (0 for the first)."""
    order = np.lexsort(rows.T[::-1])
    same = rows[order[1:]] == rows[order[:-1]]
    depth = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, np.r_[0, depth]


def nodes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The number of each row's node of that depth in the tree that ``common_prefixes`` tells."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(ids: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, bodies: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """(stretch, distance from the anchor) -> whether that window is in a document of smaller id, for stretches of some grams."""
    reach, n = window - gram, len(bodies)
    known: dict[bytes, int] = {}
    parts = [b.split(b" ") for b in bodies]
    sizes = np.fromiter(map(len, parts), np.int64, n)
    numbers = np.fromiter((known.setdefault(w, len(known)) for p in parts for w in p), np.int32, sizes.sum())
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first - at + reach, sizes)
    table = np.repeat(-1 - np.arange(n, dtype=np.int32)[:, None], reach + window, axis=1)  # what is no word is like nothing else
    table[row, column] = numbers
    after, before = common_prefixes(table[:, reach:]), common_prefixes(table[:, :reach][:, ::-1])
    by_id = np.argsort(ids, kind="stable")
    out = np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        some = by_id[(at - last)[by_id] <= o]
        some = some[(at - first)[some] >= o]
        if len(some) > 1:
            both = nodes_at(*after, window - o)[some] * (n + 1) + nodes_at(*before, o)[some]
            _, least, node = np.unique(both, return_index=True, return_inverse=True)
            out[some, o] = ids[some] > ids[some[least]][node]
    return out


def marks(dealt: DataFrame) -> DataFrame:
    """doc_id, tag, start, windows: runs of marked windows, of rows that lie by prefix."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tag", "start", "windows"]

        def of_trees(rows: pa.Table) -> pa.RecordBatch:
            ids, tags, at, first, last = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "tag", "place", "first", "last"))
            found = repeated_windows(ids, at, first, last, rows.column("body").to_pylist())
            # by window start: the largest distance first
            steps = np.diff(np.pad(found[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (row, begin), (_, end) = np.nonzero(steps == 1), np.nonzero(steps == -1)
            start = at[row] - (found.shape[1] - 1) + begin
            return pa.record_batch([pa.array(c) for c in (ids[row], tags[row], start, end - begin)], names=names)

        def of_nodes(rows: pa.Table) -> pa.RecordBatch:
            least: dict[bytes, int] = {}
            told = list(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "tag", "body"))))
            for k, _, body in told:
                least[body[:16]] = min(k, least.get(body[:16], k))
            gone = [(k, tag, start, 1) for k, tag, body in told if k > least[body[:16]] for start in np.frombuffer(body[16:], "<i4").tolist()]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*gone)] if gone else [pa.array([], pa.int64())] * 4, names=names)

        def sure(rows: pa.Table) -> pa.RecordBatch:
            tags, first = rows.column("tag").combine_chunks(), rows.column("first").cast(pa.int64()).combine_chunks()
            return pa.record_batch([rows.column("doc_id").combine_chunks(), tags, first, pa.array(np.ones(len(first), np.int64))], names=names)

        def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            kinds = rows.column("kind").to_numpy()
            for kind, f in ((TREE, of_trees), (NODE, of_nodes), (MARK, sure)):
                if (kinds == kind).any():
                    yield f(rows.filter(pa.array(kinds == kind)))

        held: list[pa.RecordBatch] = []
        for batch in source:
            held.append(batch)
            if sum(b.num_rows for b in held) < SORTED:
                continue
            rows = pa.Table.from_batches(held)
            prefix = rows.column("prefix").to_numpy()
            at, whole = 0, int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
            while at < whole:
                stop = int(np.searchsorted(prefix, prefix[min(whole, at + SORTED) - 1], "right"))
                yield from told(rows.slice(at, stop - at))
                at = stop
            held = rows.slice(whole).to_batches()
        if held:
            yield from told(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "doc_id long, tag long, start long, windows long")


def merged(found: DataFrame) -> DataFrame:
    """doc_id, tag, spans (start, length of what goes, apart from each other), of ``marks`` in arrays of one row a text."""

    @F.arrow_udf("array<struct<start:long,length:long>>")
    def spans(column: pa.Array) -> pa.Array:
        out = []
        for runs in column.to_pylist():
            own: list[list[int]] = []
            for r in sorted(runs, key=lambda r: r["start"]):
                end = r["start"] + r["windows"] + WINDOW - 1
                if own and r["start"] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([r["start"], end])
            out.append([{"start": a, "length": b - a} for a, b in own])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))

    return found.select("doc_id", "tag", spans("runs").alias("spans"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The texts of ``listed`` (written, doc_id and tag once each) with its columns; other texts stay where they are."""
    some = KeyFilter(listed.select("doc_id", "tag"), ["doc_id", "tag"]).passed(keyed(docs), ["doc_id", "tag"])
    return some.join(listed, ["doc_id", "tag"])


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, tag, n_words, digest (of all words), spans (start, length of passages that an earlier document has) of every row."""
    rows = written(scanned(docs), "scanned")
    able = rows.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    classes = cut(able.groupBy("digest").agg(F.min("doc_id").alias("least")))
    every = able.select("doc_id", "tag", F.xxhash64("digest").alias("text"), F.inline("anchors"))
    grams = every.groupBy("gram").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count("*").alias("n"))
    grams = cut(grams.filter("low != high").select("gram", (F.col("n") > group).alias("crowded")))
    found = KeyFilter(grams, ["gram"]).passed(every, ["gram"]).join(grams, "gram")
    anchor = F.struct("gram", "place", "first", "last")
    of_texts = found.groupBy("doc_id", "tag").agg(
        F.collect_set(F.when(~F.col("crowded"), anchor)).alias("cold"), F.collect_set(F.when(F.col("crowded"), anchor)).alias("hot")
    )
    named = able.select("doc_id", "tag", "digest").join(classes, "digest")
    firsts = named.filter("doc_id = least").select("doc_id", "tag").distinct()
    of_texts = written(of_texts.join(firsts, ["doc_id", "tag"]), "anchors")
    dealt = stretches(texts_of(docs, of_texts)).repartition("prefix").sortWithinPartitions("prefix")
    runs = marks(dealt).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    gone = merged(runs).select(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag"), "spans")
    copies = named.filter("doc_id > least").select("doc_id", "tag").distinct().select(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag"), F.lit(None).cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    gone = gone.unionByName(copies).withColumn("copy", F.col("spans").isNull())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))
    same = (F.col("doc_id") == F.col("m_id")) & (F.col("tag") == F.col("m_tag"))
    return rows.join(gone, same, "left").select(
        "doc_id", "tag", "n_words", "digest", F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint>>"))).alias("spans")
    )


def kept_texts(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, n_removed, kept (the words left, joined by one space) of the rows whose (doc_id, tag) is in ``listed`` (written; with spans)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            names = batch.schema.names
            out = []
            for k in range(batch.num_rows):
                doc_id, tag, text, spans = (batch.column(names.index(c))[k].as_py() for c in ("doc_id", "tag", "text", "spans"))
                words, left, at = text.split(), [], 0
                for span in spans:
                    left.extend(words[at : span["start"]])
                    at = span["start"] + span["length"]
                left.extend(words[at:])
                out.append((doc_id, tag, len(words), len(words) - len(left), b" ".join(left)))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.record_batch([*columns[:4], columns[4].cast(pa.string())], names=["doc_id", "tag", "n_words", "n_removed", "kept"])

    return texts_of(docs, listed).mapInArrow(run, "doc_id long, tag long, n_words long, n_removed long, kept string")


def removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left) of every row; texts move only where some words stay and some go."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    found = written(repeats(docs).withColumn("n_removed", removed), "repeats")
    some = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words"))
    plain = found.filter(~some).select(
        "doc_id", "n_words", "n_removed", F.when(F.col("n_removed") > 0, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256")
    )
    listed = cut(found.filter(some).select("doc_id", "tag", "spans").dropDuplicates(["doc_id", "tag"]))
    texts = kept_texts(docs, listed).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return plain.unionByName(texts)


#: The same rows by the windows themselves.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS start FROM d),
g AS (SELECT doc_id, start, sha256(array_to_string(w[start:start + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT DISTINCT doc_id, start FROM g JOIN f USING (h) WHERE doc_id > first),
p AS (SELECT DISTINCT doc_id, start + k AS i FROM m, (SELECT unnest(range(0, 50)) AS k)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN p USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
