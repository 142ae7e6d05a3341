"""Periodic runs of words, found on the harmonic grid.

A *run* is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``LEAST`` words and two periods long, that no word next
to it extends.  Every stretch of two periods p holds two neighbouring points of
the grid 0, p, 2p, ..., so for each p the longest common extensions forward and
backward of jp and (j+1)p find all runs; over all p these are n ln n points.

Extensions are range minima over the prefix lengths of neighbours in the suffix
array, for the backward ones in that of the reversed words.  The suffix array is
made by prefix doubling in numpy.  Texts of a batch are handled together: a word
of one text is never a word of another, and a text ends in a symbol of its own.

A run has at least max(p, LEAST - p) words that equal the word p later, next to
each other, and the grid point is one of them.  So a point can only count if
its own words are equal and those on one side are too; the others are left out
before anything is queried, and a text without a point left needs no arrays.

Defined cases: a null text has no words and no runs; an empty text likewise;
a very long text is worked on whole, by itself, in about 200 bytes for a word
and doubling; repeated rows and null ids give a row each; of equal ends the
smallest period counts, so no tie is left; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, shipped

shipped(__name__)

#: Fewest words of a run.
LEAST = 12
#: Words that are worked on together, unless one text has more.
TOGETHER = 1 << 16

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, ranks, and the ranks by the first 1, 2, 4, ... symbols."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank.astype(np.int32)], 1
    while True:
        key = rank * (n + 1)
        if width < n:
            key[:-width] += rank[width:] + 1
        order = np.argsort(key)
        fresh = np.empty(n, bool)
        fresh[:1] = False
        np.not_equal(key[order[1:]], key[order[:-1]], out=fresh[1:])
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order, rank, levels
        levels.append(rank.astype(np.int32))
        width *= 2


class Extensions:
    """Longest common extensions of two places: suffix array, prefix lengths of neighbours, range minima."""

    def __init__(self, symbols: np.ndarray):
        order, self.rank, levels = suffix_ranks(symbols)
        a, b = order[:-1].copy(), order[1:].copy()
        common, n = np.zeros(len(a), np.int32), len(symbols)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for moved in (a, b, common):
                moved[same] += 1 << k
        del levels
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from ``a`` and from ``b`` on (a != b)."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def grid(sizes: np.ndarray, points: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, p, place) of the harmonic grids of texts with ``sizes`` words, about ``points`` at a time."""
    halves = sizes // 2
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    many = (sizes[text] - 1) // period  # places 0, p, ... with another one p later
    upto = np.cumsum(many)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + points)))
        some = many[at:stop]
        number = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        p = np.repeat(period[at:stop], some)
        yield np.repeat(text[at:stop], some), p, number * p
        at = stop


def found_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (words as numbers): its runs as rows of start, length, period, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    # a symbol of its own behind each text, and one in front of all
    words = np.concatenate([x for k, t in enumerate(texts) for x in (t, [-1 - k])]) if texts else np.zeros(0, np.int64)
    none = np.zeros((0, 3), np.int64)
    kept = []
    for text, p, place in grid(sizes):
        a = base[text] + place
        hit = np.flatnonzero(words[a] == words[a + p])
        text, p, a = text[hit], p[hit], a[hit]
        # of LEAST / 2 or more equal words in a row one neighbour is equal as well
        beside = (words[a + 1] == words[np.minimum(a + p + 1, len(words) - 1)]) | (words[a - 1] == words[a + p - 1]) & (a > base[text])
        kept.append((text[beside], p[beside], a[beside]))
    if not sum(len(k[0]) for k in kept):
        return [none] * len(texts)
    text, p, a = (np.concatenate(x) for x in zip(*kept))
    # arrays are made of the texts that have a point left
    some = np.unique(text)
    inner = np.zeros(len(texts), np.int64)
    lengths = sizes[some] + 1
    inner[some] = np.cumsum(lengths) - lengths
    parts = [words[base[k] : base[k] + sizes[k] + 1] for k in some]
    owner = np.repeat(np.arange(len(some)), lengths)
    own = np.concatenate(parts)
    symbols = np.unique(own, return_inverse=True)[1] + owner * (int(len(own)) + 1)
    a += inner[text] - base[text]
    n = len(symbols)
    forward = Extensions(symbols).of(a, a + p)
    back = np.zeros(len(a), np.int64)
    room = np.flatnonzero(a > inner[text])
    back[room] = Extensions(symbols[::-1].copy()).of(n - a[room], n - a[room] - p[room])
    start, length = a - back - inner[text], p + forward + back
    good = np.flatnonzero((length >= 2 * p) & (length >= LEAST))
    text, start, length, p = (x[good] for x in (text, start, length, p))
    order = np.lexsort((p, length, start, text))
    rows = np.stack((text, start, length, p), axis=1)[order]
    if len(rows):  # the smallest period of a stretch
        rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[x:y, 1:] for x, y in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds behind its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every text.

    No row is shuffled: texts are worked on where they are read.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def told(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = found_runs([numbered(t) for t in texts])
            offsets = np.cumsum([0, *map(len, runs)])
            columns = np.concatenate(runs).T
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind.value_type)))
            text = pa.array([collapsed(t, r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            return pa.record_batch([pa.array(ids, pa.int64()), sizes, spans.cast(kind), text], names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in source:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                # bytes.split() cuts at the six ASCII white-space bytes and nothing else
                texts.append((text.as_py() or b"").split())
                size += len(texts[-1]) + 1
                if size >= TOGETHER:
                    yield told(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield told(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document (by the CRC of its id) the words from some place on repeat a period.

    A null id has no CRC, so its text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    n = F.size("words").cast("long")
    g = F.floor(h / 10)
    edited = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")
    ).select("doc_id", "text", "words", "g", n.alias("n"), (F.col("g") % F.when(n > 0, n)).alias("a"))
    edited = edited.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1)
    again = F.transform(tail, lambda i: F.get("words", (F.col("a") + i % F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return edited.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equal ones the first, then the one of smaller period), digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    told = found.withColumn("best", best)
    length = -F.col("best.less")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("-1000 * best.less div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
