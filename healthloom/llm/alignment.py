"""Alignment of two tokenizers over whole texts, and how often their tokens meet.

A is a byte-level BPE of the ``tokenizers`` library over space + text, B a
``sentencepiece`` model over the text, which adds the space itself.  Strings of
special tokens inside a text are plain text for both.  Tokens of both tile the
same bytes.  The *overlap graph* joins an A token and a B token that share a
byte; its connected components, found by union-find, are exactly the groups
between byte offsets where tokens of both end.  The members of a component are
expanded into its links, the pairs of it that overlap.

Neither tokenizer merges across a space that follows a character which is no
white space, and both end a token there.  So a text is cut into *chunks* at
those spaces and the graph of a chunk is worked out once for as often as it
comes (a bounded memo per Python worker).  Tokenizer files without that property
are noticed, and each of their texts is one chunk.

Pair counting is distributed: tasks add up the links of an id pair before the
shuffle.  Documents then look their pairs up.  The most frequent ``LOOKED_UP``
pairs are broadcast at most; rarer ones are joined with the count table.

Defined cases: null and empty texts, and texts whose tokens do not spell
space + text (U+2581 inside, say), have no tokens, zeros and no groups; a very
long text is worked on whole; ties for a B id's highest count are all highest;
repeated rows and null ids give a row each and count each; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
import types
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, shipped, short_batches
from .tokens import MARKS, WHITE, batches, byte_letters, is_plain_byte_level

shipped(__name__)

#: Pairs that are broadcast at most (17 bytes each).
LOOKED_UP = 1 << 20
#: Chunks in each of the memo's two generations, and the longest chunk that it keeps.
MEMO, LONGEST = 120_000, 64
#: Different pairs that a task adds up before it hands them on.
SUMMED = 1 << 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def components(a_ends: list[int], b_ends: list[int]) -> list[tuple[list[int], list[int]]]:
    """Connected components of the overlap graph: (A tokens, B tokens) by number, in the order of the text.

    Nodes are the A tokens, then the B tokens; tokens of each tile the bytes up to their last end.
    """
    n_a, n_b = len(a_ends), len(b_ends)
    parent = list(range(n_a + n_b))
    i = j = 0
    while i < n_a and j < n_b:  # an edge for each overlap
        x, y = i, n_a + j
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:  # the root of a component is its first A token
            parent[y] = x
        elif y < x:
            parent[x] = y
        a, b = a_ends[i], b_ends[j]
        if a <= b:
            i += 1
        if b <= a:
            j += 1
    members: dict[int, tuple[list[int], list[int]]] = {}
    for k, x in enumerate(parent):
        while parent[x] != x:
            x = parent[x]
        if k < n_a:
            if x == k:
                members[k] = ([k], [])
            else:
                members[x][0].append(k)
        else:
            members[x][1].append(k - n_a)
    return list(members.values())


def links(group: tuple[list[int], list[int]], a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """The pairs of a component's members that share a byte."""
    many, others = group
    if len(many) == 1 or len(others) == 1:
        return [(i, j) for i in many for j in others]
    out, at = [], 0
    for i in many:
        start = a_ends[i - 1] if i else 0
        while b_ends[others[at]] <= start:
            at += 1
        k = at
        while k < len(others) and (b_ends[others[k] - 1] if others[k] else 0) < a_ends[i]:
            out.append((i, others[k]))
            k += 1
    return out


class Aligner:
    """The two tokenizers and the memo of aligned chunks.  One per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        size, vocab = self.b.get_piece_size(), self.a.get_vocab()
        self.letters, self.word = byte_letters(), self.a.model.tokenize
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        self.names = [str(k) for k in range(max(len(self.a_bytes), size))]
        for spelled, k in vocab.items():
            inside = all(c in letters for c in spelled)
            self.a_bytes[k] = bytes(letters[c] for c in spelled) if inside else spelled.encode()
        pieces = [self.b.id_to_piece(k) for k in range(size)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        spec = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as model:
            spec.ParseFromString(model.read())
        with open(a_path, encoding="utf-8") as model:
            plain = is_plain_byte_level(model.read())
        rules = spec.normalizer_spec
        plain &= rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        plain &= not any("▁" in p.lstrip("▁") for p in pieces) and "▁" in pieces
        self.plain = plain
        self.prefix = self.b.piece_to_id("▁")
        self.spaced = re.compile(f"[{WHITE}] ").search
        self.before = re.compile(f"(?<=[^{WHITE}])(?= )").split
        # no piece goes on from a letter to one of these, and A ends a token there as well
        self.marks = {m for m in MARKS if not any(c == m and p[k - 1].isalpha() for p in pieces for k, c in enumerate(p) if k)} if plain else set()
        self.mark = {m: self.aligned(m, [vocab[m]], [self.b.piece_to_id(m)], "") for m in self.marks}
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def lettered(self, chunk: str) -> bool:
        """Whether A's pre-tokenizer leaves space + chunk whole, so its model may take it at once."""
        return self.plain and chunk.isalpha()

    def chunks(self, text: str) -> list[str]:
        """What stands between two boundaries of space + text, each without the space in front of it."""
        if not self.plain:
            return [text]
        if text[:1] != " " and self.spaced(text) is None:
            return text.split(" ")
        return [c[1:] for c in self.before(" " + text)]

    def aligned(self, chunk: str, a: list[int], b: list[int], space: str = " ") -> tuple | None:
        """n_a, n_b, n_groups, n_links, pairs, the groups spelled; None if the tokens do not spell space + chunk."""
        spelled = (space + chunk).encode("utf-8", "replace")
        a_bytes, b_bytes, names = self.a_bytes, self.b_bytes, self.names
        a_parts, b_parts = [a_bytes[k] for k in a], [b_bytes[k] for k in b]
        if b"".join(a_parts) != spelled or b"".join(b_parts) != spelled:
            return None
        if len(a) == 1 or len(b) == 1:  # the one token overlaps all of the other side
            pairs = [x << 32 | y for x in a for y in b]
            return len(a), len(b), 1, len(pairs), array("q", pairs).tobytes(), f"{','.join([names[x] for x in a])}|{','.join([names[y] for y in b])}"
        a_ends, b_ends = list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts)))
        pairs, text = [], []
        found = components(a_ends, b_ends)
        for m, o in found:
            if len(m) == 1 == len(o):
                x, y = a[m[0]], b[o[0]]
                pairs.append(x << 32 | y)
                text.append(f"{names[x]}|{names[y]}")
            else:
                pairs.extend([a[i] << 32 | b[j] for i, j in links((m, o), a_ends, b_ends)])
                text.append(f"{','.join([names[a[i]] for i in m])}|{','.join([names[b[j]] for j in o])}")
        return len(a), len(b), len(found), len(pairs), array("q", pairs).tobytes(), ";".join(text)

    def of(self, texts: list[str]) -> list[list[tuple | None]]:
        """The aligned chunks of each text; chunks that are new are encoded together."""
        cuts = [self.chunks(t) if t else [] for t in texts]
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new, marked = [], []

        def look(chunk: str) -> None:
            if chunk in old:
                young[chunk] = old[chunk]
            else:
                new.append(chunk)

        for chunk in set().union(*cuts).difference(young):
            if chunk[-1:] in self.marks and chunk[:-1].isalpha():  # letters and one mark: two parts
                marked.append(chunk)
            else:
                look(chunk)
        for word in {c[:-1] for c in marked}.difference(young, new):
            look(word)
        if new:
            new.sort(key=self.lettered)
            at = bisect_left(new, True, key=self.lettered)
            a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in new[:at]], add_special_tokens=False)]
            a += [[t.id for t in self.word((" " + c).encode().decode("latin-1").translate(self.letters))] for c in new[at:]]
            b = self.b.encode(new, num_threads=1)
            for chunk, x, y in zip(new, a, b):
                young[chunk] = self.aligned(chunk, x, y or [self.prefix])
        for chunk in marked:
            word, mark = young[chunk[:-1]], self.mark[chunk[-1]]
            young[chunk] = word and (*(x + y for x, y in zip(word[:4], mark)), word[4] + mark[4], f"{word[5]};{mark[5]}")
        out = [list(map(young.__getitem__, chunks)) for chunks in cuts]
        for chunk in new:
            if len(chunk) > LONGEST:
                del young[chunk]
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    held = vars(sys.modules.setdefault("_align_memo", types.ModuleType("_align_memo")))
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Aligner(a_path, b_path)
    return held[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document: counts, ``groups`` (`a1,a2|b1;a3|b2,b3`), and its different id pairs (a << 32 | b) with how often each is linked.

    ``row`` tells rows apart once the result is written.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        kinds = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
        names = [part.split()[0] for part in ALIGNED.split(", ")]
        for columns in batches(source):
            out = []
            for doc_id, parts in zip(columns["doc_id"], both.of([t or "" for t in columns["text"]])):
                if None in parts:
                    parts = []
                a, b, groups, n, pairs, spelled = zip(*parts) if parts else ((),) * 6
                pair, times = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
                out.append((row, doc_id, sum(a), sum(b), sum(groups), sum(n), ";".join(spelled), pair.tobytes(), times.astype("<i4").tobytes()))
                row += 1
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column, and how many each has."""
    parts = [v.as_buffer() for v in column]
    sizes = np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), sizes


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links that hold it), best (whether no pair of its B id has more)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(pairs), pa.array(sums)], names=["pair", "n"])

        for batch in source:
            more, times = (_joined(batch.column(k), kind)[0] for k, kind in ((0, "<i8"), (1, "<i4")))
            pairs, at = np.unique(np.concatenate((pairs, more)), return_inverse=True)
            sums = np.bincount(at, np.concatenate((sums, times)), len(pairs)).astype(np.int64)
            if len(pairs) > SUMMED:
                yield told()
                pairs, sums = pairs[:0], sums[:0]
        if len(pairs):
            yield told()

    counted = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = counted.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))
    return counted.join(most, F.col("b") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> int:
    """The least n so that at most ``most`` pairs (of a written table) are linked as often: a power of two."""
    many = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("rows")).collect()
    least, rows = 1 << 62, 0
    for r in sorted(many, key=lambda r: -r.power):
        rows += r.rows
        if rows > most:
            break
        least = 1 << r.power
    return least


def scored(aligned: DataFrame, counts: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """``aligned`` (written) with n_best and count_sum: links of a highest count, and the sum of the counts over links."""
    spark = aligned.sparkSession
    counts = cut(counts)
    least = frequent(counts, looked_up)
    table = counts.filter(F.col("n") >= least).toArrow()
    pairs, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((pairs[order], n[order], best[order].astype(np.int64)))
    kept = [f.name for f in aligned.schema if f.name not in ("pairs", "times", "row")]

    @F.arrow_udf("n_best long, count_sum long, rest array<struct<pair:long,times:long>>")
    def looked(pairs: pa.Array, times: pa.Array) -> pa.Array:
        keys, n, best = sent.value
        pair, sizes = _joined(pairs, "<i8")
        many = _joined(times, "<i4")[0].astype(np.int64)
        known = np.zeros(len(pair), bool)
        values = np.zeros((2, len(pair)), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            known = keys[at] == pair
            values[:] = many * best[at] * known, many * n[at] * known
        ends = np.r_[0, np.cumsum(sizes)]
        sums = [np.diff(np.r_[0, np.cumsum(v)][ends]) for v in values]
        rest = pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(many[~known])], ["pair", "times"])
        offsets = pa.array(np.r_[0, np.cumsum(~known)][ends], pa.int32())
        return pa.StructArray.from_arrays([*map(pa.array, sums), pa.ListArray.from_arrays(offsets, rest)], ["n_best", "count_sum", "rest"])

    told = aligned.withColumn("told", looked("pairs", "times")).select("row", *kept, "told.*")
    rare = counts.filter(F.col("n") < least)
    if rare.take(1):
        told = written(told, "scored")
        more = told.select(F.col("row").alias("r"), F.inline("rest")).join(rare, "pair").groupBy("r")
        more = more.agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
        told = told.join(more, F.col("row") == F.col("r"), "left").select(*kept, *sums)
    return told.select(*kept, "n_best", "count_sum")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align_and_count(docs: DataFrame, a_path: str, b_path: str, looked_up: int = LOOKED_UP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every document."""
    with short_batches(docs.sparkSession):
        aligned = written(align(docs, a_path, b_path), "aligned")
    return scored(aligned, pair_counts(aligned), looked_up)
