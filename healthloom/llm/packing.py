"""Best-fit packing of pieces into sequences of a fixed capacity.

A piece's length is a whole number up to the capacity, so the packing is
solved on the *counts per length*: at most ``capacity`` numbers reach the
driver, however many pieces there are.  Pieces above a third of the capacity
are matched first, at most two to a sequence: the largest one that is left
takes the largest partner that fits.  Smaller pieces then fill the smallest
gap that holds them, largest first (best fit).  All sequences with one content
form a *pattern*, and whole groups of equal pieces and equal gaps are dealt at
once, which is the same packing that one piece at a time would give.

The plan lists, per length, which ranks go to which pattern, sequence and
offset.  Each piece gets its rank among those of its length in two steps
(counts per length and bucket, then ranks inside the bucket), so no length,
however common, meets in one task.

Defined cases: lengths below 1 or above the capacity are an error; equal
lengths are dealt by their ranks (bucket, then id and piece); repeated rows are
packed each; null ids are ids of their own; a null text is its end id alone; a
very long text is cut into pieces of the capacity, the first one shorter; an
empty table gives no sequences; other columns of documents are ignored, those of
pieces kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, cut, shipped, short_batches, spread

shipped(__name__)


def match_large(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pairs (or single pieces) of lengths above a third of the capacity, with how often."""
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    lengths = sorted(left, reverse=True)
    out = []
    for n in lengths:
        while left[n]:
            # partners are at most as long: longer pieces have been dealt already
            mate = next((m for m in lengths if m <= n and m <= capacity - n and left[m] - (m == n) > 0), None)
            if mate is None:
                out.append(((n,), left[n]))
                left[n] = 0
            else:
                times = left[n] // 2 if mate == n else min(left[n], left[mate])
                left[n] -= times
                left[mate] -= times
                out.append(((n, mate), times))
    return out


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, copies), ...) and how many sequences have each."""
    gaps: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(pattern: tuple, gap: int, times: int) -> None:
        if times:
            gaps.setdefault(gap, []).append((pattern, times))

    for pair, times in match_large(counts, capacity):
        put(tuple(sorted(Counter(pair).items(), reverse=True)), capacity - sum(pair), times)
    for n in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        todo = counts[n]
        for gap in sorted(g for g in gaps if g >= n):
            held = gaps.pop(gap)
            while held and todo:
                pattern, times = held.pop()
                each = gap // n
                full = min(times, todo // each)
                put((*pattern, (n, each)), gap - n * each, full)
                todo -= full * each
                times -= full
                if times and todo:  # fewer than one sequence's share is left
                    put((*pattern, (n, todo)), gap - n * todo, 1)
                    times, todo = times - 1, 0
                put(pattern, gap, times)
            for pattern, times in held:
                put(pattern, gap, times)
            if not todo:
                break
        if todo:
            each = capacity // n
            put(((n, each),), capacity - n * each, todo // each)
            if rest := todo % each:
                put(((n, rest),), capacity - n * rest, 1)
    return [item for held in gaps.values() for item in held]


def plan(counts: Counter, capacity: int) -> dict[int, tuple[list[int], list[int], list[int], list[int]]]:
    """length -> (first ranks, pieces per sequence, first sequences, first offsets), by rank."""
    used: Counter = Counter()
    out: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
    sequence = 0
    for pattern, times in best_fit(counts, capacity):
        offset = 0
        for n, each in pattern:
            ranks, per, first, start = out.setdefault(n, ([], [], [], []))
            ranks.append(used[n])
            per.append(each)
            first.append(sequence)
            start.append(offset)
            used[n] += each * times
            offset += n * each
        sequence += times
    assert used == Counter({n: c for n, c in counts.items() if c})
    return out


def pack(pieces: DataFrame, capacity: int, key: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """``pieces`` (written before: it is read twice) with sequence_id and offset."""
    counts = Counter({r[0]: r[1] for r in pieces.groupBy(F.col(length).cast("int")).count().collect()})
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"a piece's length must be from 1 to {capacity}")
    dealt = pieces.withColumn("_bucket", bucket_of([F.col(k) for k in key], spread(pieces.sparkSession, 256)))
    group = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(length, "_bucket", F.coalesce(F.sum("_n").over(group), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*key))
    ranked = dealt.withColumn("_place", place).join(starts, [length, "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_place") - 1).select(*pieces.columns, "_rank")
    table = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))  # bounded by the capacity

    def place_all(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        arrays = {n: tuple(map(np.array, x)) for n, x in table.value.items()}
        for batch in source:
            n = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for value in np.unique(n):
                at = np.flatnonzero(n == value)
                ranks, per, first, start = arrays[int(value)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                inside = rank[at] - ranks[k]
                sequence[at] = first[k] + inside // per[k]
                offset[at] = start[k] + inside % per[k] * value
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(place_all, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents, tokenised, cut and packed: one row per piece."""
    from .tokens import cut_pieces

    with short_batches(docs.sparkSession):
        pieces = cut(cut_pieces(docs, tokenizer_path, capacity, end_id))
    return pack(pieces, capacity)


def sequences(packed: DataFrame, capacity: int) -> DataFrame:
    """sequence_id, ids (binary), lengths: pieces that carry ``ids`` joined in offset order; at most ``capacity`` ids each."""
    part = F.struct("offset", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda held, x: F.concat(held, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.length").alias("lengths"))
