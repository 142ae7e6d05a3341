"""Token files: patched frame-of-reference blocks of ids.

A *segment* holds the ids of a run of documents in ascending id order::

    magic "PFB2" | u32 block size | u32 blocks | u32 exceptions | u64 ids in all
    per block (the index): u32 start of its packed values | u32 number of its first exception
                           u32 minimum | u32 width
    packed values of all blocks | u16 positions of all exceptions | u32 values of all exceptions

Values are ids less the block's minimum, packed at the width that the chosen
percentile of the block's values needs, the first value in the lowest bits;
what does not fit is packed as zero and stored whole in the exception list.
The index gives block k without reading the others.

A token *file set* is a Parquet table (the container, so that any store that
Spark writes will do) with a row per segment: shard, segment, its documents'
ids and lengths, and the bytes above.  Shards are ranges of document ids, so
the files are in ascending order; a document's place in the whole is its
shard's start (one number per shard) plus its place in the shard.

Defined cases: a null text is empty and gives the end id alone; a null id
comes first; repeated ids lie side by side; a very long text makes its segment
longer and is never cut; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shipped, short_batches
from .tokens import batches, encoder

shipped(__name__)

MAGIC = b"PFB2"
HEAD = "<4sIIIQ"
INDEX = np.dtype([("start", "<u4"), ("first", "<u4"), ("low", "<u4"), ("width", "<u4")])
BLOCK = 512
PERCENTILE = 90
#: A segment is closed when it has so many ids.
SEGMENT_IDS = 1 << 18

SCHEMA = "shard int, segment int, doc_ids array<long>, lengths array<long>, n_ids long, body binary"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, n) values of at most ``width`` bits -> (rows, bytes).

    64 values fill ``width`` words of 64 bits, so value i of each 64 goes by one
    shift to word i * width / 64, and its upper part, if it has one, to the next.
    """
    rows, n = values.shape
    groups = -(-n // 64)
    lanes = np.zeros((64, rows * groups), np.uint64)
    padded = np.zeros((rows, groups * 64), np.uint64)
    padded[:, :n] = values
    lanes[:] = padded.reshape(rows * groups, 64).T
    words = np.zeros((width + 1, rows * groups), np.uint64)
    for i in range(64):
        word, at = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(at)
        if at + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - at)
    packed = np.ascontiguousarray(words[:width].T).astype("<u8").view(np.uint8)
    return packed.reshape(rows, -1)[:, : packed_size(n, width)]


def packed_size(n: int, width: int) -> int:
    return (n * width + 7) // 8


def unpack_bits(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The reverse of ``pack_bits``: (rows, bytes) -> (rows, n)."""
    rows, groups = len(packed), -(-n // 64)
    whole = np.zeros((rows, groups * width * 8), np.uint8)
    whole[:, : packed.shape[1]] = packed
    words = np.zeros((width + 1, rows * groups), np.uint64)
    words[:width] = whole.view("<u8").reshape(rows * groups, width).T
    lanes, mask = np.empty((64, rows * groups), np.uint64), np.uint64((1 << width) - 1)
    for i in range(64):
        word, at = divmod(i * width, 64)
        lanes[i] = words[word] >> np.uint64(at)
        if at + width > 64:
            lanes[i] |= words[word + 1] << np.uint64(64 - at)
    lanes &= mask
    return np.ascontiguousarray(lanes.T).reshape(rows, -1)[:, :n].astype(np.uint32)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """ids (unsigned 32-bit) -> the bytes of a segment.  Blocks have at most 65,536 ids."""
    n, blocks = len(ids), -(-len(ids) // block)
    padded = np.zeros(blocks * block, np.uint32)
    padded[:n] = ids
    if n % block:
        padded[n:] = ids[n // block * block :].min()  # fits the last block's frame
    grid = padded.reshape(blocks, block)
    index = np.zeros(blocks, INDEX)
    if not blocks:
        return struct.pack(HEAD, MAGIC, block, 0, 0, 0)
    index["low"] = grid.min(axis=1)
    rest = grid - index["low"][:, None]
    needs = bit_lengths(rest)
    at = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    widths = np.maximum(np.partition(needs, at, axis=1)[:, at], 1)
    big = needs > widths[:, None]
    over = np.nonzero(big)
    index["width"] = widths
    index["first"][1:] = np.cumsum(big.sum(axis=1))[:-1]
    sizes = packed_size(block, widths.astype(np.int64))
    index["start"][1:] = np.cumsum(sizes)[:-1]
    packed = np.zeros(int(sizes.sum()), np.uint8)
    plain = np.where(big, np.uint32(0), rest)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        data = pack_bits(plain[rows], int(width))
        packed[index["start"][rows].astype(np.int64)[:, None] + np.arange(data.shape[1])] = data
    return b"".join(
        (
            struct.pack(HEAD, MAGIC, block, blocks, len(over[0]), n),
            index.tobytes(), packed.tobytes(), over[1].astype("<u2").tobytes(), rest[over].astype("<u4").tobytes(),
        )
    )


def decode_segment(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """ids ``first`` to ``first + count`` of a segment; reads only the blocks that hold them."""
    magic, block, blocks, exceptions, n = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    count = n - first if count is None else count
    if not 0 <= first <= first + count <= n:
        raise ValueError("out of range")
    if not count:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(data, INDEX, blocks, struct.calcsize(HEAD))
    body = struct.calcsize(HEAD) + index.nbytes
    at_positions = len(data) - 6 * exceptions
    packed = np.frombuffer(data, np.uint8, at_positions - body, body)
    k0, k1 = first // block, (first + count - 1) // block + 1
    some = index[k0:k1]
    out = np.empty((k1 - k0, block), np.uint32)
    for width in np.unique(some["width"]):
        rows = np.flatnonzero(some["width"] == width)
        places = some["start"][rows].astype(np.int64)[:, None] + np.arange(packed_size(block, int(width)))
        out[rows] = unpack_bits(packed[places], int(width), block)
    e0, e1 = int(index["first"][k0]), int(index["first"][k1]) if k1 < blocks else exceptions
    if e1 > e0:
        rows = np.searchsorted(some["first"], np.arange(e0, e1), "right") - 1
        places = np.frombuffer(data, "<u2", e1 - e0, at_positions + 2 * e0)
        out[rows, places] = np.frombuffer(data, "<u4", e1 - e0, at_positions + 2 * exceptions + 4 * e0)
    out += some["low"][:, None]
    return out.reshape(-1)[first - k0 * block : first - k0 * block + count]


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block: int = BLOCK, percentile: float = PERCENTILE,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Tokenises every text, adds the end id, and writes the file set in ascending doc_id order."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        shard, segment = TaskContext.get().partitionId(), 0
        layout = pa.schema(
            [
                ("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("body", pa.binary()),
            ]
        )
        ids: list[bytes] = []
        names: list = []
        lengths: list[int] = []
        total = 0

        def closed() -> pa.RecordBatch:
            body = encode_segment(np.frombuffer(b"".join(ids), "<u4"), block, percentile)
            row = ([shard], [segment], [names], [lengths], [total], [body])
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, layout)], schema=layout)

        for columns in batches(source):
            for doc_id, text in zip(columns["doc_id"], columns["text"]):
                ids.append(encode(text or "") + end)
                names.append(doc_id)
                lengths.append(len(ids[-1]) // 4)
                total += lengths[-1]
                if total >= segment_ids:
                    yield closed()
                    ids, names, lengths, total, segment = [], [], [], 0, segment + 1
        if names:
            yield closed()

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    with short_batches(docs.sparkSession):
        ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, segment -> start: ids before it.  A row per shard is added up, then segments inside shards."""
    segments = spark.read.schema(SCHEMA).parquet(path).select("shard", "segment", "n_ids")
    before = Window.unboundedPreceding
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select(
        "shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(before, -1)), F.lit(0)).alias("base")
    )
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(before, -1))
    return segments.withColumn("inside", F.coalesce(inside, F.lit(0))).join(shards, "shard").select(
        "shard", "segment", (F.col("base") + F.col("inside")).alias("start")
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the file set."""
    schema = "doc_id long, shard int, segment int, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["doc_id", "shard", "segment", "inside", "n_tokens", "ids_crc32", "ids"]
        for batch in source:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                ids = decode_segment(row["body"].as_buffer()).astype("<u4", copy=False)
                lengths = row["lengths"].values.to_numpy()
                stops = np.cumsum(lengths)
                begins = stops - lengths
                parts = [ids[a:b] for a, b in zip(begins.tolist(), stops.tolist())]
                columns = [
                    row["doc_ids"].values,
                    np.full(len(parts), row["shard"].as_py()), np.full(len(parts), row["segment"].as_py()),
                    begins, lengths, [zlib.crc32(part) for part in parts],
                ]
                if with_ids:
                    columns.append([part.tolist() for part in parts])
                arrays = [pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, kinds)]
                yield pa.record_batch(arrays, names=names[: len(arrays)])

    table = spark.read.schema(SCHEMA).parquet(path).select("shard", "segment", "doc_ids", "lengths", "body")
    rows = table.mapInArrow(run, schema)
    # one row per segment on the right; Spark broadcasts it if it is small and shuffles it if not
    return rows.join(starts(spark, path), ["shard", "segment"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
