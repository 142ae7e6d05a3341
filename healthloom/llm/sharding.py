"""Sharding by rendezvous hashing (DataFrame only).

Every shard scores every record key; the record goes to the best score.  A
shard that is added can only win records for itself, one that is removed only
gives its own away, so few records move.  A record's key is folded by MD5 into
two 31-bit numbers and each shard has three numbers derived from its *name*;
the score is an affine form modulo 2**31 - 1, which Spark compiles and any SQL
engine can repeat.  With unequal weights the score becomes -ln(u) / weight
(smaller wins), which gives each shard its weight's part of the keys.

Slots inside a shard are dealt in two steps (counts per shard and sub-bucket,
then ranks inside the sub-bucket), so no task has to hold a whole shard.

Defined cases: a null key is one key of its own; repeated rows share a shard
and take different slots; equal scores go to the first of the shards; a null
text has no bytes; a very long text counts whole; an empty table stays empty;
other columns are ignored by ``shard_documents`` and kept by ``assign`` and
``write_shards``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2**31 - 1
SUB_BUCKETS = 1024


def coefficients(name: str) -> tuple[int, int, int]:
    """Three numbers of a shard; they depend on its name alone."""
    digest = hashlib.sha256(f"shard:{name}".encode()).digest()
    a, b, c = (int.from_bytes(digest[k : k + 8], "big") for k in (0, 8, 16))
    return a % (PRIME - 1) + 1, b % (PRIME - 1) + 1, c % PRIME


def halves(key: Column) -> tuple[Column, Column]:
    """Two 31-bit numbers from the MD5 of the key's string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % PRIME
    return part(1), part(9)


def choose(h1: Column, h2: Column, shards: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Place of the winning shard in ``shards``."""
    best = []
    for place, name in enumerate(shards):
        a, b, c = coefficients(name)
        score = (h1 * F.lit(a).cast("bigint") % PRIME + h2 * F.lit(b).cast("bigint") % PRIME + c) % PRIME
        if weights is not None:
            if weights[place] <= 0:
                continue
            score = F.log((score + 1) / F.lit(float(PRIME + 1))) / F.lit(float(weights[place]))
        best.append(F.struct(score.alias("score"), F.lit(-place).alias("place")))
    return -(F.greatest(*best) if len(best) > 1 else best[0])["place"]


def assign(
    df: DataFrame,
    key: str,
    shards: Sequence[str],
    weights: Sequence[float] | None = None,
    grown: str | None = None,
    grown_weight: float = 1.0,
) -> DataFrame:
    """``df`` with ``shard`` and, if one more shard ``grown`` (of ``grown_weight`` where weights are given) is named, ``grown_shard``."""
    h1, h2 = halves(F.col(key))
    held = df.withColumns({"_h1": h1, "_h2": h2})
    out = {"shard": choose(F.col("_h1"), F.col("_h2"), shards, weights)}
    if grown is not None:
        more = None if weights is None else [*weights, grown_weight]
        out["grown_shard"] = choose(F.col("_h1"), F.col("_h2"), [*shards, grown], more)
    return held.withColumns(out)


def with_slots(df: DataFrame, order: Sequence[str], sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... without gaps in each shard, by sub-bucket and then ``order``."""
    dealt = df.withColumn("_sub", F.col("_h1") % sub_buckets)
    counts = dealt.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select("shard", "_sub", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_sub").orderBy(*order))
    ranked = dealt.withColumn("_place", place)
    return (
        ranked.join(starts, ["shard", "_sub"])
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_sub", "_start", "_place")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot, grown_shard; law ``key``."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    dealt = assign(plain, "doc_id", [str(k) for k in range(shards)], grown=str(shards))
    return with_slots(dealt, ["doc_id", "text_crc32", "size"]).drop("_h1", "_h2")


def write_shards(docs: DataFrame, path: str, key: str, shards: Sequence[str], weights: Sequence[float] | None = None) -> None:
    """One folder of Parquet files per shard, all columns kept."""
    held = docs.select(F.col(key).alias("_key"), F.struct(*docs.columns).alias("_row"))
    dealt = assign(held, "_key", shards, weights)
    dealt.select("_row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def oracle(shards: int = 40) -> str:
    """DuckDB SQL for ``op10_rendezvous_shards``."""

    def winner(n: int) -> str:
        scores = []
        for k in range(n):
            a, b, c = coefficients(str(k))
            scores.append(f"(h1 * {a}::BIGINT % {PRIME} + h2 * {b}::BIGINT % {PRIME} + {c}) % {PRIME}")
        return f"list_position([{', '.join(scores)}], list_max([{', '.join(scores)}])) - 1"

    return f"""
WITH tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c
    FROM range(256) r(n))
), keyed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(coalesce(text, '')) AS h,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % {PRIME} AS h1,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 9, 8))::BIGINT % {PRIME} AS h2
  FROM documents
), dealt AS (
  SELECT doc_id, size, h1, ({winner(shards)})::INTEGER AS shard, ({winner(shards + 1)})::INTEGER AS grown_shard,
         xor(list_reduce(list_transform(range(strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM keyed, tab
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, grown_shard,
       (row_number() OVER (PARTITION BY shard ORDER BY h1 % {SUB_BUCKETS}, doc_id) - 1)::BIGINT AS slot
FROM dealt"""
