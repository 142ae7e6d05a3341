"""Exact dedup through a log-structured merge index of digests (DataFrame only).

Rows arrive in memtables (a stable hash of the row deals them out).  Each
memtable is flushed as a run: one entry per digest, sorted by digest, with the
smallest and largest identifier seen.  All runs feed one filter of a fixed
number of bits; a bit is *live* when more than one flushed row claims it.
Compaction merges the entries whose bit is live (all others are unique by
construction and never move), keeping smallest and largest identifiers.
Digests with more than one row are hits, and hits are verified on the bytes of
their texts (which a filter of the hits picks out where they stand): within a digest the least and the greatest text must be the same
string.  Those two are partial aggregates, so a digest that holds a third of
all rows sends one text per map task.  A digest that fails (a collision) is
grouped again by its text.

Defined cases: a null text equals the empty text; a null id orders before all
others; of repeated rows with equal id and text exactly one stays (the one with
the larger row number); a very long text is compared whole; an empty table gives
an empty result; other columns are ignored by the index and kept by
``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, FILTER_BITS, KeyFilter, ascii_lower, bitmaps, bucket_of, cut, drop_rows, filter_bit, flagged


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """An index over one table.  ``rows`` has a digest per row, ``runs`` and ``merged`` are its levels."""

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        digest: Callable[[Column], Column] = sha256,
        memtables: int = 16,
        filter_bits: int = FILTER_BITS,
    ):
        if filter_bits > FILTER_BITS or filter_bits % BITMAP_BITS:
            raise ValueError("filter_bits must be a multiple of 32768 and at most 2**25")
        self.filter_bits = filter_bits
        self.texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
        self.digest = digest
        # uid tells repeated rows apart; it is stable because the table is written before it is used twice
        self.rows = cut(
            self.texts.select(
                "id", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("uid")
            )
        )
        self.runs = self._flush(memtables)
        self.live = cut(self._filter())
        self.merged = cut(self._compact())

    def _flush(self, memtables: int) -> DataFrame:
        entry = F.struct("id", "uid")
        return cut(
            self.rows.groupBy(bucket_of([F.col("uid")], memtables).alias("run"), "digest")
            .agg(F.min(entry).alias("low"), F.max(entry).alias("high"), F.count("*").alias("n"))
            .sortWithinPartitions("run", "digest")
        )

    def _bit(self) -> Column:
        return filter_bit(["digest"], self.filter_bits)

    def _filter(self) -> DataFrame:
        claimed = self.runs.groupBy(self._bit().alias("bit")).agg(F.sum("n").alias("n")).filter("n > 1")
        return bitmaps(claimed)

    def maybe_hit(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` (with a ``digest``) whose bit is live: every hit, and few others."""
        return flagged(df, self._bit(), self.live).filter("live").drop("live")

    def _compact(self) -> DataFrame:
        return (
            self.maybe_hit(self.runs)
            .groupBy("digest")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
            .filter("n > 1")
        )

    def verified(self) -> DataFrame:
        """Hits with ``same``: whether all texts of the digest are equal byte by byte."""
        # a filter of the hits themselves: texts of other digests stay where they are
        texts = KeyFilter(self.merged, ["digest"]).passed(self.texts.withColumn("digest", self.digest(F.col("norm"))), ["digest"])
        bounds = texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
        same = bounds.select("digest", (F.col("a") == F.col("b")).alias("same"))
        return cut(self.merged.join(same, "digest"))

    def groups(self, keep: str = "max") -> DataFrame:
        """One row per row of the table: id, uid, digest, keep_id, keep_uid, n, kept."""
        chosen = F.col("high" if keep == "max" else "low")
        hits = self.verified()
        rows = self.rows
        good = hits.filter("same").select("digest", chosen.alias("best"), "n")
        out = rows.join(good, "digest", "left")
        bad = hits.filter("NOT same").select("digest")
        if bad.take(1):
            out = out.join(bad, "digest", "left_anti").unionByName(self._by_text(bad, keep))
        return out.select(
            "id",
            "uid",
            "digest",
            F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        )

    def _by_text(self, bad: DataFrame, keep: str) -> DataFrame:
        texts = cut(
            self.texts.withColumns(
                {"digest": self.digest(F.col("norm")), "uid": F.monotonically_increasing_id()}
            ).join(bad, "digest", "left_semi")
        )
        entry = F.struct("id", "uid")
        best = (F.max if keep == "max" else F.min)(entry).alias("best")
        return texts.join(texts.groupBy("norm").agg(best, F.count("*").alias("n")), "norm").select(
            "digest", "id", "uid", "best", "n"
        )


def exact_dedup(docs: DataFrame, keep: str = "max", **options) -> DataFrame:
    """The documents that stay, with all their columns.  Of repeated rows one stays."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    index = DigestIndex(held.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), **options)
    gone = index.groups(keep).filter("NOT kept").groupBy("id", "digest").agg(F.count("*").alias("gone"))
    keyed = held.select(
        "row", F.col("row.doc_id").alias("id"), index.digest(normalised(F.col("row.text"))).alias("digest")
    )
    return drop_rows(keyed, gone, ["id", "digest"])
