"""Parsed facts by content: what has been parsed once is read, whatever file, tree or commit it comes from.

A content is named as git names a blob, so files on disk and files of a commit
share entries.  The store is a folder of Parquet: for each state of the parsers
(the digest of their source text, so a changed parser starts anew) batches, each
written by one job, by kind of fact, as in ``parsed``.  Facts of kind ``parsed``
list what a batch holds, also contents without any fact.

An anti join on names tells which contents are new; only those are read in full
and parsed.  Two scans at once may both add a content: readers take one batch for
each.  A job that fails leaves no batch, as a batch is moved in place when it is
whole.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, moved, spread, there
from . import other_facts, parsed, python_facts

#: What tells a content: its name, and the kind of file that it is parsed as.
KEYS = ["digest", "kind"]
DONE = "parsed"


def blob_name(content: Column, algorithm: str = "sha1") -> Column:
    """The name that git gives a content (in a repository with that object format)."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    whole = F.concat(head, F.unhex(F.lit("00")), content)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def parser_state() -> str:
    """A digest of the parsers' text and of what their facts hold."""
    text = "".join(inspect.getsource(m) for m in (python_facts, other_facts)) + repr(parsed.LAYOUTS)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class FactStore:
    """Facts by content under ``folder``.  ``added``: how many contents the last call had to parse."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.place = f"{folder}/{parser_state()}"
        self.added = 0
        head = ", ".join(f"{k} string" for k in KEYS)
        empty = parsed.typed(spark.createDataFrame([], f"{head}, {parsed.PARSED}"))
        self.schema = empty.withColumn("batch", F.lit("")).select(*[c for c in empty.columns if c != "fact"], "batch", "fact").schema

    def rows(self) -> DataFrame:
        """All facts of all batches."""
        if not there(self.spark, self.place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.place).parquet(self.place)

    def known(self) -> DataFrame:
        """digest, kind, batch of every content, one batch each."""
        return self.rows().filter(F.col("fact") == DONE).groupBy(*KEYS).agg(F.min("batch").alias("batch"))

    def add(self, contents: DataFrame) -> None:
        """Parses ``contents`` (digest, kind, content) and keeps their facts as one batch."""
        head = ", ".join(f"{k} string" for k in KEYS)
        made = f"{self.place}/_{uuid.uuid4().hex}"  # a name that readers pass over
        parsed.write_by_fact(parsed.typed(parsed.parse_files(contents, head, mark=DONE)), made)
        moved(self.spark, made, f"{self.place}/batch=b{uuid.uuid4().hex}")

    def fill(self, listing: DataFrame, contents: Callable[[DataFrame], DataFrame]) -> None:
        """Parses what ``listing`` (path, kind, digest) names and the store lacks, each content once.

        ``contents`` adds the column ``content`` to rows of the listing; it is asked for new ones only.
        """
        one = _parsed(listing).groupBy(*KEYS).agg(F.min("path").alias("path"))
        new = durable(spread(one.join(self.known(), KEYS, "left_anti"), "digest"))
        self.added = new.count()
        if self.added:
            content = F.col("content")
            name = F.when(F.length("digest") == 40, blob_name(content)).otherwise(blob_name(content, "sha256"))
            # a file that has changed since it was listed is not what the listing names
            self.add(contents(new).filter(name == F.col("digest")))

    def facts(self, listing: DataFrame) -> DataFrame:
        """The facts of ``listing`` (columns of ``parsed.HEAD``, kind, digest), laid out as ``typed`` lays them out."""
        held = self.rows().filter(F.col("fact") != DONE).join(self.known(), [*KEYS, "batch"])
        columns = [c for c in held.columns if c not in (*KEYS, "batch", "fact")]
        head = [part.split()[0] for part in parsed.HEAD.split(", ")]
        return _parsed(listing).select(*head, *KEYS).join(held, KEYS).select(*head, *columns, "fact")


def _parsed(listing: DataFrame) -> DataFrame:
    return listing.filter("kind != 'other' AND digest IS NOT NULL")
