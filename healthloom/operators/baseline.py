"""Known findings: identities that survive edits elsewhere in a file, and the filter against them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.joined import write_joined


def with_identity(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``identity``: SHA-256 of rule, module, path and the finding's line with white space collapsed.

    ``lines``: path, line, text; without a line's text the identity is that of rule, module and path.
    """
    held = findings.withColumn("_path", F.replace("file_path", F.lit("\\"), F.lit("/")))
    if lines is not None:
        texts = lines.select(F.col("path").alias("file_path"), "line", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("_snippet"))
        held = held.join(texts, ["file_path", "line"], "left")
    else:
        held = held.withColumn("_snippet", F.lit(""))
    parts = F.concat_ws("\0", "rule", "module", "_path", F.coalesce("_snippet", F.lit("")))
    return held.withColumn("identity", F.sha2(parts, 256)).drop("_path", "_snippet")


def identities(findings: DataFrame) -> DataFrame:
    return findings.select("identity").distinct()


def filter_known(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose identity is not listed; repeats of survivors stay."""
    return findings.join(known.select("identity").distinct(), "identity", "left_anti").select(*findings.columns)


#: How a file begins that is written here: an identity per line follows, so tasks can read it in parts.
HEAD = '{"version":1,"ids":[\n'


def write_baseline(findings: DataFrame, path: str) -> None:
    """One JSON file: {"version": 1, "ids": [...]}, sorted and distinct, written by the executors."""
    quoted = F.concat(F.lit('"'), "identity", F.lit('"'))  # identities are hexadecimal
    write_joined(identities(findings).orderBy("identity").select(quoted), path, HEAD, ",\n", "\n]}\n")


def read_baseline(spark, path: str) -> DataFrame:
    """Identities of a baseline file; none if it is missing or broken.  Spark reads it: by lines if it was written here."""
    try:
        with open(path, encoding="utf-8") as f:
            ours = f.read(len(HEAD)) == HEAD
    except (OSError, ValueError):
        return spark.createDataFrame([], "identity string")
    place = Path(path).absolute().as_uri()
    if ours:
        found = F.regexp_extract("value", '^"([^"]+)"', 1)
        return spark.read.text(place).select(found.alias("identity")).filter("identity != ''")
    whole = spark.read.schema("ids array<string>").option("multiLine", True).json(place)
    return whole.select(F.explode("ids").alias("identity"))
