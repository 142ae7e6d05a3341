"""Symbols of the framework by version: a table of what each version defines, and what changed between two.

``<folder>/version=<v>/part=<part>``: ``models`` (model, complete, same: a digest
of its members), ``members`` (model, kind, name) and ``ids`` (xml_id).  A version
is written by as many tasks as its tables have, none of which holds a version
whole, and is put in place when it is complete.  Readers of one version read its
folders only; differences are anti joins of two.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import gone, moved, names_in, there
from .resolve import Stubs, no_stubs

LAYOUTS = {
    "models": "model string, complete boolean, same string",
    "members": "model string, kind string, name string",
    "ids": "xml_id string",
}


def symbols_of(facts, complete: bool = True) -> dict[str, DataFrame]:
    """The tables of a parsed source tree; ``complete``: whether its models have nothing but what is seen there."""
    classes = facts.classes.filter("key IS NOT NULL")
    part = lambda column, kind: classes.select(F.col("key").alias("model"), F.lit(kind).alias("kind"), F.explode(f"{column}.name").alias("name"))
    members = part("fields", "field").unionByName(part("methods", "method")).distinct()
    sets = members.groupBy("model").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "name")))), 256).alias("same"))
    models = classes.select(F.col("key").alias("model")).distinct().join(sets, "model", "left")
    ids = facts.of("record").select(F.when(F.col("id").contains("."), F.col("id")).otherwise(F.concat_ws(".", "module", "id")).alias("xml_id")).distinct()
    return {"models": models.select("model", F.lit(complete).alias("complete"), "same"), "members": members, "ids": ids}


def write_version(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """Takes the place of what the store has of that version."""
    spark = tables["models"].sparkSession
    made = f"{folder}/_{uuid.uuid4().hex}"
    for part, df in tables.items():
        df.write.parquet(f"{made}/part={part}")
    gone(spark, f"{folder}/version={version}")
    moved(spark, made, f"{folder}/version={version}")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The versions that the store has, oldest first."""
    found = [n.removeprefix("version=") for n in names_in(spark, folder) if n.startswith("version=")]
    return sorted(found, key=lambda v: [int(x) if x.isdigit() else -1 for x in v.split(".")])


def part_of(spark: SparkSession, folder: str, version: str, part: str) -> DataFrame:
    path = f"{folder}/version={version}/part={part}"
    return spark.read.schema(LAYOUTS[part]).parquet(path) if there(spark, path) else spark.createDataFrame([], LAYOUTS[part])


def load(spark: SparkSession, folder: str, version: str) -> Stubs:
    """A version's symbols (or those of its major version), and what is known of models that earlier versions had."""
    held = versions(spark, folder)
    name = next((v for v in (version, version.split(".")[0] + ".0") if v in held), None)
    if name is None:
        return no_stubs(spark)
    models, members, ids = (part_of(spark, folder, name, part) for part in LAYOUTS)
    return Stubs(models.select("model", "complete"), members, ids, lost(spark, folder, held[: held.index(name)], name))


def changes(older: DataFrame, newer: DataFrame) -> DataFrame:
    """model, change (removed, added, renamed), now (what a renamed one is called): of two versions' ``models``.

    A model is renamed if it is gone and exactly one new model has exactly its members, which no other lost model
    has; models without members are never told to be renamed.
    """
    lost_, new = older.join(newer, "model", "left_anti"), newer.join(older, "model", "left_anti")
    alone = lambda df, name: df.filter("same IS NOT NULL").groupBy("same").agg(F.min("model").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")
    renamed = alone(lost_, "model").join(alone(new, "now"), "same").select("model", "now")
    gone_ = lost_.select("model").join(renamed, "model", "left")
    gone_ = gone_.select("model", F.when(F.col("now").isNotNull(), "renamed").otherwise("removed").alias("change"), "now")
    added = new.join(renamed.select(F.col("now").alias("model")), "model", "left_anti")
    return gone_.unionByName(added.select("model", F.lit("added").alias("change"), F.lit(None).cast("string").alias("now")))


def member_changes(older: DataFrame, newer: DataFrame, models: DataFrame) -> DataFrame:
    """model, kind, name, change of members of models that both versions have (``models``: model of either)."""
    both = lambda a, b, told: a.join(b, ["model", "kind", "name"], "left_anti").withColumn("change", F.lit(told))
    return both(older, newer, "removed").unionByName(both(newer, older, "added")).join(models.select("model").distinct(), "model", "left_semi")


def lost(spark: SparkSession, folder: str, earlier: list[str], version: str) -> DataFrame:
    """model, last (the latest earlier version that had it), now (its new name, or null) of models that ``version`` lacks."""
    newer = part_of(spark, folder, version, "models")
    found = spark.createDataFrame([], "model string, last string, now string")
    for name in reversed(earlier):  # one row per model: the latest version tells
        told = changes(part_of(spark, folder, name, "models"), newer).filter("change != 'added'")
        told = told.select("model", F.lit(name).alias("last"), "now")
        found = found.unionByName(told.join(found, "model", "left_anti"))
    return found
