"""Relational checks that rules are made of.  Rules and the table queries call the same functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the known ones; repeats of survivors stay."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def after_first(rows: DataFrame, group: str, position: str, first: str, late: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows meeting ``late`` that stand after the group's first row meeting ``first``; that row's position and
    ``keep`` columns come along as ``first_*``.  The first one is a partial aggregate, so no group meets in one task."""
    head = F.min(F.struct(position, *keep)).alias("_head")
    heads = rows.filter(first).groupBy(group).agg(head)
    met = rows.filter(late).join(heads, group).filter(F.col(position) > F.col(f"_head.{position}"))
    return met.withColumns({f"first_{c}": F.col(f"_head.{c}") for c in (position, *keep)}).drop("_head")


def listed_evidence(rows: DataFrame, keys: list[str], evidence: str, order: str, alias: str = "evidence") -> DataFrame:
    """Distinct evidence per key, in order of first appearance, as one text."""
    first = rows.groupBy(*keys, evidence).agg(F.min(order).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", F.col(evidence).alias("e"))))
    return first.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ", ").alias(alias))


def pattern_hits(text: Column, patterns: Sequence[tuple[str, Column]]) -> Column:
    """What goes with each pattern that the text holds, in the patterns' order."""
    return F.filter(F.array(*[F.when(text.rlike(p), told) for p, told in patterns]), lambda x: x.isNotNull())


def last_of(rows: DataFrame, keys: list[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of equal keys the last one's values."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def only_value(column: str, otherwise: str = "unknown") -> Column:
    """An aggregate: the value if all rows that have one agree on it."""
    return F.when(F.count_distinct(column) == 1, F.max(column)).otherwise(otherwise)


def unfilled(filled: Column, keys: Sequence[str]) -> Column:
    """The keys that are not filled, in the keys' order."""
    return F.filter(F.lit(list(keys)), lambda k: ~F.array_contains(filled, k))
