"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share a total by weight, none above a multiple (``cap``) of
its own size; the excess is shared again by weight.  All capped sources come
first in the order cap / weight, so running sums over that order give the
water level in one pass over the table of sources.

Copies: document i of source s expects e_i = target_s / size_s copies (times
its relative ``weight`` if one is given, at most ``cap``).  floor(e_i) whole
copies are certain.  The fraction p_i is the inclusion probability of one
more; documents are ranked by q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i)) with
u_i from a seeded MD5 of the id (Rosen's Pareto order sampling), and the first
documents in that order are taken until the source's target is met to the
word: the document on the line is cut there.  Sample sizes are thus fixed in
words, not random.

No task sorts a whole source: q / (1 + q) is cut into cells, cells are summed
(partial aggregates), and only the one cell per source that holds the line is
sorted.  Where that cell holds many rows it is cut again, until it holds at most
``MOST_IN_CELL`` or its rows can't be told apart by rank.  What is sorted are
ids and sizes; texts meet what is taken of them by a join with that small table.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are never taken; repeated rows count on
their own; equal ranks go by id, then size; a very long text counts whole; an
empty table gives no rows; other columns are kept by ``mixed_copies`` and ignored
by ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small

CELLS = 4096
#: Rows of a source that may be sorted in one task, and the finest cells (a double tells no more apart).
MOST_IN_CELL, FINEST = 10_000, CELLS**4
SEED = 42


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def cycled_weights(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """source, source_size -> weight: by code point order of the source, null last, in a cycle."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.element_at(F.lit(list(cycle)), place % len(cycle) + 1).cast("double"))


def water_filled(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, weight -> target.  One row per source."""
    first = Window.orderBy("line", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    lined = sources.withColumns({"most": F.col("source_size") * cap, "line": F.col("source_size") * cap / F.col("weight")})
    run = lined.withColumns(
        {
            "left": F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(first), F.lit(0.0)),
            "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(first), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    held = run.withColumn("capped", F.col("line") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("line", F.col("source").isNull(), "source", "level"))).over(every)
    return held.withColumn("water", level["level"]).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("water")).alias("target"),
    )


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _ranked(sized: DataFrame, sources: DataFrame, cap: float, seed: int, cells: int) -> DataFrame:
    """Documents with certain words ``whole``, room for one more copy, rank ``q`` and its ``cell``.

    ``cells`` counts where ``sources`` has no column of that name.
    """
    if "cells" not in sources.columns:
        sources = sources.withColumn("cells", F.lit(cells).cast("long"))
    s = small(sources.withColumnRenamed("source", "s_source"))
    held = F.col("cells")
    e = F.col("target") / F.col("source_size")
    if "weight" in sized.columns:
        e = F.least(e * F.coalesce("weight", F.lit(1.0)), F.lit(float(cap)))
    u = uniform(F.col("doc_id"), seed)
    q = u * (1 - F.col("p")) / ((1 - u) * F.col("p"))
    open_ = F.col("p") > 0
    return (
        sized.join(s, sized.source.eqNullSafe(s.s_source))
        .withColumn("expected", F.when(F.col("source_size") > 0, e).otherwise(0.0))
        .withColumn("p", F.col("expected") - F.floor("expected"))
        .withColumn("whole", F.floor("expected") * F.col("size"))
        # with no fraction left the odds are nothing and the rank is infinite: the last cell
        .withColumn("q", F.when(open_, q).otherwise(F.lit(float("inf"))))
        .withColumn("cell", F.when(open_, F.least(F.floor(q / (1 + q) * held), held - 1)).otherwise(held))
        .withColumn(
            "room", F.when(F.col("whole") + F.col("size") <= F.col("size") * cap, F.col("size")).otherwise(0)
        )
        .drop("s_source")
    )


def source_lines(
    sized: DataFrame, targets: DataFrame, cap: float = 2.0, seed: int = SEED, cells: int = CELLS, most: int = MOST_IN_CELL
) -> DataFrame:
    """``targets`` with each source's line: the cell that holds it, the room before that cell, the words missing,
    how many cells there are, and how many rows the line's cell has."""
    docs = _ranked(sized, targets, cap, seed, cells)
    sums = [F.sum("room").alias("has"), F.sum("whole").alias("certain"), F.count("*").alias("n")]
    per_cell = docs.groupBy("source", "cell").agg(*sums)
    sure = F.sum("certain").over(Window.partitionBy("source"))
    goal = targets.select(F.col("source").alias("t_source"), F.round("target").cast("long").alias("goal"))
    met = per_cell.withColumn("sure", sure).join(small(goal), F.col("source").eqNullSafe(F.col("t_source")))
    met = met.withColumns({"missing": F.col("goal") - F.col("sure"), "start": F.lit(0).cast("long")})
    lines = _first_reached(met, cells)
    full = cut(targets.join(lines.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source"))).drop("l_source"))
    while cells < FINEST and (full.agg(F.max("in_line")).first()[0] or 0) > most:
        finer = cells * CELLS
        # only the rows of the lines' cells are cut again
        inside = _ranked(sized, full, cap, seed, cells).filter("cell = line_cell")
        sub = F.least(F.floor(F.col("q") / (1 + F.col("q")) * finer), (F.col("line_cell") + 1) * CELLS - 1)
        start = F.first("before").alias("start")
        met = inside.groupBy("source", sub.alias("cell")).agg(F.sum("room").alias("has"), F.count("*").alias("n"), F.first("missing").alias("missing"), start)
        found = _first_reached(met, finer).select(F.col("source").alias("l_source"), *[F.col(c).alias(f"new_{c}") for c in ("line_cell", "before", "in_line")])
        joined = full.join(found, F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
        kept = F.when(F.col("line_cell") > cells, finer + 1).otherwise(F.col("line_cell"))
        full = cut(
            joined.withColumns(
                {
                    "line_cell": F.coalesce("new_line_cell", kept),
                    "before": F.coalesce("new_before", "before"),
                    "in_line": F.coalesce("new_in_line", F.lit(0)).cast("long"),
                    "cells": F.lit(finer).cast("long"),
                }
            ).drop("new_line_cell", "new_before", "new_in_line")
        )
        cells = finer
    return full


def _first_reached(per_cell: DataFrame, cells: int) -> DataFrame:
    """source -> the first cell in which ``start`` and the room so far reach ``missing``.

    Where all room is not enough there is no line, and every cell is below
    ``cells + 1``; where certain copies are enough the line is before all cells,
    and no document is sorted.
    """
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = per_cell.withColumn("upto", F.col("start") + F.sum("has").over(run))
    line = F.struct("cell", (F.col("upto") - F.col("has")).alias("before"), "n")
    found = reached.groupBy("source").agg(F.min(F.when(F.col("upto") >= F.col("missing"), line)).alias("line"), F.first("missing").alias("missing"))
    certain = F.col("missing") <= 0
    return found.select(
        "source",
        F.when(certain, -1).otherwise(F.coalesce("line.cell", F.lit(cells + 1))).cast("long").alias("line_cell"),
        F.coalesce("line.before", F.lit(0)).cast("long").alias("before"),
        "missing",
        F.lit(cells).cast("long").alias("cells"),
        F.when(certain, 0).otherwise(F.coalesce("line.n", F.lit(0))).cast("long").alias("in_line"),
    )


def on_line(sized: DataFrame, lines: DataFrame, cap: float = 2.0, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """Rows of the lines' cells, a row per id and size: how many there are (``same``) and the words they give (``given``)."""
    inside = _ranked(sized, lines, cap, seed, cells).filter("cell = line_cell")
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size")
    ahead = F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("room")
    extra = F.greatest(F.lit(0), F.least(F.col("room"), F.col("missing") - F.col("before") - ahead))
    named = [F.col(c).alias(f"o_{c}") for c in ("source", "doc_id", "size")]
    return cut(inside.withColumn("extra", extra).groupBy(*named).agg(F.count("*").alias("same"), F.sum("extra").alias("given")))


def taken(
    rows: DataFrame, lines: DataFrame, line_rows: DataFrame, cap: float = 2.0, seed: int = SEED, cells: int = CELLS
) -> DataFrame:
    """``rows`` (doc_id, source, size, perhaps weight, and any others) with ``whole``, ``extra`` and ``taken`` words.

    ``line_rows``: from ``on_line``.  Rows are joined with it where they stand;
    only rows that repeat an id and size in a line's cell are numbered.
    """
    held = _ranked(rows, lines, cap, seed, cells)
    keys = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in ("source", "doc_id", "size")]
    met = held.join(small(line_rows), keys[0] & keys[1] & keys[2], "left")
    below = F.when(F.col("cell") < F.col("line_cell"), F.col("room")).otherwise(0)
    single = met.filter("same IS NULL OR same = 1").withColumn("extra", F.coalesce("given", below))
    place = F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy("q"))
    left = F.col("given") - (place - 1) * F.col("room")
    many = met.filter("same > 1").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("room"), left)))
    columns = [
        *rows.columns, "source_size", "target", "whole", "extra", (F.col("whole") + F.col("extra")).cast("long").alias("taken")
    ]
    return single.select(*columns).unionByName(many.select(*columns))


def take(sized: DataFrame, targets: DataFrame, cap: float = 2.0, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """Words taken of each document.

    ``sized``: doc_id, source, size and perhaps weight (relative, mean 1).
    ``targets``: source, source_size, target.  Both already written (``cut``).
    """
    lines = source_lines(sized, targets, cap, seed, cells)
    return taken(sized, lines, on_line(sized, lines, cap, seed, cells), cap, seed, cells)


def _planned(docs: DataFrame, share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame]:
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sizes = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = cut(water_filled(cycled_weights(sizes), share, cap))
    return sized, source_lines(sized, targets, cap, seed)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    sized, lines = _planned(docs, share, cap, seed)
    return taken(sized, lines, on_line(sized, lines, cap, seed), cap, seed)


def mixed_copies(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: documents repeated as often as taken, all columns kept.

    A document that was cut at the line ends with its first words up to the
    line.  Texts are not shuffled, but for rows that repeat another one's id and size on the line.
    """
    sized, lines = _planned(docs, share, cap, seed)
    held = docs.select(F.struct(*docs.columns).alias("row"))
    rows = held.select("row", "row.doc_id", "row.source", word_count(F.col("row.text")).alias("size"))
    part = F.col("row.text")
    none = F.array().cast("array<string>")
    copies = F.concat(
        F.array_repeat(part, F.floor(F.col("whole") / F.col("size")).cast("int")),
        F.when(F.col("extra") == F.col("size"), F.array(part))
        .when(F.col("extra") > 0, F.array(first_words(part, F.col("extra"))))
        .otherwise(none),
    )
    out = taken(rows, lines, on_line(sized, lines, cap, seed), cap, seed).filter("taken > 0").select("row", F.explode(copies).alias("copy"))
    return out.select(*[F.col("copy").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


#: DuckDB SQL for ``op3_pareto_mix``.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), lined AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS line FROM sources
), run AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0) AS room_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM lined WINDOW w AS (ORDER BY line, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (SELECT *, room_left / open_weight AS level, line <= room_left / open_weight AS capped FROM run
), targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN most ELSE weight * (SELECT arg_min(level, line) FROM levels WHERE NOT capped) END AS target
  FROM levels
), expected AS (
  SELECT doc_id, size, d.source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, floor(e)::BIGINT * size AS certain, CASE WHEN floor(e) < 2 THEN size ELSE 0 END AS room,
         CASE WHEN e > floor(e) THEN u * (1 - (e - floor(e))) / ((1 - u) * (e - floor(e))) ELSE 'inf'::DOUBLE END AS q
  FROM expected
), filled AS (
  SELECT *, round(target)::BIGINT - sum(certain) OVER (PARTITION BY source) AS missing,
         sum(room) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) - room AS ahead
  FROM ranked
)
SELECT doc_id, size, source_size, target, (certain + greatest(0, least(room, missing - ahead)))::BIGINT AS taken FROM filled"""
