"""Findings of external linters: a process per module on the executors, their output mapped by a broadcast table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import by_value
from ..operators.findings import COLUMNS

by_value(__name__)

#: Fixed value: one line of text output, ``path:line:column: CODE: message (symbol)``.
TEXT_LINE = r"^(.+?):(\d+):(\d+):\s+([A-Z]\d+):\s+(.+?)(?:\s+\(([^)]+)\))?\s*$"
#: Any JSON list.
LOOSE = "array<string>"
UNMAPPED = ("Uncategorized", "P3", "low")


@dataclass(frozen=True)
class Linter:
    """``command`` gets the module's folder appended.  ``form``: json (an array) or text (a line per finding)."""

    name: str
    command: tuple[str, ...]
    form: str
    seconds: int
    #: code -> (category, tier, confidence)
    mapping: tuple[tuple[str, tuple[str, str, str]], ...] = ()
    missing_plugin: str = ""
    url: str | None = None


# Commands, plugin, and what codes are mapped to (category, tier, confidence).
RUFF = Linter(
    "ruff", ("ruff", "check", "--output-format=json", "--no-fix"), "json", 60,
    mapping=(
        ("S608", ("Security", "P1", "high")),
        ("S301", ("Security", "P0", "high")),
        ("E501", ("Maintainability", "P3", "high")),
        ("F841", ("Correctness", "P3", "high")),
        ("F811", ("Correctness", "P2", "high")),
        ("W605", ("Correctness", "P3", "high")),
    ),
)
PYLINT = Linter(
    "pylint-odoo", ("pylint", "--load-plugins=pylint_odoo", "--output-format=text"), "text", 120,
    mapping=(
        ("E8102", ("Correctness", "P2", "high")),
        ("E8103", ("Security", "P0", "high")),
        ("W8110", ("Correctness", "P2", "high")),
        ("W8120", ("Maintainability", "P3", "medium")),
        ("C8101", ("Module Hygiene", "P3", "high")),
    ),
    missing_plugin="No module named pylint_odoo",
)


def run_process(command: list[str], seconds: int) -> tuple[str, str, str, int]:
    """state (ok, missing, timeout), stdout, stderr, exit status."""
    import shutil
    import subprocess

    if shutil.which(command[0]) is None:
        return "missing", "", "", 0
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=seconds, errors="replace")
    except subprocess.TimeoutExpired:
        return "timeout", "", "", 0
    except OSError:
        return "missing", "", "", 0
    return "ok", done.stdout or "", done.stderr or "", done.returncode


def outputs(modules: DataFrame, linter: Linter, run: Callable = run_process) -> DataFrame:
    """module, module_dir, state, stdout, stderr, status: one process per module."""

    def each(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            got = [run([*linter.command, d], linter.seconds) for d in rows.module_dir]
            yield rows.assign(**{c: [g[k] for g in got] for k, c in enumerate(("state", "stdout", "stderr", "status"))})

    plain = modules.select("module", "module_dir").distinct()
    schema = "module string, module_dir string, state string, stdout string, stderr string, status int"
    return plain.repartition("module").mapInPandas(each, schema)


def parsed(raw: DataFrame, linter: Linter) -> DataFrame:
    """module, module_dir, path, line, column, code, message of every reported place."""
    if linter.form == "json":
        kind = "array<struct<code:string,message:string,filename:string,location:struct<row:int,column:int>>>"
        rows = raw.select("module", "module_dir", F.explode(F.from_json("stdout", kind)).alias("x"))
        return rows.select(
            "module", "module_dir",
            F.coalesce("x.filename", F.lit("")).alias("path"),
            F.coalesce("x.location.row", F.lit(0)).alias("line"),
            F.coalesce("x.location.column", F.lit(0)).alias("column"),
            F.coalesce("x.code", F.lit("unknown")).alias("code"),
            F.coalesce("x.message", F.lit("")).alias("message"),
        )
    lines = raw.select("module", "module_dir", F.explode(F.split("stdout", "\n")).alias("t")).withColumn("t", F.trim("t"))
    part = lambda k: F.regexp_extract("t", TEXT_LINE, k)
    return lines.filter(F.col("t").rlike(TEXT_LINE)).select(
        "module", "module_dir", part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"),
        part(4).alias("code"), F.trim(part(5)).alias("message"),
    )


def mapped_codes(found: DataFrame, linter: Linter) -> DataFrame:
    """``found`` with category, tier and confidence of its codes; those that are not mapped count as ``UNMAPPED``."""
    rows = [(c, *m) for c, m in linter.mapping]
    table = found.sparkSession.createDataFrame(rows, "code string, category string, tier string, confidence string")
    mapped = found.join(F.broadcast(table), "code", "left")  # the mapping is a fixed, small table
    return mapped.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in zip(("category", "tier", "confidence"), UNMAPPED)})


def lint(
    modules: DataFrame, linter: Linter, version: str, run: Callable = run_process, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist
) -> DataFrame:
    """Findings of one linter, and a warning where it could not run.  The outputs are kept: processes run once."""
    raw = keep(outputs(modules, linter, run))
    found = parsed(raw, linter)
    mapped = mapped_codes(found, linter)
    severity = F.when(F.col("tier").isin("P2", "P3"), "warning").otherwise("error")
    texts = {"title": F.concat(F.lit(f"{linter.name} "), "code"), "help": F.concat(F.lit(f"See the documentation of {linter.name} for "), "code", F.lit("."))}
    held = mapped.withColumns(texts).withColumns({"rule": F.col("code"), "file_path": F.col("path"), "severity": severity})

    ran = found.select("module").distinct().withColumn("some", F.lit(True))
    states = raw.join(ran, "module", "left")
    no_plugin = F.col("stderr").contains(linter.missing_plugin) if linter.missing_plugin else F.lit(False)
    said = F.trim("stdout")
    broken = (F.lit(linter.form == "json") & (said != "")) & (~said.startswith("[") | F.from_json(said, LOOSE).isNull() | (F.get_json_object(said, "$").isNull()))
    why = (
        F.when(F.col("state") == "missing", f"The executable of {linter.name} was not found.")
        .when(F.col("state") == "timeout", f"{linter.name} did not finish within {linter.seconds} seconds.")
        .when(no_plugin, f"A plugin of {linter.name} is not installed.")
        .when((F.col("state") == "ok") & broken, f"The output of {linter.name} could not be read: it is no JSON list.")
        .when((F.col("status") != 0) & F.col("some").isNull(), F.concat(F.lit(f"{linter.name} ended with status "), F.col("status").cast("string"), F.lit(" and no findings.")))
    )
    warned = states.withColumn("message", why).filter("message IS NOT NULL").withColumns(
        {
            "file_path": F.col("module_dir"), "line": F.lit(0), "column": F.lit(0), "rule": F.lit(f"{linter.name}-unavailable"),
            "category": F.lit(UNMAPPED[0]), "tier": F.lit("P3"), "confidence": F.lit("low"), "severity": F.lit("warning"),
            "title": F.lit(f"{linter.name} could not run"), "help": F.lit(f"Install {linter.name} or switch it off."),
        }
    )
    constant = {"source": F.lit(linter.name), "odoo_version": F.lit(version), "url": F.lit(linter.url).cast("string")}
    order = F.lit(1 << 50)
    return held.withColumns(constant).select(*COLUMNS, order.alias("seq")).unionByName(warned.withColumns(constant).select(*COLUMNS, order.alias("seq")))
