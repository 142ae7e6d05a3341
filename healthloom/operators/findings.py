"""The findings table and the stages that rows pass before they are scored.

Columns of findings: module, file_path, line, column, rule, category, severity,
tier, source, confidence, title, message, help, odoo_version, url; and ``seq``,
an order of arrival that settles ties.  Each stage takes a findings DataFrame
and gives one back; the rows' order means nothing in between.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Categories in their order with default weights, and points of tiers.
CATEGORIES = {
    "Security": 1.5,
    "Correctness": 1.5,
    "Performance": 1.0,
    "Data Integrity": 1.0,
    "Upgrade Safety": 1.0,
    "Module Hygiene": 0.8,
    "Maintainability": 0.5,
    "Frontend": 0.5,
}
TIERS = {"P0": 25, "P1": 10, "P2": 4, "P3": 1}

COLUMNS = [
    "module", "file_path", "line", "column", "rule", "category", "severity", "tier", "source", "confidence",
    "title", "message", "help", "odoo_version", "url",
]
KEY = ["module", "file_path", "line", "category", "rule"]


@dataclass(frozen=True)
class Surface:
    """What a place of output shows."""

    min_confidence: str | None = None
    categories: tuple[str, ...] = ()


@dataclass
class Gates:
    """Per rule: least version, required and excluding capabilities.  Rules that are not listed pass."""

    rows: list[tuple[str, str | None, list[str], list[str]]] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        schema = "rule string, min_version string, needs array<string>, excludes array<string>"
        return spark.createDataFrame(self.rows, schema)


def normalise(findings: DataFrame, base: str | None = None) -> DataFrame:
    """Paths in one spelling; relative ones are taken from ``base``."""
    return findings.withColumn("file_path", C.normal_path(F.col("file_path"), base))


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per place and rule: the surest, then the best source, then the longest message, then the first.

    ``max_by`` combines on the map side, so a place with very many findings
    sends one row per task.
    """
    worth = F.struct(
        C.rank(F.col("confidence"), C.CONFIDENCE).alias("c"),
        C.source_rank(F.col("source")).alias("s"),
        F.char_length("message").alias("n"),
        (-F.col("seq")).alias("o"),
    )
    rest = [c for c in findings.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), worth).alias("best")
    return findings.groupBy(*KEY).agg(best).select(*KEY, "best.*").select(*findings.columns)


def override_severity(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """New severities by rule; ``off`` drops a rule's findings."""
    if not overrides:
        return findings
    names = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    new = F.coalesce(F.element_at(names, F.col("rule")), F.col("severity"))
    return findings.withColumn("severity", new).filter("severity != 'off'")


def ignore(findings: DataFrame, rules: list[str], modules: list[str], globs: list[str], base: str | None = None) -> DataFrame:
    out = findings
    if rules:
        out = out.filter(~F.col("rule").isin(rules))
    if modules:
        out = out.filter(~F.col("module").isin(modules))
    if globs:
        out = out.filter(~C.matches_globs(F.col("file_path"), globs, base))
    return out


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drops what (path, line, rule) names; line 0 names the whole file.  Two equi anti joins, no disjunction."""
    s = suppressions.select(C.normal_path(F.col("path")).alias("file_path"), "line", "rule").distinct()
    whole = s.filter("line = 0").select("file_path", "rule")
    return findings.join(s, ["file_path", "line", "rule"], "left_anti").join(whole, ["file_path", "rule"], "left_anti")


def capabilities(version: str, configured: list[str], prefix: str) -> list[str]:
    """The configured ones, and ``prefix:major`` of a known version."""
    known = [f"{prefix}:{version.split('.')[0]}"] if version and version != "unknown" else []
    return sorted({*configured, *known})


def enabled(version: Column, caps: Column) -> Column:
    """Whether a gate row (min_version, needs, excludes) lets a rule run."""
    old_enough = F.col("min_version").isNull() | C.version_at_least(version, F.col("min_version"))
    return old_enough & (F.size(F.array_except("needs", caps)) == 0) & ~F.arrays_overlap("excludes", caps)


def gate(findings: DataFrame, gates: DataFrame, version: str, caps: list[str]) -> DataFrame:
    """Drops findings of rules that the version or the capabilities exclude.  ``gates`` has a row per rule."""
    held = F.lit(caps) if caps else F.array().cast("array<string>")
    shut = gates.filter(~enabled(F.lit(version), held)).select("rule")
    return findings.join(F.broadcast(shut), "rule", "left_anti").select(*findings.columns)  # rules are a fixed, small set


def mark_eligible(findings: DataFrame) -> DataFrame:
    """``eligible``: sure, and of a known category."""
    return findings.withColumn("eligible", (F.col("confidence") == "high") & F.col("category").isin(list(CATEGORIES)))


def for_surface(findings: DataFrame, surface: Surface) -> DataFrame:
    out = findings
    if surface.min_confidence:
        least = C.CONFIDENCE.get(surface.min_confidence, 0)
        out = out.filter(C.rank(F.col("confidence"), C.CONFIDENCE) >= least)
    if surface.categories:
        out = out.filter(F.col("category").isin(list(surface.categories)))
    return out


def changed_only(findings: DataFrame, changed: DataFrame, module_dirs: DataFrame, context_rules: list[str]) -> DataFrame:
    """Findings in changed files, and whole-module findings of modules with a changed file.

    ``changed``: path.  ``module_dirs``: module, module_dir.  A changed file's
    folders are listed, so the prefix test is an equi join.
    """
    c = changed.select(C.normal_path(F.col("path")).alias("file_path")).distinct()
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    touched = c.select(F.explode(above).alias("module_dir")).distinct().join(module_dirs, "module_dir").select("module").distinct()
    wide = F.col("rule").isin(context_rules)
    exact = findings.join(c, "file_path", "left_semi").select(*findings.columns)
    broad = findings.filter(wide).join(c, "file_path", "left_anti").join(touched, "module", "left_semi")
    return exact.unionByName(broad.select(*findings.columns))


def top(findings: DataFrame, k: int) -> DataFrame:
    """The first k by tier, path and line (a top-k, not a sort)."""
    return findings.orderBy("tier", "file_path", "line", "seq").limit(k)


def severe(findings: DataFrame, severity: str) -> DataFrame:
    """Findings that are at least that severe; none for an unknown severity."""
    least = C.SEVERITY.get(severity)
    return findings.filter(F.lit(False) if least is None else C.rank(F.col("severity"), C.SEVERITY) >= least)


def at_or_above(findings: DataFrame, severity: str) -> bool:
    """Whether any finding is at least that severe."""
    return bool(severe(findings, severity).take(1))


def later_definitions(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Rows after the first of each key, with the first one's ``keep`` columns as ``first_*``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    named = {f"first_{c}": F.first(c).over(w) for c in keep}
    return rows.withColumns({"nth": F.row_number().over(w)} | named).filter("nth > 1").drop("nth")
