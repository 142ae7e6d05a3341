"""A scan: source tree -> files -> facts -> rules -> stages -> scores, as one plan per project.

Files come from folders or from commits (``Source``).  They are read and parsed
once, and facts are written by kind; all that follows is DataFrame work.
Rules that the version or the capabilities exclude are not planned at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, scoring
from ..operators import checks as K
from ..operators import findings as P
from ..operators import resolve as R
from ..session import durable, gone, new_place
from ..sources import commits, tree
from ..sources import linters as L
from ..sources.parsed import Facts
from ..sources.store import FactStore, blob_name
from ..sources.tree import read_tree
from . import cache
from . import rules as rules_module
from .config import Config
from .rules import REGISTRY, Project, Rule, as_findings, found_by, found_in_calls


# Versions that are known, and the name of the framework's package.
KNOWN_VERSION = r"^((?:1[4-9]|[2-9]\d)\.0)"
FRAMEWORK = "odoo"


@dataclass
class ScanResult:
    findings: DataFrame
    scores: DataFrame
    categories: DataFrame
    facts: Facts
    version: str
    failed: list[str]

    def release(self) -> None:
        """Gives up all that the scan keeps in memory."""
        self.facts.release()
        for df in (self.facts.files, self.findings, self.scores):
            df.unpersist()

    @property
    def project(self) -> DataFrame:
        return scoring.project_score(self.scores)


def detect_version(facts: Facts, *given: str | None) -> str:
    """The first given one; else the only version that manifests name; else the installed framework's; else unknown."""
    for version in given:
        if version:
            return version
    own = F.nullif(F.regexp_extract(F.coalesce("version", F.lit("")), KNOWN_VERSION, 1), F.lit(""))
    found = facts.manifests.select(own.alias("v")).agg(K.only_value("v")).first()[0]
    return found if found != "unknown" else installed_version() or "unknown"


def installed_version(package: str = FRAMEWORK) -> str | None:
    """The major version of the framework's package, if it is installed beside this one."""
    from importlib import metadata

    try:
        found = re.match(KNOWN_VERSION, metadata.version(package))
    except metadata.PackageNotFoundError:
        return None
    return found[1] if found else None


def active_rules(version: str, caps: list[str]) -> list[Rule]:
    """Rules that may run, told on the driver: what is shut out is no part of the plan."""

    def old_enough(least: str | None) -> bool:
        try:
            return not least or float(version.split(".")[0]) >= float(least.split(".")[0])
        except ValueError:
            return False

    return [r for r in REGISTRY.values() if old_enough(r.min_version) and set(r.needs) <= set(caps) and not set(r.excludes) & set(caps)]


def gates(spark: SparkSession) -> DataFrame:
    return P.Gates([(r.name, r.min_version, list(r.needs), list(r.excludes)) for r in REGISTRY.values()]).frame(spark)


def source_index(spark: SparkSession, path: str) -> DataFrame:
    """model, module of another source tree; three layouts of it are known."""
    import os

    roots = [os.path.join(path, "addons"), os.path.join(path, "odoo", "addons"), path]
    facts = Facts(read_tree(spark, roots))
    named = facts.classes.filter("name IS NOT NULL")
    return named.groupBy(F.col("name").alias("model")).agg(F.max_by("module", F.struct("module_ord", "path", "n")).alias("module"))


def rule_findings(project: Project, rules: list[Rule], failed: list[str]) -> DataFrame | None:
    """All rules' findings.  A rule whose plan can't be built is left out and named.

    Rules run as one job.  Registered rules' faults at run time are those of the
    data and are caught where files are parsed; a rule of a plugin (``own_job``)
    may fail while it runs, so it runs by itself first and what it finds is kept.
    """
    out = []
    calls = []
    for r in rules:
        if r.when:
            try:
                project.facts.calls.filter(r.when)  # tells whether the condition can be planned
                calls.append(r)
            except Exception as error:  # one rule's fault must not end the scan
                failed.append(f"{r.name}: {error}")
    if calls:
        out.append(found_in_calls(calls, project))
    for r in rules:
        if r.when:
            continue
        try:
            found = found_by(r, project)
            if r.own_job:
                found = project.facts.keep(found)
                found.count()
            out.append(found)
        except Exception as error:  # one rule's fault must not end the scan
            failed.append(f"{r.name}: {error}")
    return as_findings(reduce(DataFrame.unionByName, out), project) if out else None


def staged(
    raw: DataFrame, facts: Facts, config: Config, version: str, caps: list[str], changed: DataFrame | None, dirs: DataFrame, base_path: str | None
) -> DataFrame:
    """The stages, in their fixed order."""
    out = P.normalise(raw, base_path)
    if changed is not None:
        out = P.changed_only(out, changed, dirs, [r.name for r in REGISTRY.values() if r.context])
    out = P.deduplicate(out)
    out = P.override_severity(out, config.severity)
    out = P.ignore(out, config.ignore_rules, config.ignore_modules, config.ignore_files, base_path)
    out = P.suppress(out, facts.suppressions)
    out = P.gate(out, gates(facts.spark), version, caps)
    return P.mark_eligible(out)


@dataclass
class Source:
    """Where a scan's files come from.

    ``files``: the columns of ``module_tree``.  ``listing``: the same without contents, but with the name of each
    (``digest``).  ``contents`` adds contents to rows of the listing.
    """

    files: DataFrame
    listing: DataFrame
    contents: Callable[[DataFrame], DataFrame]


def tree_source(spark: SparkSession, paths: list[str], targets: list[str] | None = None) -> Source:
    """Module folders on disk."""
    files = read_tree(spark, paths, targets)
    return Source(files, files.withColumn("digest", blob_name(F.col("content"))).drop("content"), tree.with_contents)


def commit_sources(spark: SparkSession, repo: str, names: list[str], paths: list[str] | None = None, targets: list[str] | None = None) -> dict[str, Source]:
    """Module folders of commits; all of them are listed in one job."""
    listed = durable(commits.list_commits(spark, repo, names, paths, targets))
    contents = lambda rows: commits.with_contents(rows, repo)
    own = {name: listed.filter(F.col("commit") == name).drop("commit") for name in names}
    return {name: Source(contents(rows), rows, contents) for name, rows in own.items()}


def scan(spark: SparkSession, paths: list[str], config: Config | None = None, version: str | None = None, **more) -> ScanResult:
    """Scans module folders on disk; ``more`` as for ``scan_source``."""
    config = config or Config()
    return scan_source(tree_source(spark, paths, config.target_modules), config, version, **more)


def scan_commits(
    spark: SparkSession, repo: str, names: list[str], config: Config | None = None, version: str | None = None, paths: list[str] | None = None, store: str | None = None, **more
) -> dict[str, ScanResult]:
    """Scans commits of a repository without a worktree.  What they share is parsed once."""
    config = config or Config()
    place = store or new_place(spark, "store")
    try:
        sources = commit_sources(spark, repo, names, paths, config.target_modules)
        if sources:  # one job parses what is new in any of them
            FactStore(spark, place).fill(reduce(DataFrame.unionByName, [s.listing for s in sources.values()]), next(iter(sources.values())).contents)
        return {name: scan_source(source, config, version, store=place, **more) for name, source in sources.items()}
    finally:
        if not store:
            gone(spark, place)


def scan_source(
    source: Source,
    config: Config,
    version: str | None = None,
    changed: DataFrame | None = None,
    linters: tuple[L.Linter, ...] = (),
    base_path: str | None = None,
    stubs: R.Stubs | None = None,
    known: DataFrame | None = None,
    cache_dir: str | None = None,
    store: str | None = None,
) -> ScanResult:
    """``changed``: path of changed files (file rules see only those).  ``known``: identities of a baseline.

    ``store``: a folder of parsed facts by content; what is there is not parsed again, and what is new is added.
    ``cache_dir``: findings of an unchanged tree are taken from there and new
    ones kept there; not used together with ``changed``.
    """
    spark = source.files.sparkSession
    failed: list[str] = rules_module.load_plugins() if config.plugins else []
    if store:
        listing = durable(source.listing)
        held = FactStore(spark, store)
        held.fill(listing, source.contents)
        named = listing
        facts = Facts(source.contents(listing), held.facts(listing)).settle()
    else:
        named = source.files.persist()
        facts = Facts(named).settle()
    detected = detect_version(facts, version, config.version)
    caps = P.capabilities(detected, config.capabilities, config.capability_prefix)
    dirs = facts.manifests.select("module", "module_dir")
    chosen = active_rules(detected, caps)
    key = None
    if cache_dir and changed is None:
        settings = (detected, repr(config), [r.name for r in chosen], [repr(x) for x in linters], base_path)
        key = cache.fingerprint(named, *settings)
    out = cache.load(spark, cache_dir, key) if key else None
    if out is None:
        index = facts.keep(source_index(spark, config.source_path)) if config.source_path else None
        project = Project(facts, detected, stubs or R.stubs_for(spark, config.stubs_path, detected), index, caps)
        raw = rule_findings(project, chosen, failed)
        if raw is None:
            raw = spark.createDataFrame([], ", ".join(f"`{c}` {'int' if c in ('line', 'column') else 'string'}" for c in P.COLUMNS) + ", seq long")
        for linter in linters:
            raw = raw.unionByName(L.lint(facts.manifests, linter, detected, keep=facts.keep))
        out = staged(raw, facts, config, detected, caps, changed, dirs, base_path)
        if key:
            cache.store(out, cache_dir, key)
            out = cache.load(spark, cache_dir, key)
    if known is not None:
        out = baseline.filter_known(baseline.with_identity(out, facts.lines), known).drop("identity")
    out = out.persist()
    scope = sorted({r.category for r in chosen})
    categories = scoring.category_scores(out, dirs, scoring.category_table(spark, config.category_weights, scope))
    scores = scoring.with_labels(scoring.module_scores(categories)).persist()
    return ScanResult(out, scores, categories, facts, detected, failed)
