"""The rules: queries over fact tables, each giving findings.

A rule is a function of ``Project`` that returns path, line, column, n (order)
and the values its texts need; the registry adds the rest.  Own rules join with
``@rule(...)``, packaged ones through entry points (see ``load_plugins``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import checks as K
from ..operators import resolve as R
from ..operators.findings import later_definitions
from ..sources.parsed import Facts, qualified

# Title, message and help of each rule's findings; {name} is a column of the rule's rows.
TEXTS = {
    "raw-sql-string-interpolation": (
        "SQL injection via string interpolation",
        "'{name}()' at line {line} uses dynamic SQL string construction. Vulnerable to SQL injection.",
        "Use parameterized queries: cr.execute('SELECT ... WHERE name = %s', (param,)).",
    ),
    "eval-usage": (
        "Use of builtin {name}() on dynamic input",
        "'{name}()' at line {line} executes arbitrary code and is a remote-code-execution risk.",
        "Avoid eval/exec. Use the framework's safe evaluation for expressions; otherwise refactor to explicit logic.",
    ),
    "public-controller-sudo-risk": (
        "Public controller route calls .sudo()",
        "Controller method '{name}' is declared with auth='{auth}' and uses .sudo().",
        "Review if sudo is necessary. Public routes with sudo bypass access rights and can lead to privilege escalation.",
    ),
    "sudo-without-comment": (
        "'.sudo()' without a justifying comment",
        ".sudo() at line {line} bypasses access rights but has no comment explaining why it is safe.",
        "Add a short comment on the same line or directly above explaining why elevated privileges are required.",
    ),
    "search-in-loop": (
        "ORM '{name}' called inside loop",
        "'{name}()' at line {line} is called inside a loop. Consider batching.",
        "Move the '{name}()' call outside the loop and batch the operation.",
    ),
    "create-in-loop": (
        "ORM '{name}' called inside loop",
        "'{name}()' at line {line} is called inside a loop. Consider batching.",
        "Move the '{name}()' call outside the loop and batch the operation.",
    ),
    "write-in-loop": (
        "ORM '{name}' called inside loop",
        "'{name}()' at line {line} is called inside a loop. Consider batching.",
        "Move the '{name}()' call outside the loop and batch the operation.",
    ),
    "n-plus-one-read": (
        "Possible N+1 relational read in loop",
        "Chained attribute access on loop variable at line {line} may trigger one query per iteration.",
        "Prefetch related records before the loop (e.g. mapped()) or read the needed fields in one batch.",
    ),
    "unbounded-search": (
        "Unbounded '{name}' in risky context",
        "'{name}()' at line {line} has an empty domain and no limit in a risky context.",
        "Add a 'limit' or restrict the search domain to prevent full table scans and memory exhaustion.",
    ),
    "override-missing-super": (
        "Override of '{name}' missing super() call",
        "Method '{name}' overrides a lifecycle method but never calls super().",
        "Add a call to super().{name}(...) and return its result.",
    ),
    "missing-translation": (
        "Untranslated message in {name}(...)",
        "The message passed to {name}(...) is not wrapped in _(), so it will not be translated.",
        'Wrap the message in _(), e.g. raise UserError(_("...")).',
    ),
    "deprecated-api-usage": ("{what}", "{why}", "{instead}"),
    "missing-access-csv": (
        "No access {noun} for model '{name}'",
        "Model '{name}' {lack} ir.model.access.csv.",
        "Add access rules for this model in security/ir.model.access.csv.",
    ),
    "unknown-model-in-access-csv": (
        "Access rule references unknown model: {name}",
        "The access rule '{id}' references model '{name}' which cannot be found.",
        "Verify the model name in ir.model.access.csv matches the actual model _name.",
    ),
    "record-rule-without-domain": (
        "ir.rule '{id}' has no restricting domain",
        "Record rule '{id}' defines no domain_force (or an empty domain), granting unrestricted record access.",
        "Add a domain_force expression that limits the records this rule applies to.",
    ),
    "duplicate-xml-id": (
        "Duplicate XML ID: {xml_id}",
        "XML ID '{xml_id}' is defined multiple times. First at {first_path}:{first_line}.",
        "Remove or rename the duplicate XML ID.",
    ),
    "missing-xml-ref": (
        "Unresolved {what}: {ref}",
        "{holder} '{xml_id}' {verb} '{ref}' which cannot be resolved.",
        "Verify the referenced XML ID exists and the providing module is in depends.",
    ),
    "view-field-not-in-model": (
        "View references unknown field '{name}'",
        "View '{xml_id}' for model '{model}' references field '{name}' which is not found.",
        "Add field '{name}' to model '{model}' or remove it from the view.",
    ),
    "button-method-not-found": (
        "Button calls unknown method '{name}'",
        "View '{xml_id}' has button calling '{name}' on model '{model}' which is not found.",
        "Add method '{name}' to model '{model}' or fix the button name attribute.",
    ),
    "orphan-view": (
        "View '{short}' is not referenced",
        "View '{xml_id}' for model '{model}' is not referenced by any action or inherited by another view.",
        "Reference the view from an action's view_id, inherit it, or remove it if unused.",
    ),
    "manifest-missing-required-fields": (
        "Manifest missing required field: '{name}'",
        "The __manifest__.py for '{module}' is missing or has empty field '{name}'.",
        "Add '{name}' to your __manifest__.py.",
    ),
    "manifest-missing-dependency": (
        "Possible missing dependency for '{name}'",
        "Module '{name}' is required but not listed in depends. Evidence: {evidence}.",
        "Add '{name}' to the 'depends' list in __manifest__.py.",
    ),
    "manifest-data-order-risk": (
        "Security file loaded after views/actions",
        "Security file '{file}' is loaded after view/action file '{first_file}'.",
        "Move security files before views and actions in the 'data' list to ensure access rights are created first.",
    ),
    "compute-missing-depends": (
        "Compute reads undeclared field '{name}'",
        "Compute method '{method}' reads field '{name}' but it is not declared in @api.depends.",
        "Add '{name}' to the @api.depends decorator to ensure the compute triggers correctly.",
    ),
    "field-no-string-on-required": (
        "Required field '{name}' has no explicit string",
        "Field '{name}' on model '{model}' is required but has no explicit string= label.",
        'Add string="..." so the required field has a clear, translatable label in the UI.',
    ),
    "missing-ondelete": (
        "Many2one '{name}' has no explicit ondelete",
        "Field '{name}' on model '{model}' is a Many2one without an explicit ondelete policy. The default 'set null' may cause data integrity issues.",
        "Add ondelete='restrict', 'cascade', or 'set null' explicitly to document the intended behavior.",
    ),
    "data-noupdate-risk": (
        "'{model}' record without noupdate",
        "Record '{xml_id}' of model '{model}' is not wrapped in noupdate='1'. It will be overwritten on every module update.",
        "Wrap this record in <data noupdate='1'> to prevent overwriting user modifications.",
    ),
    "removed-model-still-referenced": (
        "Model '{name}' not found in version {version}",
        "Model '{name}' is inherited but could not be resolved in the project or the stubs of version {version}. It may have been removed, renamed, or belongs to an unscanned dependency.{history}",
        "Verify that '{name}' still exists in version {version}. If it was removed or renamed, update your _inherit declaration.",
    ),
    "asset-bundle-missing": (
        "Asset file not found: {asset}",
        "Asset '{asset}' in bundle '{bundle}' does not exist on disk.",
        "Create the file at '{rel}' or remove the reference from the manifest assets.",
    ),
}
#: Old interfaces, with what each finding says.
DEPRECATED = [
    (
        r"^\s*from\s+openerp\b",
        "Import from 'openerp' namespace",
        "The 'openerp' namespace was renamed in version 10.",
        "Replace 'from openerp' with an import from the current namespace.",
    ),
    (
        r"^\s*_columns\s*=\s*\{",
        "Old-style _columns field definition",
        "_columns was removed in version 10. Use new-style field declarations (fields.Char, etc.).",
        "Convert _columns dict entries to class-level field assignments.",
    ),
    (
        r"\bosv\.osv\b|\bosv\.osv_memory\b",
        "Old-style osv.osv base class",
        "osv.osv was removed in version 10. Use models.Model or models.TransientModel.",
        "Replace osv.osv with models.Model and osv.osv_memory with models.TransientModel.",
    ),
    (
        r"\.pool\s*\[|\.pool\.get\s*\(",
        "Old-style registry access via .pool",
        "self.pool was deprecated in version 8. Use self.env['model.name'] instead.",
        "Replace self.pool['model'] or self.pool.get('model') with self.env['model'].",
    ),
]
# Keys, models and names that rules ask for.
REQUIRED_KEYS = ["name", "version", "depends", "data", "installable", "license"]
CRITICAL_MODELS = ["ir.rule", "ir.config_parameter", "ir.cron"]
NOT_FIELDS = ["id", "env", "display_name", "create_uid", "create_date", "write_uid", "write_date"]
LIFECYCLE = ["create", "write", "unlink", "copy", "default_get"]


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    tier: str
    severity: str
    confidence: str
    run: Callable[[Project], DataFrame]
    context: bool = True
    min_version: str | None = "14.0"
    needs: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    fixable: bool = False
    texts: tuple[str, str, str] = ("", "", "")
    #: A condition on call events, if that is all there is to the rule: such rules share one pass over the calls.
    when: str | None = None

    @property
    def own_job(self) -> bool:
        """Whether the rule comes from a plugin: its faults at run time must not end the scan."""
        return not self.run.__module__.startswith(__name__.partition(".")[0] + ".")


REGISTRY: dict[str, Rule] = {}


def rule(name: str, category: str, tier: str, severity: str, confidence: str, **more):
    """Registers a rule.  ``texts`` (title, message, help) is needed where ``TEXTS`` has none."""

    def register(run: Callable[[Project], DataFrame]) -> Callable[[Project], DataFrame]:
        texts = more.pop("texts", None) or TEXTS[name]
        if name in REGISTRY:
            raise ValueError(f"rule {name!r} is registered already")
        REGISTRY[name] = Rule(name, category, tier, severity, confidence, run, texts=texts, **more)
        return run

    return register


def call_rule(name: str, category: str, tier: str, severity: str, confidence: str, when: str, **more) -> None:
    """Registers a rule that is a condition on call events."""
    rule(name, category, tier, severity, confidence, context=False, when=when, **more)(lambda p: p.facts.calls.filter(when))


def load_plugins(group: str = "healthloom.rules") -> list[str]:
    """Imports packaged rules; one that fails is left out and named in the result."""
    from importlib.metadata import entry_points

    failed = []
    for point in entry_points(group=group):
        try:
            point.load()
        except Exception as error:  # a plugin's fault must not end the scan
            failed.append(f"{point.name}: {error}")
    return failed


def filled(template: str) -> Column:
    """A template with {column} places as one string column."""
    parts = re.split(r"\{(\w+)\}", template)
    held = [F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for k, p in enumerate(parts) if p]
    return F.concat(*held) if held else F.lit("")


@dataclass
class Project:
    """What rules see: fact tables and the resolver, for one version."""

    facts: Facts
    version: str = "unknown"
    stubs: R.Stubs | None = None
    index: DataFrame | None = None
    caps: list[str] = field(default_factory=list)

    @cached_property
    def resolver(self) -> R.Resolver:
        return R.Resolver(self.facts, self.stubs or R.no_stubs(self.facts.spark), self.index)

    def at_manifest(self, rows: DataFrame) -> DataFrame:
        """Puts rows (module and others) on line 1 of the module's manifest."""
        at = self.facts.manifests.select("module", "path", F.lit(1).alias("line"), F.lit(0).alias("col"))
        return rows.join(at, "module")

    @cached_property
    def versions(self) -> DataFrame:
        """module, version: the manifest's own if it starts with a known one, else the project's."""
        own = F.nullif(F.regexp_extract(F.coalesce("version", F.lit("")), r"^((?:1[4-9]|[2-9]\d)\.0)", 1), F.lit(""))
        return self.facts.manifests.select("module", F.coalesce(own, F.lit(self.version)).alias("version"))


def _place(rule: Rule) -> int:
    return list(REGISTRY).index(rule.name) if rule.name in REGISTRY else len(REGISTRY)


def _labels(rule: Rule) -> list[Column]:
    """What a finding takes from its rule, and its texts."""
    held = {"rule": rule.name, "category": rule.category, "severity": rule.severity, "tier": rule.tier, "confidence": rule.confidence}
    texts = {k: filled(t) for k, t in zip(("title", "message", "help"), rule.texts)}
    return [*(F.lit(v).alias(k) for k, v in held.items()), *(c.alias(k) for k, c in texts.items()), F.lit(_place(rule)).alias("place")]


FOUND = ["module", "path", "line", "col", "rule", "category", "severity", "tier", "confidence", "title", "message", "help", "place", "n"]


def found_by(rule: Rule, project: Project) -> DataFrame:
    """A rule's rows with its labels (the columns ``FOUND``)."""
    rows = rule.run(project)
    n = F.col("n") if "n" in rows.columns else F.lit(0)
    return rows.select("module", "path", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), *_labels(rule), n.cast("long").alias("n"))


def found_in_calls(rules: list[Rule], project: Project) -> DataFrame:
    """All rules that are conditions on calls, in one pass: each call is paired with the rules that it meets."""
    met = F.filter(F.array(*[F.when(F.expr(r.when), F.struct(*_labels(r))) for r in rules]), lambda x: x.isNotNull())
    return project.facts.calls.select("module", "path", "line", "col", F.col("n").cast("long").alias("n"), F.explode(met).alias("r")).select(
        "module", "path", "line", "col", "n", "r.*"
    ).select(*FOUND)


def as_findings(found: DataFrame, project: Project) -> DataFrame:
    """Rows of ``FOUND`` as findings.  Versions are joined once, a row per module."""
    rows = found.join(project.versions, "module", "left")
    return rows.select(
        "module", F.col("path").alias("file_path"), "line", F.col("col").alias("column"), "rule", "category", "severity", "tier",
        F.lit("native").alias("source"), "confidence", "title", "message", "help",
        F.coalesce("version", F.lit("unknown")).alias("odoo_version"), F.lit(None).cast("string").alias("url"),
        (F.col("place").cast("long") * (1 << 32) + F.col("n")).alias("seq"),
    )


def findings_of(rule: Rule, project: Project) -> DataFrame:
    """One rule's findings."""
    return as_findings(found_by(rule, project), project)


# --- rules on one file -----------------------------------------------------------------------

one_file = {"context": False}


call_rule("raw-sql-string-interpolation", "Security", "P0", "error", "high", "tainted_sql")


call_rule("eval-usage", "Security", "P0", "error", "high", "bare AND name IN ('eval', 'exec') AND NOT first_constant")


@rule("public-controller-sudo-risk", "Security", "P1", "error", "high", **one_file)
def public_sudo(p: Project) -> DataFrame:
    return p.facts.of("controller").filter("auth IN ('public', 'none') AND sudo")


call_rule("sudo-without-comment", "Security", "P1", "warning", "medium", "NOT bare AND name = 'sudo' AND NOT excused")


IN_LOOP = "NOT bare AND in_loop AND orm_here AND name IN "


call_rule("search-in-loop", "Performance", "P1", "warning", "high", IN_LOOP + "('search', 'search_count', 'browse', 'read')")


call_rule("create-in-loop", "Performance", "P1", "warning", "high", IN_LOOP + "('create')")


call_rule("write-in-loop", "Performance", "P1", "warning", "high", IN_LOOP + "('write')")


@rule("n-plus-one-read", "Performance", "P1", "warning", "low", **one_file)
def n_plus_one(p: Project) -> DataFrame:
    chains = p.facts.of("chain")
    first = F.min(F.struct("n", "col")).alias("f")
    return chains.groupBy("module", "path", "loop", "line").agg(first).select("module", "path", "line", "f.n", "f.col")


call_rule(
    "unbounded-search", "Performance", "P2", "warning", "high",
    "NOT bare AND risky AND orm AND everything AND NOT limited AND name IN ('search', 'search_read')",
)


@rule("override-missing-super", "Correctness", "P1", "error", "high", **one_file)
def missing_super(p: Project) -> DataFrame:
    rows = p.facts.of("model").select("module", "path", "n", F.explode("methods").alias("x"))
    held = rows.select("module", "path", "n", F.col("x.line").alias("line"), F.lit(0).alias("col"), "x.name", "x.supers")
    return held.filter(~F.col("supers") & F.col("name").isin(LIFECYCLE))


call_rule(
    "missing-translation", "Maintainability", "P2", "info", "medium",
    "first_text AND name IN ('UserError', 'ValidationError', 'Warning', 'RedirectWarning')",
)


@rule("deprecated-api-usage", "Upgrade Safety", "P1", "warning", "high", **one_file)
def deprecated_api(p: Project) -> DataFrame:
    told = lambda a, b, c: F.struct(F.lit(a).alias("what"), F.lit(b).alias("why"), F.lit(c).alias("instead"))
    hits = K.pattern_hits(F.col("text"), [("(?U)" + pattern, told(*texts)) for pattern, *texts in DEPRECATED])
    return p.facts.lines.select("module", "path", "line", F.lit(0).alias("col"), F.posexplode(hits).alias("n", "e")).select("*", "e.*").drop("e")


# --- rules on whole modules ------------------------------------------------------------------


@rule("missing-access-csv", "Security", "P0", "error", "high")
def missing_access(p: Project) -> DataFrame:
    concrete = p.facts.models.filter("name IS NOT NULL AND NOT abstract AND NOT transient").select("module", "name")
    covered = p.facts.access.select("module", F.explode(C.candidate_models(F.col("external"))).alias("name")).distinct()
    some = p.facts.access.select("module").distinct().withColumn("has", F.lit(True))
    rows = K.absent(concrete, covered, ["module", "name"]).join(some, "module", "left")
    noun = F.when(F.col("has"), "rule").otherwise("rules")
    lack = F.when(F.col("has"), "is not covered in").otherwise("has no entry in")
    return p.at_manifest(rows.withColumns({"noun": noun, "lack": lack}))


@rule("unknown-model-in-access-csv", "Correctness", "P1", "error", "high")
def unknown_access_model(p: Project) -> DataFrame:
    own = p.facts.access.filter("owner = module").withColumn("candidate", F.explode(C.candidate_models(F.col("external"))))
    told = p.resolver.models(own, "candidate")
    keys = ["module", "path", "line", "col", "n", "id", "external"]
    rows = told.groupBy(*keys).agg(F.max(F.col("status") == R.FOUND).alias("found")).filter("NOT found")
    return rows.withColumn("name", C.external_to_model(F.col("external")))


@rule("record-rule-without-domain", "Security", "P1", "warning", "medium")
def open_record_rule(p: Project) -> DataFrame:
    return p.facts.access_domains.filter(C.is_open_domain(F.col("domain")))


@rule("duplicate-xml-id", "Correctness", "P1", "error", "high")
def duplicate_xml_id(p: Project) -> DataFrame:
    return later_definitions(p.facts.records, ["module", "xml_id"], ["pos", "n"], ["path", "line"])


@rule("missing-xml-ref", "Correctness", "P1", "error", "high")
def missing_xml_ref(p: Project) -> DataFrame:
    refs = p.facts.records.select("module", "path", "line", "col", "n", "xml_id", F.explode("refs").alias("r"))
    first = F.min("r.line")  # of equal references in a record the first line counts for all
    refs = refs.groupBy("module", "path", "col", "n", "xml_id", F.col("r.ref").alias("ref")).agg(first.alias("line")).withColumns(
        {"what": F.lit("XML reference"), "holder": F.lit("XML record"), "verb": F.lit("references")}
    )
    parents = p.facts.views.filter("parent != ''").select(
        "module", "path", "line", "col", "n", "xml_id", F.col("parent").alias("ref"),
        F.lit("inherit_id").alias("what"), F.lit("View").alias("holder"), F.lit("inherits from").alias("verb"),
    )
    asked = refs.unionByName(parents).withColumn("full", qualified(F.col("ref"), F.col("module")))
    return p.resolver.xml(asked, "full").filter(F.col("status").isin(R.NOT_FOUND, R.LOCAL_NOT_FOUND))


def _view_members(p: Project, column: str, kind: str) -> DataFrame:
    rows = p.facts.views.select("module", "path", "col", "n", "xml_id", "model", F.explode(column).alias("x"))
    asked = rows.select("module", "path", "col", "n", "xml_id", "model", "x.name", "x.line")
    return p.resolver.member(asked, kind).filter(F.col("status") == R.NOT_FOUND)


@rule("view-field-not-in-model", "Correctness", "P1", "error", "high")
def unknown_view_field(p: Project) -> DataFrame:
    return _view_members(p, "fields", "field")


@rule("button-method-not-found", "Correctness", "P1", "error", "high")
def unknown_button_method(p: Project) -> DataFrame:
    return _view_members(p, "buttons", "method")


@rule("orphan-view", "Maintainability", "P2", "info", "medium")
def orphan_view(p: Project) -> DataFrame:
    refs = p.facts.records.select("module", F.explode("refs").alias("r")).select("module", C.short_id(F.col("r.ref")).alias("short"))
    parents = p.facts.views.filter("parent != ''").select("module", C.short_id(F.col("parent")).alias("short"))
    roots = p.facts.views.filter("parent IS NULL OR parent = ''").withColumn("short", C.short_id(F.col("xml_id")))
    return K.absent(roots, refs.unionByName(parents), ["module", "short"])


@rule("manifest-missing-required-fields", "Module Hygiene", "P2", "warning", "high", fixable=True)
def missing_manifest_fields(p: Project) -> DataFrame:
    keys = F.explode(K.unfilled(F.col("filled"), REQUIRED_KEYS)).alias("name")
    return p.facts.manifests.select("module", "path", F.lit(1).alias("line"), F.lit(0).alias("col"), keys).withColumn(
        "n", F.array_position(F.lit(REQUIRED_KEYS), F.col("name"))
    )


@rule("manifest-missing-dependency", "Module Hygiene", "P1", "warning", "high")
def missing_dependency(p: Project) -> DataFrame:
    facts, told = p.facts, ["module", "name", "kind", "ord", "sub", "evidence"]
    inherited = facts.models.select("module", F.col("key").alias("ord"), F.posexplode("inherit").alias("sub", "parent"))
    owned = p.resolver.owners(inherited, "parent").filter("owner IS NOT NULL")
    owned = owned.select("module", F.col("owner").alias("name"), F.lit(0).alias("kind"), "ord", "sub", filled("Model inherit: '{parent}'").alias("evidence"))
    known = F.broadcast(p.resolver.known_modules().withColumnRenamed("module", "name"))  # a row per module
    place = F.format_string("%010d %010d", "pos", "n")
    refs = facts.records.select("module", "xml_id", place.alias("ord"), F.posexplode("refs").alias("sub", "r"))
    refs = refs.select(
        "module", C.external_module(F.col("r.ref")).alias("name"), F.lit(1).alias("kind"), "ord", "sub",
        F.concat(F.lit("XML ref in record '"), "xml_id", F.lit("': '"), "r.ref", F.lit("'")).alias("evidence"),
    )
    views = facts.views.filter("parent != ''").select(
        "module", C.external_module(F.col("parent")).alias("name"), F.lit(2).alias("kind"), place.alias("ord"), F.lit(0).alias("sub"),
        filled("Inherited view in view '{xml_id}': '{parent}'").alias("evidence"),
    )
    every = owned.select(*told).unionByName(refs.unionByName(views).join(known, "name", "left_semi").select(*told))
    depends = facts.manifests.select("module", F.explode("depends").alias("name")).distinct()
    missing = K.absent(every.filter((F.col("name") != F.col("module")) & ~F.col("name").isin(R.ALWAYS)), depends, ["module", "name"])
    return p.at_manifest(K.listed_evidence(missing.withColumn("at", F.struct("kind", "ord", "sub")), ["module", "name"], "evidence", "at"))


@rule("manifest-data-order-risk", "Module Hygiene", "P2", "warning", "high", fixable=True)
def data_order(p: Project) -> DataFrame:
    files = p.facts.data_files.withColumns({"secure": C.is_security_file(F.col("file")), "shows": C.is_view_file(F.col("file"))})
    late = K.after_first(files, "module", "pos", "shows AND NOT secure", "secure", ["file"])
    return p.at_manifest(late.select("module", "file", "first_file", F.col("pos").alias("n")))


@rule("compute-missing-depends", "Correctness", "P2", "warning", "high")
def compute_missing_depends(p: Project) -> DataFrame:
    m, models = p.facts.methods, p.facts.models.select("module", "key", F.col("path").alias("m_path"))
    held = m.filter(F.array_contains("decorators", "api.depends") & (F.size("depends") > 0))
    # methods of the file that defines the model
    held = held.join(models, ["module", "key"]).filter("path = m_path")
    heads = F.transform("depends", lambda d: F.substring_index(d, ".", 1))
    unread = F.array_except(F.array_except("reads", heads), F.lit(NOT_FIELDS))
    asked = held.select("module", "path", "line", F.lit(0).alias("col"), F.col("key").alias("model"), F.col("name").alias("method"), F.posexplode(unread).alias("n", "name"))
    return p.resolver.member(asked, "field").filter(F.col("status") == R.FOUND)


def _model_fields(p: Project) -> DataFrame:
    models = p.facts.models.select(
        "module", "key", F.col("name").alias("m_name"), "abstract", "transient", F.col("path").alias("m_path"),
        F.col("line").alias("m_line"), F.array_join("inherit", "|").alias("parents"),
    )
    rows = p.facts.fields.drop("path").join(models, ["module", "key"])
    return rows.withColumns({"path": F.col("m_path"), "col": F.lit(0), "model": F.coalesce("m_name", "parents")})


@rule("field-no-string-on-required", "Maintainability", "P2", "info", "medium")
def required_without_label(p: Project) -> DataFrame:
    return _model_fields(p).filter("required AND string IS NULL")


@rule("missing-ondelete", "Data Integrity", "P1", "warning", "high")
def missing_ondelete(p: Project) -> DataFrame:
    return _model_fields(p).filter("m_name IS NOT NULL AND NOT abstract AND NOT transient AND type = 'Many2one' AND ondelete IS NULL")


@rule("data-noupdate-risk", "Data Integrity", "P2", "warning", "high")
def noupdate_risk(p: Project) -> DataFrame:
    return p.facts.records.filter(F.col("model").isin(CRITICAL_MODELS) & ~F.col("noupdate"))


@rule("removed-model-still-referenced", "Upgrade Safety", "P1", "warning", "medium")
def removed_model(p: Project) -> DataFrame:
    rows = p.facts.models.select("module", "path", "line", F.lit(0).alias("col"), F.col("name").alias("own"), F.posexplode("inherit").alias("n", "name"))
    asked = rows.filter(~F.col("name").eqNullSafe(F.col("own")))
    # the version is part of the texts
    rows = p.resolver.models(asked, "name").filter(F.col("status") != R.FOUND).join(p.versions, "module", "left")
    lost = p.resolver.stubs.lost
    if lost is None:
        return rows.withColumn("history", F.lit(""))
    # a store of versions tells what is gone from what was never known
    now = F.when(F.col("now").isNotNull(), filled(" '{now}' has the same members now.")).otherwise("")
    told = lost.select(F.col("model").alias("name"), F.concat(filled(" Version {last} had it."), now).alias("history"))
    return rows.join(told, "name", "left")


@rule("asset-bundle-missing", "Frontend", "P2", "warning", "high", min_version="15.0")
def missing_asset(p: Project) -> DataFrame:
    listed = p.facts.manifests.select("module", F.explode("assets").alias("a")).select("module", "a.bundle", F.posexplode("a.files").alias("n", "raw"))
    plain = listed.filter(~F.col("raw").rlike(r"[*?]|://") & ~F.col("raw").rlike(r"^[()]"))
    named = plain.withColumn("asset", F.trim("raw")).filter(F.substring_index("asset", "/", 1) == F.col("module")).filter("instr(asset, '/') > 0")
    named = named.withColumn("rel", F.expr("substring(asset, instr(asset, '/') + 1)"))
    present = p.facts.files.select("module", "rel")
    folders = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda k: F.array_join(F.slice(F.split("rel", "/"), F.lit(1), k), "/")))
    present = present.select("module", folders.alias("rel")).distinct()  # folders exist as well
    return p.at_manifest(K.absent(named, present, ["module", "rel"]))
