"""Queries that take the engine's remaining operators over modules written from ``supplier`` (see ``generated.py``)
or over small made-up graphs, each with a DuckDB twin.

Trees and commits are written to the shared folder by executors and read back
through the sources ``module_tree`` and ``commit_tree``.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import baseline, resolve, scoring, symbols
from ..operators import findings as P
from ..session import durable, open_folder, spread
from ..sources import commits, store
from ..sources import linters as L
from ..sources.parsed import Facts
from ..sources.tree import read_tree
from ..streaming import trees
from . import cache, fixes, generated, reports, scan
from .config import Config
from .rules import REGISTRY, Project, findings_of
from .table_queries import CATS, RAW, findings, normal, query, score_sql, scored, table


def put_files(rows: DataFrame, top: str) -> None:
    """Writes ``rows`` (rel, content) as files below ``top``, each by the task that holds it."""

    def run(source):
        for batch in source:
            for rel, content in zip(batch.rel, batch.content):
                path = os.path.join(top, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(content)
            yield batch[["rel"]]

    rows.select("rel", "content").mapInPandas(run, "rel string").count()


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The generated modules as files, one that is switched off, one that is broken, and a folder that is no module."""
    top = open_folder(spark, "tree")
    files = generated.files(spark, sf_dir)
    every = files.select(F.concat_ws("/", "module", "rel").alias("rel"), "content")
    ninth = files.filter((F.col("kind") == "manifest") & (F.col("module_ord") % 9 == 0))
    more = ninth.select(F.concat("module", F.lit("/static/readme.txt")).alias("rel"), F.lit(b"read me").alias("content"))
    odd = [("off/__manifest__.py", b"{'name': 'off', 'installable': False}"), ("broken/__manifest__.py", b"{'name': "), ("plain/notes.py", b"x = 1\n")]
    put_files(every.unionByName(more).unionByName(spark.createDataFrame(odd, "rel string, content binary")), top)
    return top


RELS = "('__manifest__.py', 'manifest'), ('models/m.py', 'python'), ('views/v.xml', 'xml'), ('security/ir.model.access.csv', 'access')"


@query(
    f"SELECT 'g' || s_suppkey AS module, rel, kind, true AS readable FROM supplier CROSS JOIN (VALUES {RELS}) f(rel, kind)"
    " UNION ALL SELECT 'g' || s_suppkey, 'static/readme.txt', 'other', false FROM supplier WHERE s_suppkey % 9 = 0"
)
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery and reading of a source tree."""
    return read_tree(spark, [written_tree(spark, sf_dir)]).select("module", "rel", "kind", F.col("content").isNotNull().alias("readable"))


@query(generated.FINDINGS_SQL)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan of a source tree on disk, its findings stored under the tree's fingerprint and read from there."""
    top = written_tree(spark, sf_dir)
    kept = open_folder(spark, "kept")
    result = scan.scan(spark, [top], Config(ignore_files=[]), generated.VERSION, cache_dir=kept)
    result.release()
    again = scan.scan(spark, [top], Config(ignore_files=[]), generated.VERSION, cache_dir=kept)
    path = F.concat(F.lit("/gen"), F.substring("file_path", F.lit(len(top) + 1), F.char_length("file_path")))
    return again.findings.select("module", path.alias("file_path"), "line", "rule", "category", "tier", "confidence", "eligible")


@query("SELECT 'g' || s_suppkey || '.thing' AS model, 'g' || s_suppkey AS module FROM supplier")
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.source_index(spark, written_tree(spark, sf_dir))


@query(
    "SELECT 'g' || s_suppkey || '.thing' AS model, kind, array_to_string(list_sort(names), ' ') AS names FROM ("
    " SELECT s_suppkey, 'field' AS kind, CASE s_suppkey % 6 WHEN 0 THEN ['code', 'name', 'other_id', 'partner_id'] ELSE ['name', 'partner_id'] END AS names FROM supplier"
    " UNION ALL SELECT s_suppkey, 'method', [CASE s_suppkey % 6 WHEN 1 THEN 'run' WHEN 2 THEN 'write' WHEN 3 THEN '_compute_x' ELSE 'go' END] FROM supplier WHERE s_suppkey % 6 != 0)"
)
def stub_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stubs built from a tree, written as a file of their version, and read back."""
    folder = open_folder(spark, "stubs")
    facts = Facts(generated.files(spark, sf_dir)).settle()
    resolve.build_stubs(facts, "17.0").write.text(os.path.join(folder, "17.0.json"))
    facts.release()
    held = resolve.stubs_for(spark, folder, "17.0.3")
    return held.members.groupBy("model", "kind").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


@query(
    "SELECT 'g' || s_suppkey AS module FROM supplier UNION SELECT unnest(["
    + ", ".join(f"'{m}'" for m in sorted({*resolve.ALWAYS, *resolve.OWNERS.values()}))
    + "])"
)
def known_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = Facts(generated.files(spark, sf_dir)).settle()
    return resolve.Resolver(facts, resolve.no_stubs(spark)).known_modules()


def result_of(spark: SparkSession, sf_dir: str) -> scan.ScanResult:
    facts, found = generated.scanned(spark, sf_dir)
    found = durable(found)  # scores and reports read it several times
    scope = sorted({r.category for r in scan.active_rules(generated.VERSION, [])})
    cats = scoring.category_scores(found, facts.manifests, scoring.category_table(spark, scope=scope))
    scores = scoring.with_labels(scoring.module_scores(cats))
    columns = [c for c in P.COLUMNS if c not in found.columns]
    return scan.ScanResult(found.withColumns({c: F.lit(None) for c in columns}), scores, cats, facts, generated.VERSION, [])


@query(
    f"WITH {generated._expected()} SELECT 'g' || s_suppkey AS module, count(rule)::BIGINT AS n_findings, count(*) FILTER (eligible)::BIGINT AS counted, {len(P.CATEGORIES)}::BIGINT AS n_categories,"
    " coalesce(string_agg(rule, ' ' ORDER BY rule), '') AS rules FROM supplier LEFT JOIN found ON module = 'g' || s_suppkey GROUP BY s_suppkey"
)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's document of each module, read back from its text."""
    body = reports.module_documents(result_of(spark, sf_dir))
    shape = "struct<score:struct<diagnostics_counted:bigint,categories:array<struct<category:string>>>,diagnostics:array<struct<rule:string>>>"
    held = body.select("module", F.from_json("body", shape).alias("d"))
    return held.select(
        "module", F.size("d.diagnostics").cast("long").alias("n_findings"), F.col("d.score.diagnostics_counted").alias("counted"),
        F.size("d.score.categories").cast("long").alias("n_categories"), F.array_join(F.array_sort("d.diagnostics.rule"), " ").alias("rules"),
    )


@query(
    f"WITH {RAW} SELECT seq, rule, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, substr(file_path, 6) AS uri,"
    " greatest(1, line)::BIGINT AS start_line, 1::BIGINT AS start_column, message FROM raw"
)
def sarif_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = (
        "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:"
        "struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint,startColumn:bigint>>>>>"
    )
    held = reports.sarif_results(normal(spark, sf_dir), "/src").select("seq", F.from_json("body", shape).alias("d"))
    place = F.get("d.locations", F.lit(0))["physicalLocation"]
    return held.select(
        "seq", F.col("d.ruleId").alias("rule"), F.col("d.level").alias("level"), place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("start_line"), place["region"]["startColumn"].alias("start_column"), F.col("d.message.text").alias("message"),
    )


@query(f"WITH {RAW} SELECT DISTINCT sha256(concat_ws(chr(0), rule, module, file_path, '')) AS identity FROM raw")
def baseline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities written as a baseline file and read back."""
    path = os.path.join(open_folder(spark, "baseline"), "known.json")
    baseline.write_baseline(baseline.with_identity(normal(spark, sf_dir)), path)
    return baseline.read_baseline(spark, path)


@query(
    f"WITH {RAW}, {CATS}, {score_sql('raw')} SELECT module, CASE WHEN blend * 10 >= 8995 * n THEN 'Excellent' WHEN blend * 10 >= 7495 * n THEN 'Good'"
    " WHEN blend * 10 >= 4995 * n THEN 'Needs work' ELSE 'Critical' END AS label FROM blends"
)
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_labels(scored(spark, findings(spark, sf_dir))[1]).select("module", "label")


@query(
    f"WITH {RAW} SELECT r::INT AS part, s AS severity, (SELECT bool_or(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END >= least) FROM raw WHERE seq % 3 = r) AS hit"
    " FROM range(3) p(r) CROSS JOIN (VALUES ('error', 3), ('warning', 2), ('info', 1), ('none', 9)) v(s, least)"
)
def any_at_or_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any finding is at least that severe, for three parts of the findings."""
    rows = normal(spark, sf_dir)
    told = [(k, s, P.at_or_above(rows.filter(F.col("seq") % 3 == k), s)) for k in range(3) for s in ("error", "warning", "info", "none")]
    return spark.createDataFrame(told, "part int, severity string, hit boolean")


@query(
    "SELECT '/gen/g' || s_suppkey || '/__manifest__.py' AS path, (s_suppkey % 4 = 0)::INT + (s_suppkey % 3 = 0)::INT AS fixed, true AS licensed, true AS secure_first"
    " FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 = 0"
)
def fixed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fixers over the manifests that a scan finds fault with."""
    facts, found = generated.scanned(spark, sf_dir)
    made = fixes.compute_fixes(found, facts.files)
    at = lambda part: F.instr("new_text", part)
    return made.filter("old_text != new_text").select("path", "fixed", (at("'license': ") > 0).alias("licensed"), (at("security/") < at("views/")).alias("secure_first"))


@query("SELECT '17.0' AS version, 'unknown' AS mixed, '16.0' AS given")
def detected_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Told by all manifests, by manifests that disagree, and by what is given."""
    files = generated.files(spark, sf_dir).filter("kind = 'manifest'")
    other = F.replace(F.col("content").cast("string"), F.lit("17.0.1.0"), F.lit("16.0.1.0")).cast("binary")
    mixed = files.withColumn("content", F.when(F.col("module_ord") % 2 == 0, other).otherwise(F.col("content")))
    told = (scan.detect_version(Facts(files)), scan.detect_version(Facts(mixed)), scan.detect_version(Facts(mixed), None, "16.0"))
    return spark.createDataFrame([told], "version string, mixed string, given string")


@query(
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/src/n' || c_nationkey || '/z/w.py' WHEN 1 THEN '/p/k' || c_custkey || '.py'"
    " WHEN 2 THEN '/k' || c_custkey || '.py' ELSE '/p/q/a/' || c_nationkey || '/b.py' END AS path FROM customer"
)
def folded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with chains of ``..``, too many of them, and relative ones."""
    c, n, k = table(spark, sf_dir, "customer"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    deep = F.concat(F.lit("/src/n"), n, F.lit("/x/y/v/../../../"), "c_mktsegment", F.lit("/./"), k, F.lit("/../..\\z/w.py"))
    up = F.concat(F.lit("m/n/../../../k"), k, F.lit(".py"))
    beyond = F.concat(F.lit("/../a/../../../k"), k, F.lit(".py"))
    near = F.concat(F.lit("a//"), n, F.lit("/./b.py"))
    kind = F.col("c_custkey") % 4
    spelled = F.when(kind == 0, deep).when(kind == 1, up).when(kind == 2, beyond).otherwise(near)
    return c.select("c_custkey", C.normal_path(spelled, "/p/q").alias("path"))


CHAIN, LAYERS = 100, 20


@query(
    f"SELECT 'c' || i AS model, true AS complete FROM range({CHAIN}) t(i)"
    f" UNION ALL SELECT 'l' || y || '_' || j, y < 2 FROM range({LAYERS}) a(y) CROSS JOIN range(2) b(j)"
)
def deep_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of a hundred models, and twenty layers of diamonds (a million paths)."""
    text = lambda head, *parts: F.concat(F.lit(head), *[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    i = F.col("id")
    chain = spark.range(CHAIN).select(text("c", i).alias("model"), F.when(i > 0, text("c", i - 1)).alias("parent"))
    y, j = F.floor(i / 2), i % 2
    layers = spark.range(2 * LAYERS).select(
        text("l", y, "_", j).alias("model"), F.explode(F.array(text("l", y - 1, "_0"), text("l", y - 1, "_1"))).alias("parent"), y.alias("y")
    )
    layers = layers.select("model", F.when(F.col("y") > 0, F.col("parent")).alias("parent")).distinct()
    return resolve.complete_models(chain.unionByName(layers), spark.createDataFrame([], "model string, complete boolean"))


@query(
    "SELECT 'c' || c_custkey AS model, true AS complete FROM customer"
    " UNION ALL SELECT 'p' || p_partkey, p_partkey % 3 != 0 FROM part"
    " UNION ALL SELECT 's' || s_suppkey, s_suppkey % 4 = 1 FROM supplier"
    " UNION ALL SELECT 'o' || o_orderkey, o_custkey = 0 FROM orders"
)
def inherited_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain through all customers; parts with one parent, known or not; suppliers with two parents; orders whose two parents meet unless one is
    customer 0, which stands by itself.

    A supplier's second parent is a model without parents, the first part (which has an unknown one if its number
    is a multiple of three), one of the first customers, where the walks meet, or a cycle, by its number modulo four.
    """
    text = lambda head, of: F.concat(F.lit(head), of.cast("string"))
    edges = lambda df, model, *parents: df.select(model.alias("model"), F.explode(F.array(*parents)).alias("parent"))
    c, p, s, o = (table(spark, sf_dir, t) for t in ("customer", "part", "supplier", "orders"))
    k = F.col("c_custkey")
    chain = edges(c, text("c", k), F.when(k > 1, text("c", k - 1)))
    k = F.col("p_partkey")
    parts = edges(p, text("p", k), F.when(k % 3 == 0, F.lit("nowhere")).otherwise(F.when((k % 3 == 1) & (k > 3), text("p", k - 2))))
    k = F.col("s_suppkey")
    other = F.when(k % 4 == 0, text("p", F.lit(3))).when(k % 4 == 1, F.lit("p2")).when(k % 4 == 2, text("c", k % 5 + 1)).otherwise(text("s", k))
    suppliers = edges(s, text("s", k), text("c", k), F.when(k % 4 == 3, F.lit("ring0")).otherwise(other))
    ring = spark.range(3).select(text("ring", F.col("id")).alias("model"), text("ring", (F.col("id") + 1) % 3).alias("parent"))
    k = F.col("o_orderkey")
    orders = edges(o, text("o", k), text("c", F.col("o_custkey")), text("c", F.col("o_custkey") % 7 + 1))
    every = reduce(DataFrame.unionByName, [chain, parts, suppliers, ring, orders])
    return resolve.complete_models(every, spark.createDataFrame([], "model string, complete boolean")).filter("model NOT LIKE 'ring%'")


@query(
    "SELECT '/gen/g' || s_suppkey || '/views/v.xml' AS path, 7 AS line, 'data-noupdate-risk' AS rule FROM supplier WHERE s_suppkey % 4 = 1"
    " UNION ALL SELECT '/gen/g' || s_suppkey || '/models/m.py', 7, 'missing-translation' FROM supplier WHERE s_suppkey % 6 = 5"
)
def comment_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressions told by comments in Python and in XML."""
    return Facts(generated.files(spark, sf_dir)).suppressions


def written_commits(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """A repository with two commits of the generated modules: its folder, the earlier commit, the later one."""
    repo = os.path.join(open_folder(spark, "commits"), "modules.git")
    earlier = commits.write_commit(generated.earlier_files(spark, sf_dir), repo, "main")
    return repo, earlier, commits.write_commit(generated.later_files(spark, sf_dir), repo, "main")


EARLIER, LATER = "s_suppkey % 11 != 0", "s_suppkey % 13 != 0"
OF = "substr(module, 2)::BIGINT"


@query(
    f"SELECT 'g' || s_suppkey || '/' || rel AS path, CASE WHEN NOT ({EARLIER}) THEN 'added' WHEN NOT ({LATER}) THEN 'removed' ELSE 'edited' END AS change"
    f" FROM supplier CROSS JOIN (VALUES {RELS}) f(rel, kind) WHERE ({EARLIER}) != ({LATER}) OR ({EARLIER}) AND s_suppkey % 3 = 0 AND kind = 'xml'"
)
def commit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two commits, told by the names of their blobs."""
    repo, earlier, later = written_commits(spark, sf_dir)
    found = commits.changes(commits.list_commits(spark, repo, [earlier, later]), earlier, later)
    return found.select(F.expr(f"substring(path, {len(repo) + 2})").alias("path"), "change")


def _commit_scores(which: str, found: str) -> str:
    return generated.scores_of(found, f"SELECT 'g' || s_suppkey AS module FROM supplier WHERE {which}")


@query(
    f"WITH {generated._expected()}, {generated.CATEGORY_SQL}, later AS (SELECT * FROM found WHERE NOT (file_path LIKE '%.xml' AND {OF} % 3 = 0)),"
    f" a AS ({_commit_scores(EARLIER, 'found')}), b AS ({_commit_scores(LATER, 'later')})"
    " SELECT module, a.blend AS before, b.blend AS after, b.blend - a.blend AS delta FROM a FULL JOIN b USING (module)"
)
def commit_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each module at two commits: both are scanned from one listing, and equal blobs are parsed once."""
    repo, earlier, later = written_commits(spark, sf_dir)
    done = scan.scan_commits(spark, repo, [earlier, later], Config(ignore_files=[]), generated.VERSION)
    whole = [done[name].scores.withColumn("overall", F.col("blend")) for name in (later, earlier)]
    return scoring.module_deltas(*whole)


@query(
    "WITH c AS (SELECT s_suppkey AS k, kind, CASE kind WHEN 'manifest' THEN CASE WHEN s_suppkey % 5 = 0 THEN 'own ' || s_suppkey ELSE concat_ws(' ', s_suppkey % 2 = 0, s_suppkey % 3 = 0, s_suppkey % 4 = 0) END"
    f" WHEN 'access' THEN CASE WHEN s_suppkey % 3 = 1 THEN 'head' ELSE 'own ' || s_suppkey END ELSE 'own ' || s_suppkey END AS name FROM supplier CROSS JOIN (VALUES {RELS}) f(rel, kind)),"
    " e AS (SELECT DISTINCT kind, name FROM c WHERE k % 11 != 0),"
    " l AS (SELECT DISTINCT kind, CASE WHEN kind = 'xml' AND k % 3 = 0 THEN 'empty' ELSE name END AS name FROM c WHERE k % 13 != 0)"
    " SELECT kind, (SELECT count(*) FROM e WHERE e.kind = v.kind)::BIGINT AS parsed_first, (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM e) d WHERE d.kind = v.kind)::BIGINT AS parsed_later"
    " FROM (VALUES ('manifest'), ('python'), ('xml'), ('access')) v(kind)"
)
def parsed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents a store of facts had to parse: for one commit, and then for a later one."""
    repo, earlier, later = written_commits(spark, sf_dir)
    held = store.FactStore(spark, open_folder(spark, "store"))
    of_batch = []
    for source in scan.commit_sources(spark, repo, [earlier, later]).values():
        held.fill(source.listing, source.contents)
        of_batch.append(held.known().groupBy("kind").agg(F.count("*").alias("n")))
        of_batch[-1] = durable(of_batch[-1])
    first, both = of_batch
    return both.join(first.withColumnRenamed("n", "parsed_first"), "kind", "left").select(
        "kind", F.coalesce("parsed_first", F.lit(0)).alias("parsed_first"), (F.col("n") - F.coalesce("parsed_first", F.lit(0))).alias("parsed_later")
    )


@query(
    f"WITH {generated._expected()} SELECT module, regexp_replace(file_path, '^/gen/', '') AS path, line, rule, eligible FROM found"
    f" WHERE {OF} % 13 != 0 AND NOT (file_path LIKE '%.xml' AND {OF} % 3 = 0)"
)
def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a commit whose contents are mostly in the store already: its findings are those of a full scan."""
    repo, earlier, later = written_commits(spark, sf_dir)
    place = open_folder(spark, "store")
    scan.scan_commits(spark, repo, [earlier], Config(ignore_files=[]), generated.VERSION, store=place)[earlier].release()
    done = scan.scan_commits(spark, repo, [later], Config(ignore_files=[]), generated.VERSION, store=place)[later]
    return done.findings.select("module", F.expr(f"substring(file_path, {len(repo) + 2})").alias("path"), "line", "rule", "eligible")


def written_versions(spark: SparkSession, sf_dir: str) -> str:
    """A store of two versions: what the generated modules define, and the same later, when every seventh model has another name and every fifth is gone."""
    folder = open_folder(spark, "symbols")
    k = F.col("module_ord")
    text = F.replace(F.col("content").cast("string"), F.lit(".thing'"), F.lit(".item'"))
    text = F.replace(text, F.lit("_inherit = 'sale.order'"), F.lit("_inherit = 'sale.line'"))
    renamed = (k % 7 == 0) & (F.col("kind") == "python")
    old = generated.files(spark, sf_dir)
    new = old.filter(k % 5 != 0).withColumn("content", F.when(renamed, text.cast("binary")).otherwise(F.col("content")))
    for version, files in (("16.0", old), ("17.0", new)):
        facts = Facts(files).settle()
        symbols.write_version(symbols.symbols_of(facts), folder, version)
        facts.release()
    return folder


@query(
    "WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 = 0 AS gone, s_suppkey % 7 = 0 AND s_suppkey % 5 != 0 AS moved FROM supplier),"
    # bodies are alike by number modulo six, so a rename is told if it is the only loss and the only gain among them
    " g AS (SELECT k % 6 AS b, count(*) FILTER (gone OR moved) AS losses, count(*) FILTER (moved) AS gains FROM s GROUP BY 1)"
    " SELECT 'g' || k || '.thing' AS model, CASE WHEN moved AND losses = 1 AND gains = 1 THEN 'renamed' ELSE 'removed' END AS change,"
    " CASE WHEN moved AND losses = 1 AND gains = 1 THEN 'g' || k || '.item' END AS now FROM s JOIN g ON b = k % 6 WHERE gone OR moved"
    " UNION ALL SELECT 'g' || k || '.item', 'added', NULL FROM s JOIN g ON b = k % 6 WHERE moved AND NOT (losses = 1 AND gains = 1)"
    " UNION ALL SELECT 'sale.order', 'removed', NULL FROM s HAVING count(*) FILTER (k % 7 = 0) > 0"
    " UNION ALL SELECT 'sale.line', 'added', NULL FROM s HAVING count(*) FILTER (moved) > 0"
)
def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a version of the framework lost, gained and renamed against the one before."""
    folder = written_versions(spark, sf_dir)
    return symbols.changes(*(symbols.part_of(spark, folder, v, "models") for v in ("16.0", "17.0")))


@query(
    "SELECT 'h' || s_suppkey AS module, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 'gone' ELSE 'never' END AS told FROM supplier"
    " WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 3 = 2"
)
def removed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that inherit what a version still has, has lost, or what none ever had: the rule tells the last two apart."""
    k = F.col("s_suppkey")
    stubs = resolve.stubs_for(spark, written_versions(spark, sf_dir), "17.0")
    named = F.when((k % 3 == 2) & (k % 5 != 0) & (k % 7 != 0), F.concat(F.lit("never"), k.cast("string"))).otherwise(F.concat(F.lit("g"), k.cast("string"), F.lit(".thing")))
    source = F.concat(F.lit("class B(models.Model):\n    _inherit = '"), named, F.lit("'\n")).cast("binary")
    manifest = F.lit("{'name': 'H', 'version': '17.0.1.0', 'license': 'L'}\n").cast("binary")
    entry = lambda rel, kind, content: F.struct(F.lit(rel).alias("rel"), F.lit(kind).alias("kind"), content.alias("content"))
    name = F.concat(F.lit("h"), k.cast("string"))
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(
        name.alias("module"), F.concat(F.lit("/gen/"), name).alias("module_dir"), k.cast("int").alias("module_ord"),
        F.inline(F.array(entry("__manifest__.py", "manifest", manifest), entry("models/m.py", "python", source))),
    )
    project = Project(Facts(rows.withColumn("path", F.concat_ws("/", "module_dir", "rel"))).settle(), "17.0", stubs)
    found = findings_of(REGISTRY["removed-model-still-referenced"], project)
    return found.select("module", F.when(F.col("message").contains("Version 16.0 had it."), "gone").otherwise("never").alias("told"))


CALL_RULES = ", ".join(f"'{r.name}'" for r in REGISTRY.values() if r.when)


@query(
    f"WITH {generated._expected()}, told AS (SELECT module, regexp_replace(file_path, '^/gen/', '') AS path, rule, line FROM found WHERE rule IN ({CALL_RULES})"
    # comments that suppress are the scan's business
    " UNION ALL SELECT 'g' || s_suppkey, 'g' || s_suppkey || '/models/m.py', 'missing-translation', 7 FROM supplier WHERE s_suppkey % 6 = 5)"
    f" SELECT path, rule, line, 1::BIGINT AS found, ({OF} % 11 != 0 AND {OF} % 13 = 0)::BIGINT AS fixed FROM told WHERE {OF} % 11 != 0 OR {OF} % 13 != 0"
)
def branch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch followed over two commits: how often each finding of single calls came and went."""
    repo, place = os.path.join(open_folder(spark, "commits"), "modules.git"), open_folder(spark, "stream")
    for files in (generated.earlier_files(spark, sf_dir), generated.later_files(spark, sf_dir)):
        commits.write_commit(files, repo, "main")
        told = trees.findings_stream(trees.branch_changes(spark, repo, "main")).writeStream.format("parquet")
        q = told.option("path", f"{place}/told").option("checkpointLocation", f"{place}/held").start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(f"{place}/told").select(F.expr(f"substring(path, {len(repo) + 2})").alias("path"), "rule", "line", "change")
    return rows.groupBy("path", "rule", "line").agg(F.count_if(F.col("change") == "found").alias("found"), F.count_if(F.col("change") == "fixed").alias("fixed"))


def _said(command: list[str], seconds: int) -> tuple[str, str, str, int]:
    """A linter that answers by the module's number: findings, no executable, too slow, no JSON, no plugin, a bad end."""
    k = int(command[-1].rpartition("g")[2])
    found = '[{"code": "S608", "message": "m", "filename": "a.py", "location": {"row": 3, "column": 1}}, {"code": "Z9", "message": null}]'
    return (
        ("ok", found, "", 1), ("missing", "", "", 0), ("timeout", "", "", 0), ("ok", "Traceback: {", "", 0),
        ("ok", "", "No module named extra", 1), ("ok", "[]", "", 2),
    )[k % 6]


@query(
    "SELECT 'g' || s_suppkey AS module, rule, category, tier, confidence, severity, line, about FROM supplier JOIN (VALUES"
    " (0, 'S608', 'Security', 'P1', 'high', 'error', 3, 'm'), (0, 'Z9', 'Uncategorized', 'P3', 'low', 'warning', 0, ''),"
    " (1, 'ruff-unavailable', 'Uncategorized', 'P3', 'low', 'warning', 0, 'not found'), (2, 'ruff-unavailable', 'Uncategorized', 'P3', 'low', 'warning', 0, 'did not finish'),"
    " (3, 'ruff-unavailable', 'Uncategorized', 'P3', 'low', 'warning', 0, 'no JSON list'), (4, 'ruff-unavailable', 'Uncategorized', 'P3', 'low', 'warning', 0, 'not installed'),"
    " (5, 'ruff-unavailable', 'Uncategorized', 'P3', 'low', 'warning', 0, 'status 2')) v(m, rule, category, tier, confidence, severity, line, about) ON s_suppkey % 6 = m"
)
def linter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter of a linter with its own mapping, and a warning for each way in which it may fail."""
    from dataclasses import replace

    name = F.concat(F.lit("g"), F.col("s_suppkey").cast("string"))
    modules = table(spark, sf_dir, "supplier").select(name.alias("module"), F.concat(F.lit("/gen/"), name).alias("module_dir"))
    found = L.lint(modules, replace(L.RUFF, missing_plugin="No module named extra"), "17.0", run=_said)
    about = F.regexp_extract("message", "not found|did not finish|no JSON list|not installed|status 2|^m$", 0)
    return found.select("module", "rule", "category", "tier", "confidence", "severity", "line", about.alias("about"))


def _said_in_lines(command: list[str], seconds: int) -> tuple[str, str, str, int]:
    """A linter with a line for each finding, by the module's number: two findings and noise, none, no plugin."""
    folder, k = command[-1], int(command[-1].rpartition("g")[2])
    lines = f"************* Module g{k}\n{folder}/m.py:{k + 1}:4: E8103: SQL injection (sql-injection)\nnoise: 1\n  {folder}/m.py:9:0: C0103: Bad name (invalid-name)\n"
    return (("ok", lines, "", 4), ("ok", "", "", 0), ("ok", "", "ImportError: No module named pylint_odoo", 1))[k % 3]


@query(
    "SELECT 'g' || s_suppkey AS module, path, rule, category, tier, confidence, severity, line::INT AS line, col::INT AS col, about FROM (SELECT s_suppkey, '/gen/g' || s_suppkey AS d FROM supplier),"
    " LATERAL (VALUES (0, d || '/m.py', 'E8103', 'Security', 'P0', 'high', 'error', s_suppkey + 1, 4, 'SQL injection'), (0, d || '/m.py', 'C0103', 'Uncategorized', 'P3', 'low', 'warning', 9, 0, 'Bad name'),"
    " (2, d, 'pylint-odoo-unavailable', 'Uncategorized', 'P3', 'low', 'warning', 0, 0, 'not installed')) v(m, path, rule, category, tier, confidence, severity, line, col, about) WHERE s_suppkey % 3 = m"
)
def linter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter of the linter that answers in lines of text."""
    name = F.concat(F.lit("g"), F.col("s_suppkey").cast("string"))
    modules = table(spark, sf_dir, "supplier").select(name.alias("module"), F.concat(F.lit("/gen/"), name).alias("module_dir"))
    found = L.lint(modules, L.PYLINT, "17.0", run=_said_in_lines)
    about = F.coalesce(F.nullif(F.regexp_extract("message", "not installed", 0), F.lit("")), F.col("message"))
    return found.select("module", F.col("file_path").alias("path"), "rule", "category", "tier", "confidence", "severity", "line", F.col("column").alias("col"), about.alias("about"))


@query(
    "SELECT '/gen/g' || s_suppkey || '/' || rel AS path, 'the file could not be opened' AS reason FROM supplier"
    " JOIN (VALUES (1, 'models/m.py'), (2, 'views/v.xml'), (3, 'security/ir.model.access.csv')) v(m, rel) ON s_suppkey % 5 = m"
)
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be opened are named; bytes that are no UTF-8 are no fault."""
    k, rel = F.col("module_ord") % 5, F.col("rel")
    lost = (k == 1) & (rel == "models/m.py") | (k == 2) & (rel == "views/v.xml") | (k == 3) & rel.endswith(".csv")
    odd = F.concat(F.col("content"), F.unhex(F.lit("23FFFE0A")))
    changed = F.when(lost, F.lit(None).cast("binary")).when((k == 4) & (F.col("kind") != "xml"), odd).otherwise(F.col("content"))
    return Facts(generated.files(spark, sf_dir).withColumn("content", changed)).unreadable.select("path", "reason")


@query(
    f"WITH {generated._expected()}, {generated.CATEGORY_SQL}, s AS (SELECT m.module, c.category, c.ord, coalesce(n, 0) AS n, greatest(0, trunc(100 - round(coalesce(points, 0) * weight, 6)))::INT AS score"
    " FROM (SELECT 'g' || s_suppkey AS module FROM supplier) m CROSS JOIN (SELECT *, row_number() OVER () AS ord FROM cats) c LEFT JOIN (SELECT module, category, count(*) AS n,"
    f" sum(CASE tier {' '.join(f"WHEN '{t}' THEN {p}" for t, p in P.TIERS.items())} END) AS points FROM found WHERE eligible GROUP BY ALL) f ON f.module = m.module AND f.category = c.category)"
    " SELECT module, coalesce(string_agg(category || ' ' || score || ' (' || n || ')', ', ' ORDER BY ord) FILTER (score < 100), '') AS lost,"
    " (SELECT count(*) FROM found f WHERE f.module = s.module)::BIGINT AS findings FROM s GROUP BY module"
)
def terminal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of modules in the terminal's report, read back from the file that executors wrote."""
    path = os.path.join(open_folder(spark, "report"), "terminal.txt")
    reports.write_terminal(result_of(spark, sf_dir), path)
    blocks = spark.read.option("lineSep", "== ").text(path).filter("value RLIKE '^g[0-9]+: '")
    lines = F.split("value", "\n")
    findings = F.size(F.filter(lines, lambda x: x.startswith("      -> "))).cast("long")
    shown = blocks.select(F.substring_index("value", ":", 1).alias("module"), F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^   [A-Z][A-Za-z ]+ \d+ \(")), F.lit(1)).alias("l"), findings.alias("findings"))
    return shown.select("module", F.coalesce(F.trim("l"), F.lit("")).alias("lost"), "findings")


@query(
    "SELECT '/gen/g' || s_suppkey || '/__manifest__.py' AS path, (s_suppkey % 4 = 0) AS license_added, (s_suppkey % 3 = 0) AS files_moved, true AS one_line FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 = 0"
)
def fix_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixers would change, as one file of diffs that executors wrote."""
    facts, found = generated.scanned(spark, sf_dir)
    path = os.path.join(open_folder(spark, "diffs"), "fixes.diff")
    fixes.write_diffs(fixes.compute_fixes(found, facts.files), path)
    blocks = spark.read.option("lineSep", "--- a/").text(path).filter("value != ''")
    line = lambda mark: F.array_join(F.filter(F.split("value", "\n"), lambda x: x.startswith(mark) & ~x.startswith("+++")), "\n")
    held = blocks.select(F.substring_index("value", "\n", 1).alias("path"), line("+").alias("new"), line("-").alias("old"))
    return held.select("path", F.col("new").contains("'license': 'LGPL-3'").alias("license_added"), (F.instr("old", "security/") > F.instr("old", "views/")).alias("files_moved"), (F.col("old").contains("\n") == F.lit(False)).alias("one_line"))


@query(f"SELECT count(*)::BIGINT AS rules, {len(REGISTRY)}::BIGINT AS registered, 2::BIGINT AS fixable FROM range({len(REGISTRY)})")
def rule_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates' table has a row per rule."""
    rows = scan.gates(spark)
    return rows.agg(F.count("*").alias("rules")).select(
        "rules", F.lit(len(REGISTRY)).cast("long").alias("registered"), F.lit(sum(r.fixable for r in REGISTRY.values())).cast("long").alias("fixable")
    )


@query("SELECT true AS same, true AS told_apart")
def tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal trees and settings have one fingerprint, whatever the order of files; a changed file or setting has another."""
    files = durable(generated.files(spark, sf_dir))
    first = cache.fingerprint(files, "17.0", {"a", "b"})
    same = first == cache.fingerprint(files.repartition(7), "17.0", {"b", "a"})
    edited = files.withColumn("content", F.when(F.col("path") == "/gen/g1/models/m.py", F.lit("x = 1").cast("binary")).otherwise(F.col("content")))
    others = {cache.fingerprint(edited, "17.0", {"a", "b"}), cache.fingerprint(files, "16.0", {"a", "b"})}
    return spark.createDataFrame([(same, first not in others and len(others) == 2)], "same boolean, told_apart boolean")
