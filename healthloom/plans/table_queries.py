"""The operators over the bundled tables, each with a DuckDB twin.

The tables hold no source trees, so most queries run an operator on a view that
has its input's shape (``events`` as findings, ``orders`` as references, and so
on): the functions are those that a scan calls, only the input differs.  The one
exception is ``markup_refs``, which is plain SQL functions.  ``scan_*`` go all
the way: ``generated.py`` writes a small module per supplier and the whole engine
scans them; ``engine_queries.py`` has more of that kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import baseline, resolve, scoring
from ..operators import checks as K
from ..operators import findings as P
from ..streaming.health import windowed_impact
from . import generated, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events as findings ----------------------------------------------------------------------

KINDS = {"error": "Security", "click": "Correctness", "view": "Performance", "signup": "Module Hygiene", "purchase": "Other"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = lambda names: F.element_at(F.lit(names), (F.col("event_id") % len(names) + 1).cast("int"))
    category = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    v = F.col("value")
    return e.select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("module"),
        F.concat(F.lit("/src/m"), F.col("user_id").cast("string"), F.lit("/./"), "event_type", F.lit(".py")).alias("file_path"),
        F.get_json_object("props", "$.k").cast("int").alias("line"),
        F.lit(0).alias("column"),
        F.col("event_type").alias("rule"),
        F.element_at(category, F.col("event_type")).alias("category"),
        by(["error", "warning", "info"]).alias("severity"),
        F.when(v < 10, "P0").when(v < 50, "P1").when(v < 100, "P2").otherwise("P3").alias("tier"),
        by(["native", "pylint-x", "ruff", "native"]).alias("source"),
        by(["high", "medium", "high", "low", "high"]).alias("confidence"),
        F.concat(F.lit("t:"), "event_type").alias("title"),
        F.concat(F.lit("50%, "), F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int"))).alias("message"),
        F.lit("").alias("help"),
        F.lit("17.0").alias("odoo_version"),
        F.lit(None).cast("string").alias("url"),
        F.col("event_id").alias("seq"),
        "ts",
    )


_PICK = "[{0}][(event_id % {1} + 1)::INT]"
RAW = f"""raw AS (
  SELECT 'm' || user_id AS module, '/src/m' || user_id || '/./' || event_type || '.py' AS raw_path,
    '/src/m' || user_id || '/' || event_type || '.py' AS file_path,
    regexp_extract(props, '[0-9]+')::INT AS line, event_type AS rule,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS category,
    {_PICK.format("'error', 'warning', 'info'", 3)} AS severity,
    CASE WHEN value < 10 THEN 'P0' WHEN value < 50 THEN 'P1' WHEN value < 100 THEN 'P2' ELSE 'P3' END AS tier,
    {_PICK.format("'native', 'pylint-x', 'ruff', 'native'", 4)} AS source,
    {_PICK.format("'high', 'medium', 'high', 'low', 'high'", 5)} AS confidence,
    't:' || event_type AS title, '50%, ' || repeat('x', (event_id % 7)::INT) AS message, event_id AS seq, ts
  FROM events)"""
DEDUP = """dedup AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY module, file_path, line, category, rule ORDER BY
    CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE source WHEN 'native' THEN 2 ELSE 1 END DESC,
    length(message) DESC, seq) = 1)"""
CATS = "cats AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {k}, {w}::DOUBLE)" for k, (c, w) in enumerate(P.CATEGORIES.items())) + ") c(category, ord, weight))"
POINTS = "CASE tier WHEN 'P0' THEN 25 WHEN 'P1' THEN 10 WHEN 'P2' THEN 4 ELSE 1 END"


def score_sql(source: str, name: str = "scores", blends: str = "blends") -> str:
    """CTEs that score the rows of ``source``."""
    return f"""{name} AS (
  SELECT m.module, c.category, c.ord, coalesce(s.points, 0) * c.weight AS total_impact, coalesce(s.n, 0) AS finding_count,
    greatest(0, trunc(100 - round(coalesce(s.points, 0) * c.weight, 6)))::INT AS score
  FROM (SELECT DISTINCT module FROM raw) m CROSS JOIN cats c LEFT JOIN (
    SELECT module, category, sum({POINTS}) AS points, count(*) AS n FROM {source} WHERE confidence = 'high' GROUP BY ALL
  ) s ON s.module = m.module AND s.category = c.category
), {blends} AS (
  SELECT module, count(*)::BIGINT AS n, min(score) AS least, sum(score)::BIGINT AS total, sum(finding_count)::BIGINT AS counted,
    (4 * min(score) * count(*) + 6 * sum(score))::BIGINT AS blend FROM {name} GROUP BY module)"""


def scored(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = P.mark_eligible(rows)
    cats = scoring.category_scores(held, rows, scoring.category_table(spark))
    return cats, scoring.module_scores(cats)


@query(f"WITH {RAW}, {DEDUP}, {CATS}, {score_sql('dedup')} SELECT module, n, least, total, counted, blend FROM blends")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, dedup, score: ten times n times a module's overall score, exactly."""
    rows = P.deduplicate(P.normalise(findings(spark, sf_dir)))
    return scored(spark, rows)[1].select("module", "n", "least", "total", "counted", "blend")


@query(f"WITH {RAW}, {CATS}, {score_sql('raw')} SELECT module, category, score, finding_count, round(total_impact, 6) AS total_impact FROM scores")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, findings(spark, sf_dir))[0].select("module", "category", "score", "finding_count", "total_impact")


@query(
    f"WITH {RAW}, {CATS}, {score_sql('raw')} SELECT count(*) AS module_count, sum(blend)::BIGINT AS blend, min(least) AS least,"
    " count(*) FILTER (blend < 750 * n) AS below_75 FROM blends"
)
def project_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, findings(spark, sf_dir))[1]
    low = scoring.below(m.withColumn("overall", F.col("blend") / (10 * F.col("n"))), 75).select("module").withColumn("low", F.lit(1))
    return m.join(low, "module", "left").agg(
        F.count("*").alias("module_count"), F.sum("blend").alias("blend"), F.min("least").alias("least"), F.count("low").alias("below_75")
    )


@query(
    f"WITH {RAW}, a AS (SELECT * FROM raw WHERE ts < TIMESTAMP '2024-01-08'), b AS (SELECT * FROM raw WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'),"
    f" {CATS}, {score_sql('a', 'sa', 'ba')}, {score_sql('b', 'sb', 'bb')}"
    " SELECT round((SELECT avg(blend / 80.0::DOUBLE) FROM bb), 6) AS head, round((SELECT avg(blend / 80.0::DOUBLE) FROM ba), 6) AS base,"
    " round((SELECT avg(blend / 80.0::DOUBLE) FROM bb) - (SELECT avg(blend / 80.0::DOUBLE) FROM ba), 6) AS delta"
)
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week two against week one, both scored over all modules."""
    rows = findings(spark, sf_dir)
    cats = scoring.category_table(spark)

    def of(condition: str) -> DataFrame:
        part = P.mark_eligible(rows.filter(condition))
        return scoring.module_scores(scoring.category_scores(part, rows, cats)).withColumn("overall", F.col("blend") / (10.0 * F.col("n")))

    head = of("ts >= timestamp_ntz'2024-01-08 00:00:00' AND ts < timestamp_ntz'2024-01-15 00:00:00'")
    out = scoring.score_delta(head, of("ts < timestamp_ntz'2024-01-08 00:00:00'"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("head", "base", "delta")])


SHOWN = ["module", "file_path", "line", "rule", "category", "severity", "tier", "source", "confidence", "seq"]
SHOWN_SQL = ", ".join(SHOWN)


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.normalise(findings(spark, sf_dir))


@query(f"WITH {RAW}, {DEDUP} SELECT {SHOWN_SQL} FROM dedup")
def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deduplicate(normal(spark, sf_dir)).select(*SHOWN)


@query(f"WITH {RAW} SELECT {SHOWN_SQL} FROM raw")
def normalise_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select(*SHOWN)


@query(
    f"WITH {RAW} SELECT {SHOWN_SQL.replace('severity', "CASE rule WHEN 'click' THEN 'info' ELSE severity END AS severity")} FROM raw WHERE rule != 'view'"
)
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.override_severity(normal(spark, sf_dir), {"click": "info", "view": "off"}).select(*SHOWN)


@query(f"WITH {RAW} SELECT {SHOWN_SQL} FROM raw WHERE rule != 'signup' AND module NOT IN ('m1', 'm2') AND NOT regexp_matches(file_path, '^/src/m[13][0-9]/error\\.py$')")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ignore(normal(spark, sf_dir), ["signup"], ["m1", "m2"], ["**/m[13]?/error.*"], "/src").select(*SHOWN)


@query(f"WITH {RAW} SELECT {SHOWN_SQL} FROM raw WHERE confidence IN ('high', 'medium') AND category IN ('Security', 'Performance')")
def surface_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.for_surface(normal(spark, sf_dir), P.Surface("medium", ("Security", "Performance"))).select(*SHOWN)


@query(
    f"WITH {RAW}, s AS (SELECT DISTINCT file_path, CASE WHEN seq % 46 = 0 THEN 0 ELSE line END AS line, rule FROM raw WHERE seq % 23 = 0)"
    f" SELECT {SHOWN_SQL} FROM raw r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file_path = r.file_path AND s.rule = r.rule AND (s.line = r.line OR s.line = 0))"
)
def suppression_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    marks = rows.filter("seq % 23 = 0").select(F.col("file_path").alias("path"), F.expr("IF(seq % 46 = 0, 0, line)").alias("line"), "rule")
    return P.suppress(P.normalise(rows), marks).select(*SHOWN)


@query(
    f"WITH {RAW}, i AS (SELECT *, sha256(concat_ws(chr(0), rule, module, file_path, 'line ' || line)) AS identity FROM raw)"
    f" SELECT {SHOWN_SQL}, identity FROM i WHERE identity NOT IN (SELECT identity FROM i WHERE ts < TIMESTAMP '2024-01-05')"
)
def baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    lines = rows.select(F.col("file_path").alias("path"), "line", F.concat(F.lit("  line \t"), F.col("line").cast("string"), F.lit(" ")).alias("text"))
    told = baseline.with_identity(rows, lines.distinct())
    known = baseline.identities(told.filter("ts < timestamp_ntz'2024-01-05 00:00:00'"))
    return baseline.filter_known(told, known).select(*SHOWN, "identity")


@query(f"WITH {RAW} SELECT {SHOWN_SQL} FROM raw WHERE rule NOT IN ('click', 'purchase', 'signup')")
def version_and_capability_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = P.Gates([("error", "16.0", ["version:17"], []), ("click", "18.0", [], []), ("purchase", None, ["web"], []), ("signup", None, [], ["crm"])])
    caps = P.capabilities("17.0", ["crm"], "version")
    return P.gate(normal(spark, sf_dir), gates.frame(spark), "17.0", caps).select(*SHOWN)


@query(f"WITH {RAW} SELECT {SHOWN_SQL}, confidence = 'high' AND category != 'Other' AS eligible FROM raw")
def score_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mark_eligible(normal(spark, sf_dir)).select(*SHOWN, "eligible")


@query(f"WITH {RAW} SELECT {SHOWN_SQL} FROM raw ORDER BY tier, file_path, line, seq LIMIT 5")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top(normal(spark, sf_dir), 5).select(*SHOWN)


@query(
    f"WITH {RAW}, c AS (SELECT DISTINCT file_path, module FROM raw WHERE seq % 97 = 0)"
    f" SELECT {SHOWN_SQL} FROM raw WHERE file_path IN (SELECT file_path FROM c) OR rule IN ('error', 'view') AND module IN (SELECT module FROM c)"
)
def changed_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    dirs = rows.select("module", F.concat(F.lit("/src/"), "module").alias("module_dir")).distinct()
    changed = rows.filter("seq % 97 = 0").select(F.col("file_path").alias("path"))
    return P.changed_only(rows, changed, dirs, ["error", "view"]).select(*SHOWN)


@query(
    f"WITH {RAW} SELECT seq, format('::{{}} file={{}},line={{}},col=0,title={{}}::{{}}', CASE WHEN severity = 'info' THEN 'notice' ELSE severity END,"
    " substr(file_path, 6), line, replace(title, ':', '%3A'), replace(message, '%', '%25')) AS value FROM raw"
)
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    lines = reports.annotations(rows.withColumn("message", F.concat("message", F.lit("@"), F.col("seq").cast("string"))), "/src")
    # the sequence number rides on the message, to tell equal lines apart
    return lines.select(F.regexp_extract("value", "@(\\d+)$", 1).cast("long").alias("seq"), F.regexp_replace("value", "@\\d+$", "").alias("value"))


@query(
    f"WITH {RAW} SELECT rule, min(seq) AS seq, 't:' || rule AS title, arg_min(category, seq) AS category, arg_min(tier, seq) AS tier,"
    " CASE arg_min(severity, seq) WHEN 'info' THEN 'note' ELSE arg_min(severity, seq) END AS level FROM raw GROUP BY rule"
)
def rule_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.sarif_rules(normal(spark, sf_dir))
    get = lambda path: F.get_json_object("body", path)
    return d.select(
        "rule", "seq", get("$.fullDescription.text").alias("title"), get("$.properties.category").alias("category"),
        get("$.properties.tier").alias("tier"), get("$.defaultConfiguration.level").alias("level"),
    )


@query(f"WITH {RAW} SELECT module, count(*) AS n, bool_or(severity = 'error') AS has_error FROM raw GROUP BY module HAVING bool_or(severity IN ('error', 'warning'))")
def severity_at_or_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir)
    counts = rows.groupBy("module").agg(F.count("*").alias("n"))
    errors = P.severe(rows, "error").select("module").distinct().withColumn("has_error", F.lit(True))
    told = counts.join(P.severe(rows, "warning"), "module", "left_semi").join(errors, "module", "left")
    return told.select("module", "n", F.coalesce("has_error", F.lit(False)).alias("has_error"))


@query(
    f"WITH {RAW} SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", module, category,"
    f" sum({POINTS})::BIGINT AS points, count(*) AS n FROM raw WHERE confidence = 'high' AND category != 'Other' GROUP BY ALL"
)
def windowed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on a table."""
    return windowed_impact(P.mark_eligible(normal(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))).withColumns(
        {"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")}
    )


@query(
    f"WITH {RAW} SELECT seq, coalesce(m.c, 'Uncategorized') AS category, coalesce(m.t, 'P3') AS tier, coalesce(m.f, 'low') AS confidence"
    " FROM raw LEFT JOIN (VALUES ('error', 'Security', 'P1', 'high'), ('click', 'Maintainability', 'P3', 'medium')) m(r, c, t, f) ON rule = m.r"
)
def linter_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a linter in JSON, parsed and mapped as in a scan."""
    from ..sources import linters as L

    linter = L.Linter("demo", ("demo",), "json", 1, (("error", ("Security", "P1", "high")), ("click", ("Maintainability", "P3", "medium"))))
    e = findings(spark, sf_dir)
    one = F.struct(F.col("rule").alias("code"), F.col("seq").cast("string").alias("message"), F.col("file_path").alias("filename"), F.struct(F.col("line").alias("row"), F.lit(1).alias("column")).alias("location"))
    raw = e.select("module", F.lit("/").alias("module_dir"), F.to_json(F.array(one)).alias("stdout"))
    return L.mapped_codes(L.parsed(raw, linter), linter).select(F.col("message").cast("long").alias("seq"), "category", "tier", "confidence")


# --- other tables ----------------------------------------------------------------------------


@query(
    "SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL AND o_custkey % 3 != 0 THEN 'repo' WHEN s_suppkey IS NOT NULL THEN 'stub' WHEN n_nationkey IS NOT NULL THEN 'source_path' END AS source,"
    " CASE WHEN c.c_custkey IS NOT NULL AND o_custkey % 3 != 0 OR s_suppkey IS NOT NULL OR n_nationkey IS NOT NULL THEN 'found' ELSE 'unknown' END AS status"
    " FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey"
)
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with a priority: customers but every third, suppliers, nations, then unknown."""
    layer = lambda name, key, kind: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("o_custkey"), F.lit(kind).alias("source"))
    layers = [layer("customer", "c_custkey", "repo").filter("o_custkey % 3 != 0"), layer("supplier", "s_suppkey", "stub"), layer("nation", "n_nationkey", "source_path")]
    out = resolve.prioritised(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), layers, ["o_custkey"])
    status = F.when(F.col("source").isNotNull(), resolve.FOUND).otherwise(resolve.UNKNOWN)
    return out.select("o_orderkey", "source", status.alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    return K.absent(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, ["l_partkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of the first priority."""
    used = table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return K.absent(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), used, ["c_custkey"])


@query(
    "WITH d AS (SELECT doc_id, source, lower(trim(text)) AS k FROM documents)"
    " SELECT doc_id, source, first_value(doc_id) OVER w AS first_doc_id FROM d WINDOW w AS (PARTITION BY k ORDER BY doc_id) QUALIFY row_number() OVER w > 1"
)
def later_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower(F.trim("text")), 256).alias("k"))
    return P.later_definitions(d, ["k"], ["doc_id"], ["doc_id"]).select("doc_id", "source", "first_doc_id")


@query(
    "WITH f AS (SELECT l_orderkey, min(l_linenumber) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"
    " SELECT l_orderkey, l_linenumber, p AS first_line FROM lineitem JOIN f USING (l_orderkey) WHERE l_returnflag = 'A' AND l_linenumber > p"
)
def late_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one kind that come after the first of another kind in their group."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    late = K.after_first(rows, "l_orderkey", "l_linenumber", "l_returnflag = 'R'", "l_returnflag = 'A'")
    return late.select("l_orderkey", "l_linenumber", F.col("first_l_linenumber").alias("first_line"))


@query(
    "WITH e AS (SELECT o_custkey % 50 AS module, s_nationkey AS owner, 'p' || l_suppkey AS evidence, min(l_orderkey * 10 + l_linenumber) AS pos"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey > 3 AND (o_custkey % 50) % 25 != s_nationkey GROUP BY ALL)"
    " SELECT module, owner, string_agg(evidence, ', ' ORDER BY pos, evidence) AS evidence FROM e GROUP BY ALL"
)
def ordered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence per owner in order of appearance, without what is always there or declared."""
    l, o, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    rows = l.select("l_orderkey", "l_suppkey", "l_linenumber").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(s.select("s_suppkey", F.col("s_nationkey").alias("owner")), F.col("l_suppkey") == F.col("s_suppkey")).filter("owner > 3")
    told = {"module": F.col("o_custkey") % 50, "evidence": F.concat(F.lit("p"), F.col("l_suppkey").cast("string")), "at": F.col("l_orderkey") * 10 + F.col("l_linenumber")}
    return K.listed_evidence(rows.withColumns(told).filter("module % 25 != owner"), ["module", "owner"], "evidence", "at")


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
    " SELECT doc_id, line, p.name AS what FROM l JOIN (VALUES ('license', '[Ll]icen[cs]e'), ('secret', 'AKIA|password|token'), ('shout', '!!'), ('table', ' \\| ')) p(name, pattern)"
    " ON regexp_matches(t, p.pattern)"
)
def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines times patterns, in one pass over each text."""
    patterns = {"license": "[Ll]icen[cs]e", "secret": "AKIA|password|token", "shout": "!!", "table": r" \| "}
    hits = lambda t: K.pattern_hits(t, [(p, F.lit(n)) for n, p in patterns.items()])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "t"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(hits(F.col("t"))).alias("what"))


@query(
    "WITH n AS (SELECT p_partkey, string_split('model_' || replace(p_name, ' ', '_') || '_' || lower(p_type), '_')[2:] AS parts FROM part), m AS ("
    " SELECT p_partkey, parts, unnest(range((1 << (len(parts) - 1))::BIGINT)) AS mask FROM n)"
    " SELECT p_partkey, mask::INT AS mask, parts[1] || array_to_string(list_transform(range(2, len(parts) + 1), lambda i: CASE WHEN (mask >> (i - 2)) & 1 = 1 THEN '_' ELSE '.' END || parts[i]), '') AS name FROM m"
)
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = F.concat(F.lit("model_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.candidate_models(external)).alias("mask", "name"))


@query(
    "WITH RECURSIVE edges AS (SELECT n_nationkey AS model, n_nationkey // 2 AS parent FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey % 5 = 4"
    " UNION ALL SELECT n_nationkey, 100 + n_regionkey FROM nation WHERE n_nationkey % 7 = 6), walk AS ("
    " SELECT n_nationkey AS root, n_nationkey AS node, [n_nationkey] AS path FROM nation UNION ALL"
    " SELECT root, parent, list_append(path, parent) FROM walk JOIN edges ON node = model WHERE parent != model)"
    " SELECT root AS model, count(*) = count(DISTINCT node) AND bool_and(node < 100 OR node % 2 = 0) AS complete FROM walk GROUP BY root"
    " UNION ALL SELECT 100 + r_regionkey, r_regionkey % 2 = 0 FROM region"
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive closure with a diamond test, on edges made from nations and regions."""
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey"))
    part = lambda cond, parent: n.filter(cond).select(F.col("k").alias("model"), F.expr(parent).cast("int").alias("parent"))
    edges = part("k >= 0", "IF(k > 0, k div 2, NULL)").unionByName(part("k % 5 = 4", "k div 3")).unionByName(part("k % 7 = 6", "100 + n_regionkey"))
    leaves = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("int").alias("model"), (F.col("r_regionkey") % 2 == 0).alias("complete"))
    return resolve.complete_models(edges, leaves)


@query(
    "SELECT c_nationkey AS module, c_mktsegment AS name, max(c_custkey) AS last_key, arg_max(c_acctbal, c_custkey) AS balance FROM customer GROUP BY ALL"
)
def merged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members merged over files: the last definition wins."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("module"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("last_key"), F.col("c_acctbal").alias("balance")
    )
    return K.last_of(c, ["module", "name"], ["last_key", "balance"], ["last_key"])


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) ELSE 'unknown' END AS version FROM orders GROUP BY 1")
def only_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(K.only_value("o_orderstatus").alias("version"))


@query(
    "SELECT page_id, len(regexp_extract_all(html, '<a href=\"')) AS n_links, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS n_targets,"
    " array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))), ' ') AS targets FROM pages"
)
def markup_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in markup, by pattern; the engine's own markup parser reads XML, which these pages are not."""
    refs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    d = F.array_distinct(refs)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(refs).cast("long").alias("n_links"), F.size(d).cast("long").alias("n_targets"), F.array_join(F.array_sort(d), " ").alias("targets")
    )


@query("SELECT s_suppkey, k AS name FROM supplier CROSS JOIN (VALUES ('name'), ('version'), ('depends')) v(k) WHERE (s_suppkey + length(k)) % 3 = 0")
def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not filled: a set difference per row."""
    keys = ["name", "version", "depends"]
    filled = F.filter(F.lit(keys), lambda k: (F.col("s_suppkey") + F.char_length(k)) % 3 != 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(K.unfilled(filled, keys)).alias("name"))


# --- whole scans over generated modules ------------------------------------------------------


@query(generated.FINDINGS_SQL)
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.scan_findings(spark, sf_dir)


@query(generated.SCORES_SQL)
def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.scan_scores(spark, sf_dir)


@query(generated.FACTS_SQL)
def parsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.parsed_facts(spark, sf_dir)
