"""Small modules written from the ``supplier`` table, scanned by the whole engine, and what SQL expects of them.

Supplier k is module ``g<k>``.  Its files vary by k modulo small numbers; each
variant is listed below with the findings it must give, so the twin needs only
arithmetic on keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as P
from ..operators import scoring
from ..session import spread
from ..sources.parsed import Facts
from .rules import REGISTRY, Project
from .scan import active_rules, rule_findings

HEAD = """\
from x import models, fields, api
class A(models.Model):
    _name = 'g{k}.thing'
    name = fields.Char(string='N', required=True)
    partner_id = fields.Many2one('res.partner', ondelete='cascade')
"""
#: By k % 6: lines 6 and on of models/m.py, and the findings in them (rule, line).
PYTHON = [
    (
        """\
    other_id = fields.Many2one('x.y')
    code = fields.Char(required=True)
""",
        [("missing-ondelete", 6), ("field-no-string-on-required", 7)],
    ),
    (
        """\
    def run(self):
        for r in self:
            r.search([])
            self.env['a'].create({})
            r.partner_id.country_id.name
            r.write({})
""",
        [("search-in-loop", 8), ("create-in-loop", 9), ("n-plus-one-read", 10), ("write-in-loop", 11)],
    ),
    (
        """\
    def write(self, vals):
        self.env.cr.execute("SELECT %s" % vals)
        raise UserError('bad')
""",
        [("override-missing-super", 6), ("raw-sql-string-interpolation", 7), ("missing-translation", 8)],
    ),
    (
        """\
    @api.depends('name')
    def _compute_x(self):
        self.env['g'].search([])
        self.x = self.partner_id
""",
        [("compute-missing-depends", 7), ("unbounded-search", 8)],
    ),
    (
        """\
    def go(self):
        eval(self.code)
        self.sudo()
        self.pool.get('x')
""",
        [("eval-usage", 7), ("sudo-without-comment", 8), ("deprecated-api-usage", 9)],
    ),
    (
        """\
    # x-doctor: disable=missing-translation
    def go(self): raise UserError('t')
class C(http.Controller):
    @http.route('/x', auth='public')
    def page(self):
        return request.env['a'].sudo()  # meant
""",
        [("public-controller-sudo-risk", 10)],
    ),
]
#: With k % 7 = 0 an extension of a model of another module follows.
EXTENSION = "class B(models.Model):\n    _inherit = 'sale.order'\n"

VIEW = """\
<root>
<record id="v1" model="ir.ui.view">
<field name="model">g{k}.thing</field>
<field name="arch" type="xml"><form>{arch}</form></field>
</record>
{more}
</root>
"""
PLAIN = '<field name="name"/>'
#: By k % 4: what the view shows, line 6, and the findings.
XML = [
    (
        '<field name="name"/><field name="nope"/><button name="miss" type="object"/>',
        '<record id="a1" model="ir.actions.act_window"><field name="view_id" ref="v1"/></record>',
        [("view-field-not-in-model", 4), ("button-method-not-found", 4)],
    ),
    (
        PLAIN,
        '<!-- x-doctor: disable=data-noupdate-risk -->\n<record id="v1" model="ir.cron"/>',
        [("duplicate-xml-id", 7), ("orphan-view", 2)],
    ),
    (
        PLAIN,
        '<record id="a1" model="x"><field name="view_id" ref="v1"/><field name="q" ref="gone"/></record>',
        [("missing-xml-ref", 6)],
    ),
    (
        PLAIN,
        '<record id="r1" model="ir.rule"><field name="domain_force"> [ ] </field><field name="v" ref="v1"/></record>',
        [("record-rule-without-domain", 6), ("data-noupdate-risk", 6)],
    ),
]
CSV_HEAD = "id,name,model_id:id,group_id:id,perm_read,perm_write,perm_create,perm_unlink\n"
#: By k % 3: rows of the access file, and the findings (manifest, access file).
ACCESS = [
    ("a,a,model_g{k}_thing,,1,0,0,0\n", [], []),
    ("", [("missing-access-csv", 1)], []),
    ("a,a,model_g{k}_ghost,,1,0,0,0\n", [("missing-access-csv", 1)], [("unknown-model-in-access-csv", 2)]),
]


def with_key(text: str) -> Column:
    return F.concat(*[F.lit(p) if n % 2 == 0 else F.col("k").cast("string") for n, p in enumerate(_split(text))])


def _split(text: str) -> list[str]:
    out: list[str] = []
    for part in text.split("{k}"):
        out += [part, "k"]
    return out[:-1]


def choose(modulus: int, texts: list[str]) -> Column:
    return reduce(lambda held, n: F.when(F.col("k") % modulus == n, with_key(texts[n])).otherwise(held), range(1, modulus), with_key(texts[0]))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``module_tree``."""
    k = F.col("k")
    lists = ["['views/v.xml', 'security/ir.model.access.csv']", "['security/ir.model.access.csv', 'views/v.xml']"]
    manifest = F.concat(
        F.lit("{'name': 'G', 'version': '17.0.1.0', 'installable': True, 'depends': "),
        F.when(k % 2 == 0, "['base', 'sale']").otherwise("['base']"),
        F.lit(", 'data': "),
        F.when(k % 3 == 0, lists[0]).otherwise(lists[1]),
        F.when(k % 4 == 0, "").otherwise(", 'license': 'L'"),
        F.when(k % 5 == 0, with_key(", 'assets': {'web.assets': ['g{k}/static/a.js']}")).otherwise(""),
        F.lit("}\n"),
    )
    python = F.concat(choose(6, [HEAD + body for body, _ in PYTHON]), F.when(k % 7 == 0, EXTENSION).otherwise(""))
    xml = choose(4, [VIEW.replace("{arch}", arch).replace("{more}", more) for arch, more, _ in XML])
    access = choose(3, [CSV_HEAD + rows for rows, _, _ in ACCESS])
    entry = lambda rel, kind, text: F.struct(F.lit(rel).alias("rel"), F.lit(kind).alias("kind"), text.cast("binary").alias("content"))
    made = F.array(
        entry("__manifest__.py", "manifest", manifest),
        entry("models/m.py", "python", python),
        entry("views/v.xml", "xml", xml),
        entry("security/ir.model.access.csv", "access", access),
    )
    rows = spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k")), "k")
    name = with_key("g{k}")
    rows = rows.select(name.alias("module"), F.concat(F.lit("/gen/"), name).alias("module_dir"), k.cast("int").alias("module_ord"), F.inline(made))
    return rows.withColumn("path", F.concat_ws("/", "module_dir", "rel")).select(
        "module", "module_dir", "module_ord", "path", "rel", "kind", "content"
    )


VERSION = "17.0"


def later_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of ``files`` some time later: every third has an empty view file; every 13th is gone; every 11th is new (``earlier_files`` lack it)."""
    k = F.col("module_ord")
    emptied = (k % 3 == 0) & (F.col("kind") == "xml")
    return files(spark, sf_dir).filter(k % 13 != 0).withColumn("content", F.when(emptied, F.lit("<root/>").cast("binary")).otherwise(F.col("content")))


def earlier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(F.col("module_ord") % 11 != 0)


def scanned(spark: SparkSession, sf_dir: str) -> tuple[Facts, DataFrame]:
    """The stages of a scan over the generated modules."""
    facts = Facts(files(spark, sf_dir)).settle()
    failed: list[str] = []
    raw = rule_findings(Project(facts, VERSION), active_rules(VERSION, []), failed)
    if failed or raw is None:
        raise RuntimeError(f"rules failed: {failed}")
    out = P.suppress(P.deduplicate(P.normalise(raw)), facts.suppressions)
    return facts, P.mark_eligible(out)


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir)[1].select("module", "file_path", "line", "rule", "category", "tier", "confidence", "eligible")


def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, found = scanned(spark, sf_dir)
    scope = sorted({r.category for r in active_rules(VERSION, [])})
    cats = scoring.category_scores(found, facts.manifests, scoring.category_table(spark, scope=scope))
    return scoring.module_scores(cats).select("module", "n", "least", "total", "counted", "blend")


COUNTED = ("manifest", "model", "record", "view", "access", "suppression", "controller", "access_domain")


def parsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts of each kind a module has."""
    facts = Facts(files(spark, sf_dir)).facts.filter(F.col("fact").isin(*COUNTED))
    return facts.groupBy("module", "fact").agg(F.count("*").alias("n"))


# --- what SQL expects ------------------------------------------------------------------------


def _expected() -> str:
    rows: list[tuple[int, int, str, str, str]] = []  # modulus, remainder, file, rule, line
    put = lambda m, r, file, found: rows.extend((m, r, file, rule, str(line)) for rule, line in found)
    for r, (_, found) in enumerate(PYTHON):
        put(6, r, "models/m.py", found)
    for r, (_, _, found) in enumerate(XML):
        put(4, r, "views/v.xml", found)
    for r, (_, on_manifest, on_access) in enumerate(ACCESS):
        put(3, r, "__manifest__.py", on_manifest)
        put(3, r, "security/ir.model.access.csv", on_access)
    put(3, 0, "__manifest__.py", [("manifest-data-order-risk", 1)])
    put(4, 0, "__manifest__.py", [("manifest-missing-required-fields", 1)])
    put(5, 0, "__manifest__.py", [("asset-bundle-missing", 1)])
    put(14, 7, "__manifest__.py", [("manifest-missing-dependency", 1)])
    values = ", ".join(f"({m}, {r}, '{f}', '{rule}', {line})" for m, r, f, rule, line in rows)
    starts = ", ".join(str(6 + body.count("\n")) for body, _ in PYTHON)
    facts = ", ".join(f"('{r.name}', '{r.category}', '{r.tier}', '{r.confidence}')" for r in REGISTRY.values())
    return f"""e AS (
  SELECT s_suppkey AS k, file, rule, line FROM supplier JOIN (VALUES {values}) v(m, r, file, rule, line) ON s_suppkey % m = r
  UNION ALL SELECT s_suppkey, 'models/m.py', 'removed-model-still-referenced', [{starts}][(s_suppkey % 6 + 1)::INT] FROM supplier WHERE s_suppkey % 7 = 0
), found AS (
  SELECT 'g' || k AS module, '/gen/g' || k || '/' || file AS file_path, line::INT AS line, rule, category, tier, confidence, confidence = 'high' AS eligible
  FROM e JOIN (VALUES {facts}) t(rule, category, tier, confidence) USING (rule))"""


FINDINGS_SQL = f"WITH {_expected()} SELECT * FROM found"
CATEGORY_SQL = f"cats AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {w}::DOUBLE)" for c, w in P.CATEGORIES.items())}) c(category, weight))"


def scores_of(found: str, modules: str = "SELECT 'g' || s_suppkey AS module FROM supplier") -> str:
    """The scores that findings give (``found``: module, category, tier, eligible)."""
    return f"""SELECT module, count(*) AS n, min(score) AS least, sum(score)::BIGINT AS total, sum(counted)::BIGINT AS counted,
  (4 * min(score) * count(*) + 6 * sum(score))::BIGINT AS blend FROM (
  SELECT m.module, c.category, coalesce(f.n, 0) AS counted, greatest(0, trunc(100 - round(coalesce(points, 0) * weight, 6)))::INT AS score
  FROM ({modules}) m CROSS JOIN cats c LEFT JOIN (
    SELECT module, category, count(*) AS n, sum(CASE tier {" ".join(f"WHEN '{t}' THEN {p}" for t, p in P.TIERS.items())} END) AS points
    FROM {found} WHERE eligible GROUP BY ALL) f ON f.module = m.module AND f.category = c.category) GROUP BY module"""


SCORES_SQL = f"WITH {_expected()}, {CATEGORY_SQL} {scores_of('found')}"
FACTS_SQL = """
SELECT 'g' || s_suppkey AS module, fact, n::BIGINT AS n FROM supplier, LATERAL (VALUES
  ('manifest', 1), ('model', 1 + (s_suppkey % 7 = 0)::INT), ('record', 2), ('view', 1), ('access', (s_suppkey % 3 != 1)::INT),
  ('suppression', (s_suppkey % 6 = 5)::INT + (s_suppkey % 4 = 1)::INT), ('controller', (s_suppkey % 6 = 5)::INT), ('access_domain', (s_suppkey % 4 = 3)::INT)) f(fact, n)
WHERE n > 0"""
