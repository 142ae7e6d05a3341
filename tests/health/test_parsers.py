from pyspark.sql import functions as F

from healthloom.sources import other_facts, python_facts


def calls(source, **want):
    out = [f for f in python_facts.facts(source.encode()) if f["fact"] == "call"]
    return [f["line"] for f in out if all(f["data"].get(k) == v for k, v in want.items())]


def test_taint_is_scoped_and_cleared():
    source = """
def a(self):
    q = "SELECT %s" % self.x
    self.env.cr.execute(q)
    q = "SELECT 1"
    self.env.cr.execute(q)
    q += name
    cr.execute(q)
def b(self, q):
    cr.execute(q)
    cr.execute(f"DROP {self._table}")
    cr.execute(f"DROP {x}")
    cr.execute("a" + self._table)
    cr.execute("SELECT {}".format(1))
    cr.execute("SELECT {}".format(x))
    cr.execute("plain {}".format(x))
    cr.execute("SELECT %s" % ("a", 1))
    other.execute("SELECT %s" % x)
"""
    assert calls(source, tainted_sql=True) == [4, 8, 12, 15]


def test_loops_own_their_calls():
    source = """
for x in self.env['m'].search([]):
    x.write({})
    for y in [1]:
        y.search([])
        self.read()
while True:
    re.search('a', b)
    open('f').read()
async def f():
    async for z in self:
        z.search([])
"""
    assert calls(source, in_loop=True, orm_here=True, name="search") == [2]
    assert calls(source, in_loop=True, orm_here=True, name="write") == [3]
    assert calls(source, in_loop=True, orm_here=True, name="read") == [6]


def test_models_fields_methods():
    source = """
class A(models.Model):
    _name = 'a.b'
    _inherit = ['x', 'y', 3]
    _inherits = {'res.partner': 'partner_id'}
    p = fields.Many2one('res.partner', required=1)
    n = fields.Char('Label', compute='_c')
    o = fields.Image()
    @api.depends('n', 'p.name')
    def _c(self):
        for r in self:
            r.n = r.p.q + self.z
    def write(self, v):
        return super().write(v)
class B(Other): pass
"""
    (m,) = [f["data"] for f in python_facts.facts(source.encode()) if f["fact"] == "model"]
    assert (m["name"], m["inherit"], m["inherits"]) == ("a.b", ["x", "y"], ["res.partner"])
    assert [(f["name"], f["comodel"], f["string"], f["required"]) for f in m["fields"]] == [("p", "res.partner", None, True), ("n", None, "Label", False)]
    c, w = m["methods"]
    assert (c["depends"], c["reads"], c["supers"], w["supers"]) == (["n", "p.name"], ["p", "z"], False, True)


def test_broken_and_odd_files():
    assert python_facts.facts(b"def (:") == []
    assert python_facts.facts(b"# x\n\xff = 1\n") == []
    assert python_facts.facts(b"") == []
    assert python_facts.facts(b"-" * 100_000 + b"1") == []  # the parser's stack
    deep = b"x = " + b"(" * 50 + b"1" + b")" * 50
    assert python_facts.facts(deep) == []


def test_suppression_comments():
    source = b"# a-doctor: disable=r1, r2\nx = 1  # a-doctor: disable-file=r3\n's # a-doctor: disable=r4'\n"
    got = [(f["line"], f["data"]["rule"]) for f in python_facts.facts(source) if f["fact"] == "suppression"]
    assert got == [(2, "r1"), (2, "r2"), (0, "r3")]
    xml = b"<!-- a-doctor: disable-file=r5 --><root>\n<!-- a-doctor: disable=r6 -->\n</root>"
    assert [(f["line"], f["data"]["rule"]) for f in other_facts.xml(xml)] == [(0, "r5"), (3, "r6")]


def test_xml_records_and_views():
    source = b"""<root>
<data noupdate="1">
<record id="a" model="m"><field name="x" ref="r1"/><field name="y" eval="[ref('b.r2'), ref('r3')]"/>
<field name="inherit_id" ref="skip"/></record></data>
<record id="v" model="ir.ui.view"><field name="model"> my.model </field><field name="inherit_id" ref="p"/>
<field name="arch" type="xml"><form><field name="f1"/><group><field name="f1"/><field name="lines">
<tree><field name="sub"/><button name="subm" type="object"/></tree></field></group>
<button name="go" type="object"/><button name="no"/></form></field></record>
<menuitem id="m1"/><template id="t.q"/></root>"""
    facts = other_facts.xml(source)
    records = {f["data"]["id"]: f for f in facts if f["fact"] == "record"}
    assert [r["ref"] for r in records["a"]["data"]["refs"]] == ["r1", "b.r2", "r3"]
    assert records["a"]["data"]["noupdate"] and not records["v"]["data"]["noupdate"]
    assert (records["m1"]["data"]["model"], records["t.q"]["data"]["model"]) == ("ir.ui.menu", "ir.ui.view")
    (v,) = [f["data"] for f in facts if f["fact"] == "view"]
    assert (v["model"], v["parent"]) == ("my.model", "p")
    assert [x["name"] for x in v["fields"]] == ["f1", "lines"] and [x["name"] for x in v["buttons"]] == ["go"]
    assert other_facts.xml(b"<root>") == [] and other_facts.xml(b"") == []


def test_manifest_and_access():
    (m,) = other_facts.manifest(b"# c\n{'name': '', 'data': ['a.xml'], 'assets': {'b': ['x']}, 'version': 3}")
    assert (m["data"]["version"], m["data"]["filled"]) == (None, ["data", "assets", "version"])
    assert other_facts.manifest(b"[1]") == [] and other_facts.manifest(b"f()") == []
    rows = other_facts.access("﻿id,model_id/id,perm_read\na,base.model_x,1\nb,model_y_\xff,0\n".encode("latin-1", "replace"))
    assert [r["line"] for r in rows] == [2, 3] and rows[0]["data"]["read"]


def test_sql_forms():
    source = """
def f(self, x):
    cr.execute("a" + "b")
    cr.execute("a" + "b" + "c")
    cr.execute("a" + 1)
    cr.execute("%s" % (("a", [1]), x))
    cr.execute("INSERT {a}".format(a=[1, 2]))
    cr.execute("INSERT {a}".format(a=[1, x]))
    cr.execute(x.format(1))
    cr.execute(x.format(x))
    cr.execute(f"SELECT 1")
    q = "SELECT "
    q += f"x"
    cr.execute(q)
"""
    assert calls(source, tainted_sql=True) == [4, 5, 6, 8, 10, 14]


def test_access_files_that_break_the_reader():
    head = b"id,name,model_id:id,group_id:id,perm_read\n"
    long = other_facts.access(head + b"a," + b"x" * 200_000 + b",model_m,,1\n")
    assert [(f["fact"], len(f["data"]["name"])) for f in long] == [("access", 200_000)]
    cut = other_facts.access(head + b"a,b,model_m,,1\n" + b'c,"d' + b"\r" + b'e"f,\r"\n')
    assert [f["data"]["id"] for f in cut if f["fact"] == "access"][:1] == ["a"]


def test_small_keys_are_parsed_by_many_tasks(spark):
    """A table of keys is one task by its bytes; the files made of them are parsed by several, and none of them has most."""
    from healthloom.plans import generated
    from healthloom.sources.parsed import parse_files

    facts = parse_files(generated.files(spark, "/root/testdata/sf0.01")).filter("fact = 'manifest'")
    tasks = facts.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in tasks) == 100 and max(r["count"] for r in tasks) <= 40
