from healthloom.operators import resolve

MODEL = """\
    class A(models.Model):
        _name = 'my.thing'
        {body}
"""


def model(body: str) -> str:
    return "class A(models.Model):\n    _name = 'my.thing'\n" + "".join(f"    {b}\n" for b in body.splitlines())


def test_file_rules(module, rows_of):
    m = module(**{"a.py": "def f(self):\n    eval(x)\n    eval('1')\n    tools.eval(x)\n    self.sudo()\n    # fine\n    self.sudo()\n    self.sudo()  # ok\n"})
    assert rows_of("eval-usage", m) == [("a.py", 2)]
    assert rows_of("sudo-without-comment", m) == [("a.py", 5)]


def test_controllers_and_errors(module, rows_of):
    source = "class C(http.Controller):\n    @http.route('/a', auth='public')\n    def a(self):\n        return x.sudo()\n    @http.route('/b')\n    def b(self):\n        raise UserError('x')\n    def c(self):\n        raise UserError(_('x'))\n"
    m = module(**{"a.py": source})
    assert rows_of("public-controller-sudo-risk", m) == [("a.py", 3)]
    assert rows_of("missing-translation", m) == [("a.py", 7)]


def test_deprecated_lines(module, rows_of):
    m = module(**{"a.py": "from openerp import x\n _columns = {\nx = osv.osv_memory\nself.pool.get ('a')\nfrom openerpx\n", "__x.py": "from openerp import y\n"})
    assert rows_of("deprecated-api-usage", m) == [("a.py", k) for k in (1, 2, 3, 4)]


def test_access_rules(module, rows_of):
    head = "id,name,model_id:id,group_id:id,perm_read\n"
    bare = module("bare", **{"a.py": model("x = 1")})
    assert rows_of("missing-access-csv", bare) == [("__manifest__.py", 1)]
    good = module("good", **{"a.py": model("x = 1"), "security/ir.model.access.csv": head + "a,a,model_my_thing,,1\nb,b,model_gone,,1\nc,c,base.model_other,,1\n"})
    assert rows_of("missing-access-csv", good) == []
    assert rows_of("unknown-model-in-access-csv", good) == [("ir.model.access.csv", 3)]


def test_view_members_need_proof(module, rows_of, spark):
    arch = '<root><record id="v" model="ir.ui.view"><field name="model">{m}</field><field name="arch"><form><field name="x"/><field name="gone"/><field name="id"/><button name="b" type="object"/></form></field></record></root>'
    m = module(**{"a.py": model("x = fields.Char()\ndef go(self): pass"), "v.xml": arch.format(m="my.thing")})
    assert rows_of("view-field-not-in-model", m, column="title") == ["View references unknown field 'gone'"]
    assert rows_of("button-method-not-found", m) == [("v.xml", 1)]
    other = module("other", **{"v.xml": arch.format(m="res.partner")})
    assert rows_of("view-field-not-in-model", other) == []
    stubs = resolve.Stubs(
        spark.createDataFrame([("res.partner", True)], "model string, complete boolean"),
        spark.createDataFrame([("res.partner", "field", "x")], "model string, kind string, name string"),
        spark.createDataFrame([], "xml_id string"),
    )
    assert rows_of("view-field-not-in-model", other, stubs=stubs) == [("v.xml", 1)]


def test_inherited_models_are_incomplete_unless_known(module, rows_of):
    arch = '<root><record id="v" model="ir.ui.view"><field name="model">my.thing</field><field name="arch"><field name="gone"/></field></record></root>'
    m = module(**{"a.py": model("_inherit = ['mail.thread']"), "v.xml": arch})
    assert rows_of("view-field-not-in-model", m) == []
    assert rows_of("removed-model-still-referenced", m, column="title") == ["Model 'mail.thread' not found in version 17.0"]
    assert rows_of("manifest-missing-dependency", m, column="title") == ["Possible missing dependency for 'mail'"]


def test_xml_references(module, rows_of):
    source = '<root>\n<record id="a" model="m"><field name="x" ref="gone"/><field name="y" ref="other.z"/><field name="z" ref="b"/></record>\n<record id="b" model="m"/>\n<record id="a" model="m"/>\n<record id="v" model="ir.ui.view"><field name="model">q</field><field name="inherit_id" ref="mod.nope"/></record></root>'
    m = module(**{"d.xml": source})
    assert rows_of("missing-xml-ref", m) == [("d.xml", 2), ("d.xml", 5)]
    assert rows_of("duplicate-xml-id", m) == [("d.xml", 4)]


def test_unlisted_files_do_not_count(module, rows_of):
    m = module(manifest="{'name': 'x', 'data': []}", **{"d.xml": '<root><record id="a" model="ir.cron"/></root>'})
    assert rows_of("data-noupdate-risk", m) == []
    assert rows_of("manifest-missing-required-fields", m, column="title") == [f"Manifest missing required field: '{k}'" for k in ("depends", "installable", "license", "version")]


def test_fields_and_computes(module, rows_of):
    body = "a = fields.Char(required=True)\nb = fields.Many2one('x')\nc = fields.Many2one('x', ondelete='cascade')\n@api.depends('a')\ndef _compute_d(self):\n    self.d = self.a or self.b or self.env"
    m = module(**{"a.py": model(body)})
    assert rows_of("field-no-string-on-required", m) == [("a.py", 3)]
    assert rows_of("missing-ondelete", m) == [("a.py", 4)]
    assert rows_of("compute-missing-depends", m, column="title") == ["Compute reads undeclared field 'b'"]


def test_assets_and_order(module, rows_of):
    manifest = "{'name': 'x', 'data': ['views/a.xml', 'data/b.xml', 'security/c.xml'], 'assets': {'w': ['mod/s/here.js', 'mod/s/gone.js', 'mod/s/*.js', 'web/x.js', 'mod/s']}}"
    m = module(manifest=manifest, **{"s/here.js": ""})
    assert rows_of("asset-bundle-missing", m, column="title") == ["Asset file not found: mod/s/gone.js"]
    assert rows_of("manifest-data-order-risk", m) == [("__manifest__.py", 1)]
