"""Symbols by version, and what a rule makes of what a version has lost."""

from healthloom.cli import main
from healthloom.operators import resolve, symbols
from healthloom.plans.config import Config

BASE = "class A(models.Model):\n    _name = '%s'\n    n = fields.Char()\n    def go(self):\n        pass\n"


def build(module, spark, tmp_path):
    """16.0 has a.one, a.two, a.three; in 17.0 a.two is called a.zwei, a.three is gone, a.one has another method."""
    old = module("old/lib", **{"a.py": BASE % "a.one" + "    def more(self):\n        pass\n", "b.py": BASE % "a.two" + "    x = fields.Char()\n", "c.py": BASE % "a.three"})
    new = module("new/lib", **{"a.py": BASE % "a.one" + "    def other(self):\n        pass\n", "b.py": BASE % "a.zwei" + "    x = fields.Char()\n"})
    store = str(tmp_path / "store")
    for version, folder in (("16.0", old), ("17.0", new), ("17.0", new)):
        assert main(["symbols", str(folder.parent), "--version", version, "--into", store]) == 0
    return store


def test_changes_between_versions(module, spark, tmp_path):
    store = build(module, spark, tmp_path)
    assert symbols.versions(spark, store) == ["16.0", "17.0"]
    part = lambda v, name: symbols.part_of(spark, store, v, name)
    found = {tuple(r) for r in symbols.changes(part("16.0", "models"), part("17.0", "models")).collect()}
    assert found == {("a.two", "renamed", "a.zwei"), ("a.three", "removed", None)}
    members = symbols.member_changes(part("16.0", "members"), part("17.0", "members"), part("17.0", "models"))
    assert {tuple(r) for r in members.collect()} == {("a.one", "method", "more", "removed"), ("a.one", "method", "other", "added")} | {
        ("a.zwei", k, n, "added") for k, n in (("field", "n"), ("field", "x"), ("method", "go"))
    }
    plan = part("17.0", "members")._jdf.queryExecution().toString()
    assert "version=17.0" in plan or part("17.0", "members").inputFiles()[0].count("version=17.0")
    assert all("version=17.0" in f for f in part("17.0", "members").inputFiles())


def test_versions_are_ordered_and_found(module, spark, tmp_path):
    store = build(module, spark, tmp_path)
    tables = {p: symbols.part_of(spark, store, "16.0", p) for p in symbols.LAYOUTS}
    symbols.write_version(tables, store, "9.0")
    assert symbols.versions(spark, store) == ["9.0", "16.0", "17.0"]
    assert {r.model for r in resolve.stubs_for(spark, store, "17.0.1").models.collect()} == {"a.one", "a.zwei"}
    assert resolve.stubs_for(spark, store, "15.0").models.count() == 0 and resolve.stubs_for(spark, None, "17.0").lost is None
    assert {tuple(r) for r in resolve.stubs_for(spark, store, "17.0").lost.collect()} == {("a.two", "16.0", "a.zwei"), ("a.three", "16.0", None)}


def test_the_rule_tells_what_is_gone_from_what_was_never_known(module, scanned, spark, tmp_path):
    store = build(module, spark, tmp_path)
    names = ("a.one", "a.two", "a.three", "a.four")
    m = module("app", **{"m.py": "".join(f"class C{k}(models.Model):\n    _inherit = '{n}'\n" for k, n in enumerate(names))})
    result = scanned(m, config=Config(stubs_path=store))
    found = {r.title.split("'")[1]: r.message for r in result.findings.filter("rule = 'removed-model-still-referenced'").collect()}
    assert set(found) == {"a.two", "a.three", "a.four"}
    assert found["a.two"].endswith(" Version 16.0 had it. 'a.zwei' has the same members now.")
    assert found["a.three"].endswith(" Version 16.0 had it.") and found["a.four"].endswith("unscanned dependency.")
