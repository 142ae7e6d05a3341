import json
import subprocess

import pytest

from healthloom.cli import changed_files, main
from healthloom.plans import cache, fixes, reports
from healthloom.plans.config import Config, load_config
from healthloom.plans.rules import REGISTRY
from healthloom.sources import linters as L
from healthloom.sources.tree import read_tree

BAD = "class A(models.Model):\n    _name = 'bad.thing'\n    p = fields.Many2one('x')\n    def f(self):\n        self.env.cr.execute(f'SELECT {self.n}')\n"
CLEAN = "class A(models.Model):\n    _name = 'ok.thing'\n    n = fields.Char(string='N')\n"
ACL = "id,name,model_id:id,group_id:id,perm_read\na,a,model_ok_thing,,1\n"


@pytest.fixture()
def project(module):
    bad = module("bad", **{"a.py": BAD})
    good = module("good", **{"a.py": CLEAN, "security/ir.model.access.csv": ACL})
    module("off", manifest="{'installable': False}")
    module("broken", manifest="{")
    return bad.parent, bad, good


def test_end_to_end(project, scanned):
    top, _, _ = project
    result = scanned(top)
    found = {(r.module, r.rule) for r in result.findings.collect()}
    assert {("bad", "missing-access-csv"), ("bad", "raw-sql-string-interpolation"), ("bad", "missing-ondelete")} <= found
    assert not {x for x in found if x[0] != "bad"}
    scores = {r.module: r.overall for r in result.scores.collect()}
    assert scores["good"] == 100.0 > scores["bad"] and result.version == "17.0" and not result.failed

    report = json.loads(reports.json_report(result))
    assert report["project_score"]["module_count"] == 2 and report["top_findings"][0]["tier"] == "P0"
    assert len(report["modules"]["bad"]["diagnostics"]) == len(found) and report["modules"]["bad"]["diagnostics"][0]["url"] is None
    log = json.loads(reports.sarif_report(result.findings, str(top)))
    run = log["runs"][0]
    assert {r["id"] for r in run["tool"]["driver"]["rules"]} == {r for _, r in found}
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].startswith("bad/")
    lines = reports.annotation_report(result.findings, str(top)).splitlines()
    assert len(lines) == len(found) and lines[0].startswith("::error file=bad/")
    body = reports.comment_body(result, delta="+1.0")
    assert "▲ +1.0 vs base" in body and "| bad |" in body
    assert reports.comment_action([{"id": 5, "body": body}]) == ("update", "5") and reports.comment_action([]) == ("create", None)
    shown = reports.terminal_report(result).splitlines()
    assert shown[0].startswith("== bad: ") and "== good: 100.0 of 100, Excellent" in shown
    at = next(k for k, line in enumerate(shown) if line.startswith("== 2 modules: "))
    assert len([x for x in shown if x.startswith("      -> ")]) == len(found) and shown[at + 1].startswith("   1. bad: ")
    assert len(shown) == at + 1 + min(5, len(found))


def test_config_settings_apply(project, scanned):
    top, bad, _ = project
    (top / "healthloom.toml").write_text('[severity]\nmissing-ondelete = "off"\n[ignore]\nrules = ["missing-access-csv"]\n')
    (bad / "healthloom.toml").write_text('[severity]\nraw-sql-string-interpolation = "info"\n[main]\ntarget_modules = ["bad"]\n')
    config = load_config(bad)
    assert config.severity == {"missing-ondelete": "off", "raw-sql-string-interpolation": "info"} and config.surfaces["ci_failure"].min_confidence == "high"
    rows = scanned(top, config=config).findings.collect()
    assert [(r.rule, r.severity) for r in rows] == [("raw-sql-string-interpolation", "info")]


def test_suppressed_and_non_utf8(module, scanned):
    source = b"# latin \xe9\n# x-doctor: disable=eval-usage\neval(x)\neval(y)\n"
    rows = scanned(module(**{"a.py": source})).findings.filter("rule = 'eval-usage'").collect()
    assert sorted(r.line for r in rows) == [3, 4]  # bytes that are not UTF-8: the file is parsed, its comments are not
    rows = scanned(module("m2", **{"a.py": source.replace(b"\xe9", b"e")})).findings.filter("rule = 'eval-usage'").collect()
    assert [r.line for r in rows] == [4]


def test_manifest_findings_collapse_to_the_longest(module, scanned):
    rows = scanned(module(manifest="{'name': 'x'}"), version="17.0").findings.filter("rule = 'manifest-missing-required-fields'").collect()
    assert [r.title for r in rows] == ["Manifest missing required field: 'installable'"]


def test_unknown_version_runs_no_rule(module, scanned):
    result = scanned(module(manifest="{'name': 'x'}"))
    assert result.version == "unknown" and result.findings.count() == 0 and result.scores.first().overall == 100.0


def test_fixes(module, scanned):
    m = module(manifest="# -*- coding -*-\n{'name': 'x', 'version': '17.0.1', 'data': ['views/a.xml', 'security/b.xml']}\n")
    result = scanned(m)
    (row,) = fixes.compute_fixes(result.findings, result.facts.files).collect()
    fixed = fixes.literal(row.new_text)
    assert fixed["license"] == "LGPL-3" and fixed["data"] == ["security/b.xml", "views/a.xml"] and row.fixed == 2
    assert fixes.fill_required(row.new_text) == row.new_text and fixes.security_first(row.new_text) == row.new_text
    assert fixes.fill_required("# head\n{}").startswith("# head\n{") and fixes.fill_required("f()") is None
    made = fixes.compute_fixes(result.findings, result.facts.files).persist()
    assert reports.text_of(fixes.write_diffs, made).count("+++ b/") == 1
    (m / "__manifest__.py").write_text("{'name': 'edited'}\n")
    assert fixes.write_fixes(made) == (0, 1)
    (m / "__manifest__.py").write_text(row.old_text)
    assert fixes.write_fixes(made) == (1, 0) and (m / "__manifest__.py").read_text() == row.new_text
    assert fixes.write_fixes(made) == (1, 0) and len(list(m.iterdir())) == 1


@pytest.mark.parametrize(
    "text",
    [
        "{}", "{\n}\n", "{'name': 'x'}", "{'name': 'x',}", "# a\n{\n    'name': 'é',  # why, oh\n    # last, word\n}\n# end\n",
        "{'name': None, 'depends': '', 'data': [\n  'a.xml',  # first\n  'security/b.csv',\n]}", "{'name': 'x', 'license': 'L', 'license': ''}",
        "{'a': (1,\n 2)  # no comma\n}", "{'data': ['v/a.xml', 'v/groups.xml', 'security/x.csv'], 'x': {'y': [1]}}\r\n",
    ],
)
def test_fixers_change_nothing_else(text):
    before = fixes.literal(text)
    new = fixes.fill_required(text)
    filled = fixes.literal(new)
    assert {k: v for k, v in filled.items() if k not in fixes.DEFAULTS} == {k: v for k, v in before.items() if k not in fixes.DEFAULTS}
    assert all(filled[k] == (before[k] if before.get(k) not in (None, "") else v) for k, v in fixes.DEFAULTS.items())
    assert fixes.fill_required(new) == new
    comments = lambda t: [x.partition("#")[2] for x in t.splitlines() if "#" in x]
    assert comments(new) == comments(text)
    ordered = fixes.security_first(new)
    files = fixes.literal(ordered)["data"]
    assert files == sorted(filled["data"], key=lambda f: not fixes.looks_secure(f)) and comments(ordered) == comments(text)
    assert fixes.security_first(ordered) == ordered


def test_joined_text(spark, tmp_path):
    from pyspark.sql import functions as F

    from healthloom.sources.joined import write_joined

    path = tmp_path / "out.json"
    rows = spark.range(1000).repartition(7).orderBy("id").select(F.col("id").cast("string"))
    write_joined(rows, str(path), "[", ",", "]")
    assert json.loads(path.read_text()) == list(range(1000))
    broken = rows.select(F.when(F.col("id") == "777", F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_joined(broken, str(path), "[", ",", "]")
    assert json.loads(path.read_text()) == list(range(1000)) and [p.name for p in tmp_path.iterdir()] == ["out.json"]
    write_joined(rows.filter("false"), str(path), "[", ",", "]")
    assert path.read_text() == "[]"


def test_linters(module, scanned, spark):
    m = module(**{"a.py": "x = 1\n"})
    files = read_tree(spark, [str(m)]).filter("kind = 'manifest'")
    got = '[{"code": "E1", "message": "bad", "filename": "a.py", "location": {"row": 1, "column": 2}}, {"code": null, "message": null, "filename": null, "location": null}]'
    ruff = L.Linter("ruff", ("ruff",), "json", 5, (("E1", ("Security", "P1", "high")),))
    rows = L.lint(files, ruff, "17.0", run=lambda c, s: ("ok", got, "", 1)).collect()
    assert sorted((r.rule, r.category, r.tier, r.severity, r.line) for r in rows) == [("E1", "Security", "P1", "error", 1), ("unknown", "Uncategorized", "P3", "warning", 0)]
    text = "*** Module x\n/p/a.py:3:4: C0103: Bad name (invalid-name)\nnoise\n"
    pylint = L.Linter("pylint-x", ("pylint",), "text", 5)
    (row,) = L.lint(files, pylint, "17.0", run=lambda c, s: ("ok", text, "", 4)).collect()
    assert (row.rule, row.line, row.column, row.message, row.source) == ("C0103", 3, 4, "Bad name", "pylint-x")
    for state in ("missing", "timeout"):
        (row,) = L.lint(files, pylint, "17.0", run=lambda c, s, state=state: (state, "", "", 0)).collect()
        assert row.confidence == "low" and row.rule == "pylint-x-unavailable"
    (row,) = L.lint(files, pylint, "17.0", run=lambda c, s: ("ok", "", "", 2)).collect()
    assert "status 2" in row.message


def test_cache_key_follows_contents(module, spark, tmp_path):
    m = module(**{"a.py": "x = 1\n"})
    key = lambda *s: cache.fingerprint(read_tree(spark, [str(m)]), *s)
    first = key({"b", "a"})
    assert first == key({"a", "b"}) != key({"a"})
    (m / "a.py").write_text("x = 2\n")
    assert key({"a", "b"}) != first
    assert cache.load(spark, str(tmp_path / "c"), first) is None
    cache.store(spark.range(3), str(tmp_path / "c"), first)
    assert cache.load(spark, str(tmp_path / "c"), first).count() == 3


def test_kept_findings(module, scanned, tmp_path):
    m = module(**{"a.py": BAD})
    first = scanned(m, cache_dir=str(tmp_path / "kept"))
    again = scanned(m, cache_dir=str(tmp_path / "kept"))
    assert sorted(map(str, first.findings.collect())) == sorted(map(str, again.findings.collect()))
    assert [r.overall for r in first.scores.collect()] == [r.overall for r in again.scores.collect()]
    assert len([p for p in (tmp_path / "kept").iterdir()]) == 1


def test_comment_is_posted_or_updated():
    said = []

    def run(arguments, comments='{"comments": []}'):
        said.append(arguments[:2])
        return comments

    assert reports.post_comment("b", run=run) == "create" and said[-1] == ["pr", "comment"]
    held = json.dumps({"comments": [{"id": 4, "body": reports.MARKER}]})
    assert reports.post_comment("b", run=lambda a: run(a, held)) == "update" and said[-1] == ["api", "-X"]
    assert reports.post_comment("b", run=lambda a: None) is None


def test_commands(project, tmp_path, capsys, monkeypatch, spark):
    top, bad, good = project
    out = tmp_path / "r.json"
    assert main(["scan", str(top), "--no-linters", "--format", "json", "--output", str(out), "--fail-on", "error"]) == 1
    assert json.loads(out.read_text())["schema_version"] == "1.0"
    assert main(["scan", str(bad), "--no-linters", "--min-score", "99"]) == 2
    assert main(["scan", str(good), "--no-linters", "--min-score", "99"]) == 0
    assert main(["fix", str(bad)]) == 3
    capsys.readouterr()
    assert main(["rules"]) == 0 and len(capsys.readouterr().out.splitlines()) == len(REGISTRY) == 29
    assert main(["init", str(tmp_path)]) == 0 and main(["init", str(tmp_path)]) == 3
    assert load_config(tmp_path).ignore_files == ["**/migrations/**"]


def test_changed_files_by_git(project, scanned, spark):
    top, bad, _ = project
    run = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (bad / "a.py").write_text(BAD + "x = 1\n")
    names = changed_files(str(top), "HEAD")
    assert [n.rpartition("/")[2] for n in names] == ["a.py"]
    rows = scanned(top, changed=spark.createDataFrame([(n,) for n in names], "path string")).findings.collect()
    assert {r.rule for r in rows} >= {"raw-sql-string-interpolation", "missing-access-csv"}
    assert changed_files(str(top), "no-such-ref") is None


def test_source_index_and_stub_files(module, scanned, spark, tmp_path):
    from healthloom.operators import resolve
    from healthloom.sources.parsed import Facts

    lib = module("lib/addons/base_lib", manifest="{'name': 'l', 'version': '17.0.1'}", **{"m.py": "class P(models.Model):\n    _name = 'lib.p'\n    n = fields.Char()\n"})
    m = module("app", **{"a.py": "class A(models.Model):\n    _inherit = 'lib.p'\n"})
    found = scanned(m, config=Config(source_path=str(lib.parent.parent))).findings
    assert [r.title for r in found.filter("rule = 'manifest-missing-dependency'").collect()] == ["Possible missing dependency for 'base_lib'"]
    assert found.filter("rule = 'removed-model-still-referenced'").count() == 0
    body = resolve.build_stubs(Facts(read_tree(spark, [str(lib)])), "17.0").first().value
    (tmp_path / "17.0.json").write_text(body)
    stubs = resolve.stubs_for(spark, str(tmp_path), "17.0")
    assert [(r.model, r.complete) for r in stubs.models.collect()] == [("lib.p", True)]
    assert ("lib.p", "field", "n") in {tuple(r) for r in stubs.members.collect()}
    assert resolve.stubs_for(spark, str(tmp_path), "9.0").models.count() == 0


def test_reports_read_findings_that_are_written(spark):
    """Scores and reports read what the rules found once, not the rules' plan again for each of them."""
    from healthloom.plans.engine_queries import result_of

    plan = result_of(spark, "/root/testdata/sf0.001").findings._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Relation" not in plan and "Join" not in plan
