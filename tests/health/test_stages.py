import re
import fnmatch

import pytest
from pyspark.sql import functions as F

from healthloom.functions import columns as C
from healthloom.operators import baseline, resolve, scoring
from healthloom.operators import findings as P

SCHEMA = "module string, file_path string, line int, column int, rule string, category string, severity string, tier string, source string, confidence string, title string, message string, help string, odoo_version string, url string, seq long"


@pytest.fixture()
def make(spark):
    def build(*rows):
        base = dict(
            module="m", file_path="/p/m/a.py", line=1, column=0, rule="r", category="Security", severity="error", tier="P1",
            source="native", confidence="high", title="t", message="msg", help="", odoo_version="17.0", url=None,
        )
        return spark.createDataFrame([{**base, "seq": k, **r} for k, r in enumerate(rows)], SCHEMA)

    return build


def test_dedup_prefers_confidence_source_length_then_first(make):
    rows = P.deduplicate(make({"confidence": "low", "message": "long long"}, {"message": "a"}, {"source": "ruff", "message": "bbbb"}, {"message": "c"}, {"rule": "s"}))
    assert sorted((r.rule, r.message) for r in rows.collect()) == [("r", "a"), ("s", "msg")]


def test_suppression_by_line_and_file(make, spark):
    rows = make({"line": 3}, {"line": 4}, {"rule": "s", "line": 9})
    marks = spark.createDataFrame([("/p/./m/a.py", 4, "r"), ("/p/m/a.py", 0, "s"), ("/p/m/a.py", 3, "other")], "path string, line int, rule string")
    assert [r.line for r in P.suppress(rows, marks).collect()] == [3]


def segments(path, glob):
    """Independent matcher: dynamic programming over segments."""
    a, b = [s for s in path.split("/") if s], [s for s in glob.split("/") if s]
    ok = {(len(a), len(b))}
    for j in range(len(b) - 1, -1, -1):
        for i in range(len(a), -1, -1):
            if b[j] == "**" and ((i, j + 1) in ok or i < len(a) and (i + 1, j) in ok):
                ok.add((i, j))
            elif b[j] != "**" and i < len(a) and fnmatch.fnmatchcase(a[i], b[j]) and (i + 1, j + 1) in ok:
                ok.add((i, j))
    return (0, 0) in ok


def test_globs():
    paths = ["migrations", "a/migrations", "a/migrations/b/c.py", "migrations/x", "/abs/a/b.py", "b.py", "a/b.pyc", "a", "a/b", "a/x[1].py", "abc"]
    globs = ["**/migrations/**", "**", "*.py", "**/*.py", "a/**", "a/**/b", "**/b.*", "a/?", "a/x[[]1].py", "[!b]*", "a/*/c.py", "a/**/**/c.py"]
    for g in globs:
        for p in paths:
            assert bool(re.search(C.glob_pattern(g), p)) == segments(p, g), (p, g)


def test_ignore_relative_to_a_base(make):
    rows = make({"file_path": "/p/m/migrations/a.py"}, {"file_path": "/p/m/b.py"})
    assert P.ignore(rows, [], [], ["m/migrations/*"], "/p").count() == 1


def test_changed_only(make, spark):
    rows = make({}, {"file_path": "/p/m/b.py"}, {"file_path": "/p/m/b.py", "rule": "ctx"}, {"file_path": "/p/mm/c.py", "module": "mm", "rule": "ctx"})
    changed = spark.createDataFrame([("/p/m/a.py",)], "path string")
    dirs = spark.createDataFrame([("m", "/p/m"), ("mm", "/p/mm")], "module string, module_dir string")
    assert sorted((r.file_path, r.rule) for r in P.changed_only(rows, changed, dirs, ["ctx"]).collect()) == [("/p/m/a.py", "r"), ("/p/m/b.py", "ctx")]


def score(spark, rows, scope):
    found = spark.createDataFrame([("m", c, t, True) for c, t in rows] or [("m", "none", "P3", False)], "module string, category string, tier string, eligible boolean")
    cats = scoring.category_scores(found, found, scoring.category_table(spark, {c: 1.0 for c in scope}, scope))
    return scoring.with_labels(scoring.module_scores(cats)).first()


def test_worked_scores(spark):
    two = score(spark, [("Security", "P0")], ["Security", "Performance"])
    assert (two.overall, two.label) == (82.5, "Good")
    four = score(spark, [("Security", "P0")] * 4, ["Security"])
    assert (four.overall, four.label) == (0.0, "Critical")
    assert score(spark, [("Security", "P0")] * 4, ["Security", "Performance"]).overall == 30.0
    assert score(spark, [("Security", "P0")], []).overall == 100.0


def test_labels_at_exact_halves(spark):
    """49.95 is Needs work, though 0.4 * 6 + 0.6 * (634 / 8) is a double below it."""
    rows = [("a", 6, 634), ("b", 0, 666), ("c", 6, 633), ("d", 54, 698), ("e", 81, 767)]
    scores = spark.createDataFrame([(m, 8, least, total, 32 * least + 6 * total, 0.4 * least + 0.6 * (total / 8)) for m, least, total in rows], "module string, n long, least int, total long, blend long, overall_raw double")
    told = {r.module: (r.overall, r.label) for r in scoring.with_labels(scores).collect()}
    exact = {m: (32 * least + 6 * total) / 80 for m, least, total in rows}
    assert exact["a"] == exact["b"] == 49.95
    assert told["a"] == told["b"] == (50.0, "Needs work")
    assert told["c"] == (49.9, "Critical")
    assert all(abs(told[m][0] - exact[m]) <= 0.05 + 1e-9 for m in told)


def test_impacts_are_exact(spark):
    found = spark.createDataFrame([("m", "Module Hygiene", "P2", True)] * 15, "module string, category string, tier string, eligible boolean")
    cats = scoring.category_scores(found, found, scoring.category_table(spark))
    assert cats.filter("category = 'Module Hygiene'").first().score == 52


def test_rounding_as_binary_doubles(spark):
    values = [0.15, 2.25, 82.45, 0.25, 66.65]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(C.rounded(F.col("v")).alias("r")).collect()
    assert [r.r for r in rows] == [round(v, 1) for v in values]


def test_delta_text():
    assert [scoring.delta_text(d) for d in (1.54, -2.0, 0.01)] == ["+1.5", "-2.0", "0.0"]


def test_identity_survives_moves(make, spark):
    lines = spark.createDataFrame([("/p/m/a.py", 1, " x  = 1"), ("/p/m/a.py", 5, "x = 1 "), ("/p/m/a.py", 6, "y")], "path string, line int, text string")
    ids = {r.line: r.identity for r in baseline.with_identity(make({}, {"line": 5}, {"line": 6}), lines).collect()}
    assert ids[1] == ids[5] != ids[6]


def test_baseline_file(make, spark, tmp_path):
    rows = baseline.with_identity(make({}, {"rule": "s"}))
    path = str(tmp_path / "b.json")
    baseline.write_baseline(rows.filter("rule = 'r'"), path)
    assert [r.rule for r in baseline.filter_known(rows, baseline.read_baseline(spark, path)).collect()] == ["s"]
    assert baseline.read_baseline(spark, str(tmp_path / "none")).count() == 0
    # a file of another hand, and a broken one
    (tmp_path / "b.json").write_text('{"version": 1, "ids": ["a", "b"], "more": {}}')
    assert sorted(r.identity for r in baseline.read_baseline(spark, str(tmp_path / "b.json")).collect()) == ["a", "b"]
    (tmp_path / "b.json").write_text('{"version": 1, "ids": ["a"')
    assert baseline.read_baseline(spark, str(tmp_path / "b.json")).count() == 0


def test_candidates_in_order(spark):
    got = lambda x: spark.range(1).select(C.candidate_models(F.lit(x))).first()[0]
    assert got("model_ir_act_window") == ["ir.act.window", "ir_act.window", "ir.act_window", "ir_act_window"]
    assert got("model_a") == ["a"] and len(got("a_b_c_d_e_f_g_h_i")) == 256 and len(got("a_b_c_d_e_f_g_h_i_j")) == 1


def test_version_compare(spark):
    rows = [("17.0", "14.0"), ("9.0", "14.0"), ("unknown", "14.0"), ("16", "16.0")]
    got = spark.createDataFrame(rows, "a string, b string").select(C.version_at_least(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False, False, True]


def test_completeness_of_diamonds_cycles_and_leaves(spark):
    edges = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "e"), ("f", "g"), ("g", "f"), ("h", "out"), ("i", "nowhere"), ("j", "part")]
    df = spark.createDataFrame(edges, "model string, parent string")
    leaves = spark.createDataFrame([("out", True), ("part", False)], "model string, complete boolean")
    got = {r.model: r.complete for r in resolve.complete_models(df, leaves).collect()}
    assert got == dict(a=True, b=True, c=True, d=False, e=True, f=False, g=False, h=True, i=False, j=False, out=True, part=False)


def test_gates(make, spark):
    gates = P.Gates([("r", "18.0", [], []), ("s", None, ["x"], []), ("t", "14.0", [], ["y"])]).frame(spark)
    rows = make({}, {"rule": "s"}, {"rule": "t"}, {"rule": "free"})
    assert sorted(r.rule for r in P.gate(rows, gates, "17.0", ["x"]).collect()) == ["free", "s", "t"]
