"""Streams against batches."""

import subprocess

from pyspark.sql import functions as F

from healthloom.plans.rules import REGISTRY
from healthloom.sources import commits
from healthloom.streaming import health, trees

MANIFEST = "{'name': 'M', 'version': '17.0.1.0'}\n"
BAD = "def f(self):\n    eval(x)\n    self.sudo()\n"


def git(folder, *args):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True, text=True).stdout.strip()


def test_a_branch_as_a_stream_equals_its_last_commit(spark, tmp_path):
    top = tmp_path / "repo"
    for k in range(3):
        (top / f"addons/m{k}").mkdir(parents=True)
        (top / f"addons/m{k}/__manifest__.py").write_text(MANIFEST)
        (top / f"addons/m{k}/a.py").write_text(BAD)
    (top / "plain.py").write_text(BAD)
    git(tmp_path, "init", "-q", str(top))

    def commit():
        git(top, "add", "-A")
        git(top, "commit", "-qm", "x")

    commit()
    out, held = str(tmp_path / "out"), str(tmp_path / "held")

    def follow():
        """What the stream has told in all, from where it stopped the last time."""
        stream = trees.findings_stream(trees.branch_changes(spark, str(top), "HEAD", "addons"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", held).option("path", out).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(out)

    def batch():
        files = commits.with_contents(commits.list_commits(spark, str(top), ["HEAD"], ["addons"]), str(top))
        rows = trees.file_findings(files).filter("rule IS NOT NULL")
        return sorted(map(tuple, rows.select("path", "rule", "line", "col").collect()))

    def open_now(told):
        change = F.when(F.col("change") == "found", 1).otherwise(-1)
        sums = told.groupBy("path", "rule", "line", "col", "n").agg(F.sum(change).alias("open")).filter("open != 0")
        assert {r.open for r in sums.select("open").distinct().collect()} <= {1}
        return sorted(map(tuple, sums.select("path", "rule", "line", "col").collect()))

    first = follow()
    assert open_now(first) == batch() and first.filter("rule = 'eval-usage'").count() == 3
    (top / "addons/m0/a.py").write_text("def f(self):\n    pass\n")  # mended
    (top / "addons/m1/a.py").write_text("# moved\n" + BAD)  # other lines
    git(top, "rm", "-q", "addons/m2/a.py")  # gone
    (top / "addons/m2/b.py").write_text(BAD)  # new
    commit()
    (top / "addons/m2/c.py").write_text("eval(a)\neval(b)\n")  # a second commit before the stream looks
    commit()
    told = follow()
    assert open_now(told) == batch() and told.filter("change = 'fixed' AND path LIKE '%/m0/a.py'").count() == 2
    assert told.count() == first.count() + 2 + 4 + 2 + 2 + 2
    assert follow().count() == told.count()  # nothing new, nothing told


def test_single_call_findings_are_those_of_the_rules(module, scanned, spark):
    m = module(**{"a.py": BAD + "def g(self):\n    for r in self:\n        r.write({})\n"})
    from healthloom.sources.tree import read_tree

    rows = trees.file_findings(read_tree(spark, [str(m)])).filter("rule IS NOT NULL").collect()
    whole = scanned(m).findings.filter(F.col("rule").isin([r.name for r in REGISTRY.values() if r.when])).collect()
    assert sorted((r.path, r.rule, r.line) for r in rows) == sorted((r.file_path, r.rule, r.line) for r in whole)


def test_first_arrivals(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS place, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:10:00' UNION ALL SELECT 'b', timestamp'2024-01-01 00:05:00'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = health.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["place"])
    q = stream.writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.place for r in spark.table("first").collect()) == ["a", "b"]
