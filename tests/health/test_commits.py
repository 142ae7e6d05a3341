"""Commits as tables, facts by content, and completeness of models."""

import random
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from healthloom.cli import base_mean, main
from healthloom.operators import resolve
from healthloom.plans import scan as S
from healthloom.plans.config import Config
from healthloom.sources import commits
from healthloom.sources.store import FactStore, blob_name
from healthloom.sources.tree import read_tree

SOURCE = "class A(models.Model):\n    _name = 'm{k}.thing'\n    p = fields.Many2one('x')\n"
MANIFEST = "{'name': 'M', 'version': '17.0.1.0', 'depends': ['base'], 'data': [], 'license': 'L'}\n"


def git(folder, *args):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture()
def repo(tmp_path):
    top = tmp_path / "repo"
    for k in range(4):
        (top / f"addons/m{k}/models").mkdir(parents=True)
        (top / f"addons/m{k}/__manifest__.py").write_text(MANIFEST)
        (top / f"addons/m{k}/models/a.py").write_text(SOURCE.format(k=k))
    (top / "addons/off").mkdir()
    (top / "addons/off/__manifest__.py").write_text("{'installable': False}")
    (top / "addons/m0/näme ü.xml").write_bytes(b"<root/>")
    (top / "addons/m0/empty.py").write_bytes(b"")
    git(tmp_path, "init", "-q", str(top))
    git(top, "add", ".")
    git(top, "commit", "-qm", "one")
    (top / "addons/m1/models/a.py").write_text(SOURCE.format(k=1) + "x = eval(y)\n")
    (top / "addons/m4").mkdir()
    (top / "addons/m4/__manifest__.py").write_text(MANIFEST)
    git(top, "rm", "-rq", "addons/m3")
    git(top, "add", ".")
    git(top, "commit", "-qm", "two")
    return top


def test_listing_equals_the_worktree(repo, spark):
    disk = {(r.module, r.path, r.rel, r.kind, r.content) for r in read_tree(spark, [str(repo / "addons")]).collect()}
    listed = commits.list_commits(spark, str(repo), ["HEAD"], ["addons"])
    found = commits.with_contents(listed, str(repo)).collect()
    assert {(r.module, r.path, r.rel, r.kind, r.content) for r in found} == disk and len(found) == len(disk) == 9
    names = {r.path: r.digest for r in found}
    assert names[str(repo / "addons/m0/models/a.py")] == git(repo, "rev-parse", "HEAD:addons/m0/models/a.py")
    one = commits.list_commits(spark, str(repo), ["HEAD~1"], ["addons/m3", "addons/none"]).collect()
    assert {r.rel for r in one} == {"__manifest__.py", "models/a.py"} and {r.module for r in one} == {"m3"}
    assert commits.list_commits(spark, str(repo), ["HEAD"], ["addons"], ["m2"]).select("module").distinct().collect() == [("m2",)]
    with pytest.raises(Exception, match="no-such"):
        commits.list_commits(spark, str(repo), ["no-such"], ["addons"]).count()


def test_changes_are_those_of_git(repo, spark):
    both = commits.list_commits(spark, str(repo), ["HEAD~1", "HEAD"], ["addons"])
    found = {(r.path.removeprefix(f"{repo}/"), r.change[0].upper()) for r in commits.changes(both, "HEAD~1", "HEAD").collect()}
    told = {(line[2:], {"M": "E", "D": "R"}.get(line[0], line[0])) for line in git(repo, "diff", "--name-status", "--no-renames", "HEAD~1", "HEAD").splitlines()}
    assert found == told and len(found) == 4


def test_names_of_contents(spark):
    rows = spark.createDataFrame([(b"",), (b"a\0b",), ("é\n".encode(),)], "content binary")
    for r in rows.select("content", blob_name(F.col("content")).alias("name")).collect():
        want = subprocess.run(["git", "hash-object", "--stdin"], input=bytes(r.content), capture_output=True).stdout.decode().strip()
        assert r.name == want


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_scan_of_commits_equals_scan_of_trees(repo, spark, tmp_path):
    config = Config(ignore_files=[])
    whole = S.scan(spark, [str(repo / "addons")], config)
    store = str(tmp_path / "store")
    done = S.scan_commits(spark, str(repo), ["HEAD~1", "HEAD"], config, paths=["addons"], store=store)
    columns = ("module", "file_path", "line", "rule", "message", "eligible")
    assert rows_of(done["HEAD"].findings, *columns) == rows_of(whole.findings, *columns)
    assert rows_of(done["HEAD"].scores, "module", "overall") == rows_of(whole.scores, "module", "overall")
    held = FactStore(spark, store)
    # one manifest text, four modules and one edit, the empty file, the odd name
    assert held.known().count() == 1 + 5 + 1 + 1
    again = S.scan(spark, [str(repo / "addons")], config, store=store)
    assert rows_of(again.findings, *columns) == rows_of(whole.findings, *columns) and held.known().count() == 8
    assert len(list(Path(held.place).glob("batch=*"))) == 1


def test_one_changed_file_is_parsed_alone(spark, tmp_path):
    for k in range(250):
        (tmp_path / f"t/m{k}").mkdir(parents=True)
        (tmp_path / f"t/m{k}/__manifest__.py").write_text(MANIFEST.replace("'M'", f"'M{k}'"))
        for part in "abc":
            (tmp_path / f"t/m{k}/{part}.py").write_text(SOURCE.format(k=k) + f"# {part}\n")
    source = S.tree_source(spark, [str(tmp_path / "t")])
    held = FactStore(spark, str(tmp_path / "store"))
    held.fill(source.listing, source.contents)
    assert held.added == 1000
    held.fill(source.listing, source.contents)
    assert held.added == 0
    (tmp_path / "t/m7/b.py").write_text(SOURCE.format(k=7) + "eval(x)\n")
    held.fill(source.listing, source.contents)
    assert held.added == 1
    from healthloom.sources.parsed import Facts

    plain = Facts(source.files)
    assert rows_of(held.facts(source.listing), "path", "fact", "n", "line", "d_model", "d_call") == rows_of(plain.facts, "path", "fact", "n", "line", "d_model", "d_call")


def test_a_file_that_changes_meanwhile_is_not_kept_under_its_old_name(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/__manifest__.py").write_text(MANIFEST)
    (tmp_path / "m/a.py").write_text("eval(x)\n")
    source = S.tree_source(spark, [str(tmp_path / "m")])
    listing = spark.createDataFrame(source.listing.collect(), source.listing.schema)
    (tmp_path / "m/a.py").write_text("x = 1\n")
    held = FactStore(spark, str(tmp_path / "store"))
    held.fill(listing, source.contents)
    assert [r.kind for r in held.known().collect()] == ["manifest"]
    assert {r.fact for r in held.facts(listing).collect()} == {"manifest"}


def test_facts_are_read_by_kind(module, spark):
    from healthloom.sources.parsed import Facts
    from healthloom.sources.tree import read_tree

    facts = Facts(read_tree(spark, [str(module(**{"a.py": "eval(x)\n"}))])).settle()
    plan = facts.of("call").select("name")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fact" in plan and "(fact" in plan.partition("PartitionFilters")[2][:80] and "= call)" in plan
    read = plan.partition("ReadSchema:")[2].partition(">")[0]
    assert "d_call" in read and "d_model" not in read
    place = facts.places[0]
    assert Path(place.removeprefix("file://").removeprefix("file:")).exists()
    facts.release()
    assert not Path(place.removeprefix("file://").removeprefix("file:")).exists()


def test_written_commit_is_sound(spark, tmp_path):
    rows = [("b", "x/y/z.py", b"1"), ("b", "x.py", b"2"), ("b", "x/a.py", None), ("b", "__manifest__.py", MANIFEST.encode()), ("a", "__manifest__.py", MANIFEST.encode())]
    df = spark.createDataFrame(rows, "module string, rel string, content binary")
    repo = str(tmp_path / "r.git")
    first = commits.write_commit(df, repo, "main")
    second = commits.write_commit(df.filter("module = 'b'"), repo, "main")
    assert git(repo, "fsck", "--strict") == "" and git(repo, "rev-list", "main").split() == [second, first]
    assert git(repo, "ls-tree", "-r", "--name-only", first).split() == ["a/__manifest__.py", "b/__manifest__.py", "b/x.py", "b/x/a.py", "b/x/y/z.py"]
    listed = commits.with_contents(commits.list_commits(spark, repo, [second]), repo)
    assert {(r.rel, bytes(r.content)) for r in listed.collect()} == {(rel, c or b"") for m, rel, c in rows if m == "b"}


def test_base_score_needs_no_worktree(repo, spark):
    here = [str(repo / "addons")]
    base = base_mean(spark, here, Config(ignore_files=[]), None, "HEAD~1")
    tree = S.scan_commits(spark, str(repo), ["HEAD~1"], Config(ignore_files=[]), paths=["addons"])["HEAD~1"]
    assert base == pytest.approx(tree.scores.agg(F.avg("overall")).first()[0])
    assert git(repo, "worktree", "list").count("\n") == 0
    assert base_mean(spark, here, Config(), None, "no-such") is None
    assert base_mean(spark, ["/tmp"], Config(), None, "HEAD") is None


def test_command_tells_the_delta(repo, capsys, spark):
    assert main(["scan", str(repo / "addons"), "--no-linters", "--score-delta", "HEAD~1"]) == 0
    assert "Score delta: " in capsys.readouterr().out


# --- completeness ----------------------------------------------------------------------------


def brute_complete(edges, leaves):
    """A walk up from each model that may meet nothing twice."""
    parents = {}
    for m, p in edges:
        parents.setdefault(m, [])
        if p is not None and p != m:
            parents[m].append(p)
    out = {m: c for m, c in leaves.items() if m not in parents}

    def walk(m):
        seen, todo = set(), [m]
        while todo:
            x = todo.pop()
            if x in seen or x not in parents and not leaves.get(x, False):
                return False
            seen.add(x)
            todo.extend(parents.get(x, ()))
        return True

    return out | {m: walk(m) for m in parents}


def complete(spark, edges, leaves):
    df = spark.createDataFrame(edges, "model string, parent string")
    outside = spark.createDataFrame(list(leaves.items()), "model string, complete boolean")
    return {r.model: r.complete for r in resolve.complete_models(df, outside).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_completeness_equals_walks(spark, seed):
    rnd = random.Random(seed)
    edges = []
    for k in range(80):
        many = rnd.choice([0, 1, 1, 1, 1, 2, 3])
        # mostly upward, sometimes a cycle, a repeated parent, an unknown or an outside one
        own = [rnd.choice([f"m{rnd.randrange(max(1, k))}", f"m{rnd.randrange(80)}" if rnd.random() < 0.2 else f"m{k // 2}", f"x{rnd.randrange(4)}"]) for _ in range(many)]
        edges += [(f"m{k}", p) for p in own] or [(f"m{k}", None)]
    leaves = {"x0": True, "x1": True, "x2": False, "m3": True}
    assert complete(spark, edges, leaves) == brute_complete(edges, leaves)


def test_a_long_chain_and_made_frames(spark):
    n = 20_000
    i = F.col("id")
    # both columns come from one frame, as a frame made by code has them
    edges = spark.range(n).select(i.cast("string").alias("model"), F.when(i > 0, (i - 1).cast("string")).alias("parent"))
    found = resolve.complete_models(edges, spark.createDataFrame([], "model string, complete boolean"))
    assert found.groupBy("complete").count().collect() == [(True, n)]
    none = spark.createDataFrame([], "model string, parent string")
    assert resolve.complete_models(none, spark.createDataFrame([("a", True)], "model string, complete boolean")).collect() == [("a", True)]


def test_trees_are_read_as_git_lists_them(repo):
    blobs = commits.Blobs(str(repo))
    try:
        top = git(repo, "rev-parse", "HEAD^{tree}")
        listed = [(path, name) for kind, name, path in commits.entries(str(repo), top, "-r") if kind == "blob"]
        assert list(blobs.files(top)) == listed and len(listed) > 8
        with pytest.raises(ValueError):
            list(blobs.files("0" * 40))
    finally:
        blobs.close()


def test_keys_that_many_share_meet_evenly(spark, monkeypatch):
    monkeypatch.setattr(resolve, "MANY", 3)
    rows = spark.createDataFrame([(k, "hot" if k < 9 else "few" if k < 11 else "lost" if k < 15 else None) for k in range(20)], "node int, head string")
    told = spark.createDataFrame([("hot", "a", True), ("few", "b", False), ("else", "c", True), (None, "d", True)], "head string, further string, open boolean")
    plain = rows.join(told, "head", "left")
    made = resolve.met_evenly(rows, told, "head", resolve.Tables(spark, "even"))
    assert made.columns == plain.columns and sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
    names = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(30)] + [("d", "c0"), ("d", "x"), ("e", "c4"), ("e", "c9"), ("r", "s"), ("s", "r")]
    edges = spark.createDataFrame(names, "model string, parent string")
    told = {r.model: r.complete for r in resolve.complete_models(edges, spark.createDataFrame([("x", True)], "model string, complete boolean")).collect()}
    assert told == {**{f"c{k}": True for k in range(30)}, "d": True, "e": False, "r": False, "s": False, "x": True}


def test_a_commit_is_written_in_a_pack_for_each_task(tmp_path, spark):
    """No file for each object; a later commit adds what is new and nothing else; git finds no fault."""
    place = str(tmp_path / "r.git")
    rows = [(f"m{k}", rel, body) for k in range(300) for rel, body in (("__manifest__.py", MANIFEST.encode()), ("models/a.py", SOURCE.format(k=k).encode() * (k % 40)), ("none.py", None))]
    first = commits.write_commit(spark.createDataFrame(rows, "module string, rel string, content binary"), place, "main")
    in_packs = lambda: int(git(place, "count-objects", "-v").split("in-pack: ")[1].split()[0])
    objects = Path(place, "objects")
    assert sum(len(list(p.iterdir())) for p in objects.iterdir() if len(p.name) == 2) <= 2  # the commit and the tree on top
    assert len(list(objects.glob("pack/*.pack"))) <= 4 * spark.sparkContext.defaultParallelism
    before, edited = in_packs(), [(m, rel, b"new\n" if m == "m7" and rel == "none.py" else body) for m, rel, body in rows]
    second = commits.write_commit(spark.createDataFrame(edited, "module string, rel string, content binary"), place, "main")
    assert in_packs() == before + 2
    assert git(place, "diff", "--name-only", first, second) == "m7/none.py"
    assert git(place, "fsck", "--strict") == ""
    assert git(place, "show", f"{first}:m39/models/a.py") == (SOURCE.format(k=39) * 39).strip()


def test_folders_are_shared_by_a_bounded_number_of_tasks():
    assert commits.share(10, 64, 4096) == 64 and commits.share(720_000, 64, 4096) == 2813 and commits.share(10**9, 64, 4096) == 4096
