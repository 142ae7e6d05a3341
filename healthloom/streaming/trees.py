"""A branch as a stream: what each new commit changes, and the findings that come and go with it.

``branch_changes`` is a streaming source whose offset is a commit.  The driver
asks git what differs between two commits (names only); executors read the
blobs.  A file that is gone has null contents.

``findings_stream`` parses changed files as a scan does and keeps, for each
path, the findings that it has now.  A change gives a row for each finding that
is new (``found``) and for each that is not there any more (``fixed``); a file
that is gone loses all.  Added up, the rows are the findings of the last commit,
as a scan of it has them.  State holds what paths with findings have, so it grows with
the findings that are open, not with the history.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shipping import by_value
from ..plans.rules import REGISTRY
from ..sources import tree
from ..sources.commits import Blobs, git, share
from ..sources.parsed import HEAD, parse_files, typed

by_value(__name__)

CHANGED = "commit string, module string, module_dir string, module_ord int, path string, rel string, kind string, content binary"
#: Fixed value: the name of the tree without files, which every repository knows.
NOTHING = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: Files that one task reads at least, and at most.
FILES, MOST_FILES = 256, 16384

class Changed(InputPartition):
    def __init__(self, commit: str, files: list[tuple[str, str]]):
        super().__init__(0)
        self.commit, self.files = commit, files


class BranchReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.repo, self.branch, self.top = options["repo"], options["branch"], options.get("top", ".")

    def initialOffset(self) -> dict:
        return {"commit": NOTHING}

    def latestOffset(self) -> dict:
        return {"commit": git(self.repo, "rev-parse", f"{self.branch}^{{commit}}").decode().strip()}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        if start["commit"] == end["commit"]:
            return []
        # :mode mode name name status NUL path NUL ...
        parts = git(self.repo, "diff-tree", "-r", "-z", "--no-renames", start["commit"], end["commit"]).split(b"\0")
        files = []
        for head, path in zip(parts[::2], parts[1::2]):
            new = head.split()[3].decode()
            files.append((path.decode("utf-8", "surrogateescape"), "" if new.strip("0") == "" else new))
        inside = "" if self.top == "." else f"{self.top.rstrip('/')}/"
        files = [(p, n) for p, n in files if p.startswith(inside) and "/" in p[len(inside) :]]
        step = share(len(files), FILES, MOST_FILES)
        return [Changed(end["commit"], files[k : k + step]) for k in range(0, len(files), step)]

    def read(self, partition: Changed) -> Iterator[tuple]:
        blobs = Blobs(self.repo)
        inside = "" if self.top == "." else f"{self.top.rstrip('/')}/"
        try:
            for path, name in partition.files:
                module, _, rel = path[len(inside) :].partition("/")
                kind = tree.kind_of(rel)
                content = blobs.read(name) if name and kind != "other" else None
                folder = os.path.join(self.repo, inside + module)
                yield partition.commit, module, folder, 0, os.path.join(folder, rel), rel, kind, content
        finally:
            blobs.close()

    def commit(self, end: dict) -> None:
        pass


class BranchChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "branch_changes"

    def schema(self) -> str:
        return CHANGED

    def streamReader(self, schema) -> BranchReader:
        return BranchReader(self.options)


def branch_changes(spark: SparkSession, repo: str, branch: str = "HEAD", top: str = ".") -> DataFrame:
    """The files in module folders right below ``top`` that new commits of a branch change."""
    spark.dataSource.register(BranchChanges)
    return spark.readStream.format("branch_changes").options(repo=repo, branch=branch, top=top).load()


FOUND = "module string, path string, rule string, line int, col int, n int"


def file_findings(files: DataFrame) -> DataFrame:
    """The findings of rules that look at single calls, and a row without a rule for each file besides.

    Works on tables and on streams: files are parsed and conditions are told in one pass.
    """
    calls = [r for r in REGISTRY.values() if r.when]
    facts = typed(parse_files(files.withColumn("content", F.coalesce("content", F.lit(b""))), HEAD, mark="parsed"))
    rows = facts.filter(F.col("fact").isin("call", "parsed")).select("module", "path", "line", "col", "n", "fact", "d_call.*")
    met = F.array(*[F.when((F.col("fact") == "call") & F.expr(r.when), F.lit(r.name)) for r in calls], F.when(F.col("fact") == "parsed", F.lit("")))
    told = rows.select("module", "path", F.explode(F.filter(met, lambda x: x.isNotNull())).alias("rule"), "line", "col", "n")
    return told.select("module", "path", F.nullif("rule", F.lit("")).alias("rule"), "line", "col", "n")


def findings_stream(changed: DataFrame) -> DataFrame:
    """module, path, rule, line, col, n, change (found, fixed): what each batch of changed files adds and takes away."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        module, path = key
        now = set()
        for batch in batches:
            held = batch[batch.rule.notna()]
            now |= {(r, int(x), int(c), int(n)) for r, x, c, n in zip(held.rule, held.line, held.col, held.n)}
        before = {tuple(x) for x in json.loads(state.get[0])} if state.exists else set()
        if now:
            state.update((json.dumps(sorted(now)),))
        elif state.exists:
            state.remove()
        told = [(module, path, *x, "found") for x in sorted(now - before)] + [(module, path, *x, "fixed") for x in sorted(before - now)]
        if told:
            yield pd.DataFrame(told, columns=["module", "path", "rule", "line", "col", "n", "change"])

    # calls are found in Python files only: other files' paths need no state
    return file_findings(changed.filter("kind = 'python'")).groupBy("module", "path").applyInPandasWithState(
        update, f"{FOUND}, change string", "open string", "append", GroupStateTimeout.NoTimeout
    )
