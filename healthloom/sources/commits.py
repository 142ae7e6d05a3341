"""Module trees of commits as tables, without a worktree.

The driver asks git for the folders right below the given paths and nothing
deeper.  Executors list those folders, judge their manifests and, later, read
blobs by name with one ``git cat-file`` for a task.  So the repository must be
in a place that all executors see.

Columns of a listing: commit, those of ``module_tree`` but the content, and
digest, the blob's name, which is also the content's name in the fact store.
Paths are those that the files have in the repository's working tree, so the
findings of two commits can be compared.

``write_commit`` goes the other way: a table of files becomes a commit.  Blobs
and the trees of modules are written on the executors, one pack for a task with
what the repository lacks; the driver adds the tree on top, a line per module.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shipping import by_value
from ..session import spread
from . import tree

by_value(__name__)

LISTED = "commit string, module string, module_dir string, module_ord int, path string, rel string, kind string, digest string"
#: Folders that one task lists at least, and at most; between them about ``TASKS`` tasks share them.
FOLDERS, MOST_FOLDERS = 64, 4096
TASKS = 256


def git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=given, capture_output=True)
    if done.returncode:
        raise ValueError(f"git {' '.join(args)}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def entries(repo: str, named: str, *options: str) -> Iterator[tuple[str, str, str]]:
    """(kind of object, its name, path) in a tree."""
    for line in git(repo, "ls-tree", "-z", *options, named).split(b"\0"):
        if line:
            head, path = line.decode("utf-8", "surrogateescape").split("\t", 1)
            _, kind, name = head.split()
            yield kind, name, path


class Blobs:
    """Contents and trees by name, from one ``git cat-file``; None if there is no such blob."""

    def __init__(self, repo: str, mode: str = "--batch"):
        self.repo = repo
        self.pipe = subprocess.Popen(["git", "-C", repo, "cat-file", mode], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def object(self, name: str) -> tuple[bytes, bytes]:
        """Kind and body; the kind is ``missing`` if there is no such object."""
        self.pipe.stdin.write(name.encode() + b"\n")
        self.pipe.stdin.flush()
        head = self.pipe.stdout.readline().split()
        if len(head) != 3:
            return b"missing", b""
        return head[1], self.pipe.stdout.read(int(head[2]) + 1)[:-1]

    def has(self, name: str) -> bool:
        """Whether there is such an object (with ``--batch-check``)."""
        self.pipe.stdin.write(name.encode() + b"\n")
        self.pipe.stdin.flush()
        return len(self.pipe.stdout.readline().split()) == 3

    def read(self, name: str) -> bytes | None:
        kind, body = self.object(name)
        return body if kind == b"blob" else None

    def files(self, tree: str, top: str = "") -> Iterator[tuple[str, str]]:
        """(path, name) of the blobs of a tree and of those below it, in git's order."""
        kind, body = self.object(tree)
        if kind != b"tree":
            raise ValueError(f"{tree} is no tree of {self.repo}")
        length, at = len(tree) // 2, 0
        while at < len(body):
            middle = body.index(b"\0", at)
            mode, _, raw = body[at:middle].partition(b" ")
            at = middle + 1 + length
            path, name = top + raw.decode("utf-8", "surrogateescape"), body[middle + 1 : at].hex()
            if mode in (b"40000", b"040000"):
                yield from self.files(name, path + "/")
            elif mode != b"160000":  # a submodule's commit is not in this repository
                yield path, name

    def close(self) -> None:
        self.pipe.stdin.close()
        self.pipe.stdout.close()
        self.pipe.wait()


def share(n: int, least: int, most: int) -> int:
    """How many of n things one task takes: a task costs a Python worker's start and a git process."""
    return min(most, max(least, -(-n // TASKS)))


class Folders(InputPartition):
    def __init__(self, folders: list[tuple[str, str, int, str]]):
        super().__init__(0)
        self.folders = folders


class CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options["repo"]
        self.commits, self.paths, self.targets = (json.loads(options[k]) for k in ("commits", "paths", "targets"))

    def partitions(self) -> list[Folders]:
        top = git(self.repo, "rev-parse", "--show-toplevel").decode().strip() if os.path.exists(os.path.join(self.repo, ".git")) else self.repo
        found = []
        for commit in self.commits:
            git(self.repo, "rev-parse", "--verify", f"{commit}^{{commit}}")
            known, ord_ = set(), 0
            for path in self.paths:
                try:
                    below = list(entries(self.repo, f"{commit}:{'' if path == '.' else path}"))
                except ValueError:  # no such folder in that commit
                    continue
                if any(name == tree.MANIFEST for _, _, name in below):
                    below = [("tree", git(self.repo, "rev-parse", f"{commit}:{path}").decode().strip(), "")]
                for kind, name, below_path in sorted(below, key=lambda e: e[2]):
                    folder = os.path.normpath(os.path.join(top, path, below_path))
                    if kind == "tree" and folder not in known and (not self.targets or os.path.basename(folder) in self.targets):
                        known.add(folder)
                        found.append((commit, name, ord_, folder))
                        ord_ += 1
        step = share(len(found), FOLDERS, MOST_FOLDERS)
        return [Folders(found[k : k + step]) for k in range(0, max(1, len(found)), step)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        blobs = Blobs(self.repo)
        try:
            for commit, name, ord_, folder in partition.folders:
                files = list(blobs.files(name))
                manifest = dict(files).get(tree.MANIFEST)
                if manifest is None or not tree.says_installable(blobs.read(manifest)):
                    continue
                for rel, blob in files:
                    kind = tree.kind_of(rel)
                    yield commit, os.path.basename(folder), folder, ord_, os.path.join(folder, rel), rel, kind, blob
        finally:
            blobs.close()


class CommitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> CommitReader:
        return CommitReader(self.options)


def list_commits(spark: SparkSession, repo: str, commits: list[str], paths: list[str] | None = None, targets: list[str] | None = None) -> DataFrame:
    """The files of installable modules in each commit (``paths``: folders inside the repository)."""
    spark.dataSource.register(CommitTree)
    options = {"repo": repo, "commits": json.dumps(commits), "paths": json.dumps(paths or ["."]), "targets": json.dumps(targets or [])}
    return spark.read.format("commit_tree").options(**options).load()


def with_contents(rows: DataFrame, repo: str) -> DataFrame:
    """``rows`` (with kind and digest) and ``content``: the blobs, but null where only the name matters."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = Blobs(repo)
        try:
            for batch in source:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    asked = zip(part.column("kind").to_pylist(), part.column("digest").to_pylist())
                    found = pa.array([None if kind == "other" else blobs.read(name) for kind, name in asked], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "content"])
        finally:
            blobs.close()

    return rows.mapInArrow(run, schema)


def changes(listing: DataFrame, before: str, after: str) -> DataFrame:
    """path, change (added, removed, edited) of what differs between two commits of a listing."""
    side = lambda commit, name: listing.filter(F.col("commit") == commit).select("path", F.col("digest").alias(name))
    both = side(before, "old").join(side(after, "new"), "path", "full").filter("NOT (old <=> new)")
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("edited").alias("change"))


# --- a commit from a table -------------------------------------------------------------------


#: How a pack marks the kinds of objects.
PACKED = {"tree": 2, "blob": 3}


class Pack:
    """Objects on their way into a repository as one pack; git names it, and shows it when it is whole.

    ``held``: names that the repository may have already are asked for, and what it has is left out.
    """

    def __init__(self, repo: str, held: bool):
        self.repo, self.names, self.body = repo, set(), tempfile.TemporaryFile()
        self.known = Blobs(repo, "--batch-check") if held else None

    def put(self, kind: str, body: bytes) -> bytes:
        name = hashlib.sha1(f"{kind} {len(body)}".encode() + b"\0" + body).digest()
        if name not in self.names and not (self.known and self.known.has(name.hex())):
            self.names.add(name)
            size, head = len(body) >> 4, [PACKED[kind] << 4 | len(body) & 15]
            while size:
                head[-1] |= 128
                head.append(size & 127)
                size >>= 7
            self.body.write(bytes(head) + zlib.compress(body, 1))
        return name

    def close(self) -> None:
        if self.known:
            self.known.close()
        if self.names:
            pipe = subprocess.Popen(["git", "-C", self.repo, "index-pack", "--stdin"], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL)
            head = b"PACK" + struct.pack(">II", 2, len(self.names))
            digest = hashlib.sha1(head)
            pipe.stdin.write(head)
            self.body.seek(0)
            while part := self.body.read(1 << 20):
                digest.update(part)
                pipe.stdin.write(part)
            pipe.stdin.write(digest.digest())
            pipe.stdin.close()
            if pipe.wait():
                raise ValueError(f"git index-pack failed in {self.repo}")
        self.body.close()


def tree_object(pack: Pack, files: dict[str, bytes]) -> bytes:
    """Blobs and trees of the files of one folder (relative path -> content); the name of its tree."""
    below: dict[str, dict[str, bytes]] = {}
    lines = []
    for rel, content in files.items():
        head, _, rest = rel.partition("/")
        if rest:
            below.setdefault(head, {})[rest] = content
        else:
            lines.append((head.encode(), b"100644 " + head.encode() + b"\0" + pack.put("blob", content)))
    for head, inside in below.items():  # git sorts folders as if their names ended in a slash
        lines.append((head.encode() + b"/", b"40000 " + head.encode() + b"\0" + tree_object(pack, inside)))
    return pack.put("tree", b"".join(line for _, line in sorted(lines)))


def write_commit(files: DataFrame, repo: str, branch: str, message: str = "written from a table") -> str:
    """``files`` (module, rel, content; null: empty) as the next commit of a branch; the commit's name.

    ``repo`` is a bare repository (made if there is none) that all executors can write to.
    """
    held = os.path.exists(os.path.join(repo, "objects"))
    if not held:
        os.makedirs(repo, exist_ok=True)
        git(repo, "init", "-q", "--bare", ".")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, told, module, inside = Pack(repo, held), [], None, {}
        for batch in source:
            for name, rel, content in zip(*(batch.column(c).to_pylist() for c in ("module", "rel", "content"))):
                if name != module and inside:
                    told.append((module, tree_object(pack, inside).hex()))
                    inside = {}
                module = name
                inside[rel] = content or b""
        if inside:
            told.append((module, tree_object(pack, inside).hex()))
        pack.close()  # a tree is told when it is in the repository
        for at in range(0, len(told), 10_000):
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*told[at : at + 10_000])], names=["module", "tree"])

    rows = spread(files.select("module", "rel", "content"), "module").sortWithinPartitions("module")
    trees = rows.mapInArrow(run, "module string, tree string")
    top = "".join(f"040000 tree {r.tree}\t{r.module}\n" for r in trees.collect())  # git sorts them
    named = git(repo, "mktree", given=top.encode()).decode().strip()
    last = subprocess.run(["git", "-C", repo, "rev-parse", "-q", "--verify", f"refs/heads/{branch}"], capture_output=True).stdout.decode().strip()
    who = ["-c", "user.name=healthloom", "-c", "user.email=healthloom@localhost"]
    commit = git(repo, *who, "commit-tree", named, "-m", message, *(["-p", last] if last else [])).decode().strip()
    git(repo, "update-ref", f"refs/heads/{branch}", commit)
    return commit
