"""Source trees as tables.

Spark's file sources hide names that start with an underscore, and every
module is told by such a file.  ``module_tree`` is therefore a data source of
its own.  The driver lists the folders right below the given paths, by name.
Executors do the rest, a task for each few folders: they read the manifest,
leave out what is no module, walk the folder and read its files.

Columns: module, module_dir, module_ord, path (absolute), rel (inside the
module), kind (manifest, python, xml, access, other), content (null for
``other``: only the name matters there, and where a file could not be opened).
Executors open the files themselves, so a tree must be in a place that all of
them see.
"""

from __future__ import annotations

import ast
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shipping import by_value

by_value(__name__)

#: The file that makes a folder a module, and the place of its access rules.
MANIFEST = "__manifest__.py"
ACCESS = "security/ir.model.access.csv"

SCHEMA = "module string, module_dir string, module_ord int, path string, rel string, kind string, content binary"
#: Module folders that one task lists and reads.
FOLDERS = 32


def read_bytes(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def says_installable(raw: bytes | None) -> bool:
    """Whether a manifest is a dictionary that does not switch its module off."""
    if raw is None:
        return False
    try:
        found = ast.literal_eval(raw.decode("utf-8", "replace"))
    except (SyntaxError, ValueError, RecursionError, TypeError, MemoryError):
        return False
    return isinstance(found, dict) and bool(found.get("installable", True))


def module_folders(paths: list[str], targets: list[str]) -> list[str]:
    """A path that is a module itself, else its direct children, in order.  Nothing but names is looked at."""
    found = []
    for base in map(os.path.abspath, paths):
        own = os.path.join(base, MANIFEST)
        if os.path.exists(own):
            folders = [base]
        elif os.path.isdir(base):
            folders = [os.path.join(base, n) for n in sorted(os.listdir(base))]
        else:
            continue
        for folder in folders:
            name = os.path.basename(folder)
            if not targets or name in targets:
                found.append(folder)
    return found


def kind_of(rel: str) -> str:
    name = rel.rpartition("/")[2]
    if rel == MANIFEST:
        return "manifest"
    if name.endswith(".py") and not name.startswith("__"):
        return "python"
    if name.endswith(".xml"):
        return "xml"
    return "access" if rel == ACCESS else "other"


class Folders(InputPartition):
    def __init__(self, folders: list[tuple[int, str]]):
        super().__init__(0)
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.targets = json.loads(options.get("targets", "[]"))

    def partitions(self) -> list[Folders]:
        folders = list(enumerate(module_folders(self.paths, self.targets)))
        return [Folders(folders[k : k + FOLDERS]) for k in range(0, max(1, len(folders)), FOLDERS)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for ord_, folder in partition.folders:
            if not says_installable(read_bytes(os.path.join(folder, MANIFEST))):
                continue
            for top, dirs, names in os.walk(folder):
                dirs.sort()
                for name in sorted(names):
                    path = os.path.join(top, name)
                    rel = os.path.relpath(path, folder).replace(os.sep, "/")
                    kind = kind_of(rel)
                    content = None if kind == "other" else read_bytes(path)
                    # a file that can't be opened keeps its row: ``Facts.unreadable`` names it
                    yield os.path.basename(folder), folder, ord_, path, rel, kind, content


class ModuleTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "module_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def with_contents(rows: DataFrame) -> DataFrame:
    """``rows`` (with kind and path) and ``content``, as the files have it now."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                asked = zip(part.column("kind").to_pylist(), part.column("path").to_pylist())
                found = pa.array([None if kind == "other" else read_bytes(path) for kind, path in asked], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "content"])

    return rows.mapInArrow(run, schema)


def read_tree(spark: SparkSession, paths: list[str], targets: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ModuleTree)
    return (
        spark.read.format("module_tree").option("paths", json.dumps(paths)).option("targets", json.dumps(targets or [])).load()
    )
