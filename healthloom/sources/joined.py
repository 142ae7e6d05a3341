"""One text file from the rows of a table, written by the executors.

Each task writes its rows to a part beside the target; when all tasks are done
the parts are joined in the order of their partitions, between ``head`` and
``tail``, and the file appears under its name as a whole.  So sorted rows make a
sorted file, no row passes through the driver's memory, and a task that fails
leaves no half file: its part goes, and without a commit all parts go.

The target must be in a place that the driver and all executors can open.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.shipping import by_value

by_value(__name__)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class JoinedWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target = options["target"]
        self.head, self.between, self.tail = (options.get(k, "") for k in ("head", "between", "tail"))
        self.folder = f"{self.target}.parts-{options['run']}"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        number, rows = TaskContext.get().partitionId(), 0
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{number}-{uuid.uuid4().hex}")  # attempts don't meet
        try:
            with open(path, "w", encoding="utf-8", newline="") as f:
                for row in iterator:
                    f.write(self.between if rows else "")
                    f.write(row[0])
                    rows += 1
        except BaseException:
            os.unlink(path)
            raise
        return Part(number, path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        made = f"{self.folder}/joined"
        os.makedirs(self.folder, exist_ok=True)
        with open(made, "wb") as out:
            out.write(self.head.encode())
            some = False
            for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.number):
                out.write(self.between.encode() if some else b"")
                some = True
                with open(part.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(self.tail.encode())
        os.replace(made, self.target)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class JoinedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "joined_text"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> JoinedWriter:
        return JoinedWriter(self.options)


def write_joined(lines: DataFrame, path: str, head: str = "", between: str = "", tail: str = "") -> None:
    """``lines`` (one column of texts without nulls, sorted if the order matters) as one file that takes the place of ``path``."""
    spark = lines.sparkSession
    spark.dataSource.register(JoinedText)
    options = {"target": str(Path(path).absolute()), "head": head, "between": between, "tail": tail, "run": uuid.uuid4().hex}
    lines.write.format("joined_text").options(**options).mode("append").save()
