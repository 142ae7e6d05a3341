"""Fixes of manifests: the findings say which files, the text itself says what is missing.

Each file is one row; its fixers run in order on the executors.  Fixers derive
the change from the text, so applying one twice changes nothing.
"""

from __future__ import annotations

import ast
import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import by_value
from ..sources.joined import write_joined
from .rules import REGISTRY

by_value(__name__)

# What a missing key of a manifest is filled with.
DEFAULTS: dict[str, object] = {
    "name": "",
    "version": "1.0.0",
    "depends": ["base"],
    "data": [],
    "installable": True,
    "license": "LGPL-3",
}


def literal(text: str) -> dict | None:
    """The manifest, if it is a literal dictionary."""
    try:
        found = ast.literal_eval(text)
    except (ValueError, SyntaxError, RecursionError, TypeError):
        return None
    return found if isinstance(found, dict) else None


class Edits:
    """Changes of single stretches of a literal dictionary's text; all that lies between them stays, comments too."""

    def __init__(self, text: str):
        self.text = text.encode()
        self.node = ast.parse(text.lstrip("\ufeff"), mode="eval").body if literal(text) is not None else None
        starts = [0]
        for line in self.text.splitlines(keepends=True):
            starts.append(starts[-1] + len(line))
        self.starts = starts
        self.changes: list[tuple[int, int, bytes]] = []

    def span(self, node: ast.AST) -> tuple[int, int]:
        """Where a node begins and ends, in bytes (Python's columns are bytes too)."""
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def replace(self, node: ast.AST, new: bytes) -> None:
        self.changes.append((*self.span(node), new))

    def append(self, lines: list[str]) -> None:
        """New entries, a line each, behind the last one."""
        start, end = self.span(self.node)
        if self.node.values:
            at = self.span(self.node.values[-1])[1]
            comma = b"" if _has_comma(self.text[at : end - 1]) else b","
            self.changes.append((at, at, comma))
        closing = self.text[start : end - 1].rstrip(b" \t")
        new = "".join(f"    {line},\n" for line in lines).encode()
        at = start + len(closing)
        self.changes.append((at, end - 1, (b"" if closing.endswith(b"\n") else b"\n") + new))

    def done(self) -> str:
        out, at = [], 0
        for start, end, new in sorted(self.changes, key=lambda c: c[:2]):
            out += [self.text[at:start], new]
            at = end
        return b"".join([*out, self.text[at:]]).decode()


def _has_comma(between: bytes) -> bool:
    """Whether a comma stands outside of comments."""
    return any(b"," in line.partition(b"#")[0] for line in between.splitlines())


def fill_required(text: str) -> str | None:
    """Missing required keys are added behind the last entry, empty ones get their default.  None: not fixable."""
    edits = Edits(text)
    if edits.node is None:
        return None
    # of a key that is there twice the last one counts
    held = {ast.literal_eval(k): v for k, v in zip(edits.node.keys, edits.node.values)}
    new = []
    for key, default in DEFAULTS.items():
        if key not in held:
            new.append(f"{key!r}: {default!r}")
        elif (value := ast.literal_eval(held[key])) in (None, "") and value != default:
            edits.replace(held[key], repr(default).encode())
    if new:
        edits.append(new)
    return edits.done()


def looks_secure(path: str) -> bool:
    name = path.rpartition("/")[2]
    return "security" in path.split("/") or any(w in name for w in ("ir.model.access", "security", "groups"))


def security_first(text: str) -> str | None:
    """Security files move before the others, both in their order; each name keeps its spelling."""
    edits = Edits(text)
    listed = [v for k, v in zip(edits.node.keys, edits.node.values) if ast.literal_eval(k) == "data"] if edits.node else []
    names = listed[-1].elts if listed and isinstance(listed[-1], ast.List) else []
    if not listed or not isinstance(listed[-1], ast.List) or not all(isinstance(ast.literal_eval(n), str) for n in names):
        return None
    ordered = sorted(names, key=lambda n: not looks_secure(ast.literal_eval(n)))
    for place, name in zip(names, ordered):
        if place is not name:
            start, end = edits.span(name)
            edits.replace(place, edits.text[start:end])
    return edits.done()


FIXERS: dict[str, Callable[[str], str | None]] = {
    "manifest-missing-required-fields": fill_required,
    "manifest-data-order-risk": security_first,
}


def compute_fixes(findings: DataFrame, files: DataFrame, fixers: dict[str, Callable[[str], str | None]] | None = None) -> DataFrame:
    """path, old_text, new_text, fixed, skipped per file: sure findings of fixable rules only.

    ``files``: path, content.
    """
    fixers = FIXERS if fixers is None else fixers
    able = [n for n in fixers if n not in REGISTRY or REGISTRY[n].fixable]
    wanted = findings.filter(F.col("rule").isin(able) & (F.col("confidence") == "high"))
    per_file = wanted.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("seq", "rule"))).alias("todo"))
    rows = files.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("old_text")).join(
        per_file.select("path", F.transform("todo", lambda t: t["rule"]).alias("rules")), "path"
    )

    def apply(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            out = []
            for path, old, rules in zip(batch.path, batch.old_text, batch.rules):
                text, fixed, skipped = old, 0, 0
                for name in rules:
                    try:
                        new = fixers[name](text)
                    except Exception:  # a fixer's fault leaves the file as it is
                        new = None
                    if new is None:
                        skipped += 1
                    else:
                        fixed, text = fixed + (new != text), new
                out.append((path, old, text, fixed, skipped))
            yield pd.DataFrame(out, columns=["path", "old_text", "new_text", "fixed", "skipped"])

    return rows.mapInPandas(apply, "path string, old_text string, new_text string, fixed int, skipped int")


def unified(path: str, old: str, new: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))


def changed_files(fixes: DataFrame) -> DataFrame:
    return fixes.filter("old_text != new_text")


def write_diffs(fixes: DataFrame, path: str) -> None:
    """The changes of all files as one file, in the order of their paths; each is worked out by a task."""

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            yield pd.DataFrame({"path": batch.path, "value": [unified(*r) for r in zip(batch.path, batch.old_text, batch.new_text)]})

    told = changed_files(fixes).select("path", "old_text", "new_text").mapInPandas(run, "path string, value string")
    write_joined(told.orderBy("path").select("value"), path)


def write_fixes(fixes: DataFrame) -> tuple[int, int]:
    """Writes changed files in place, each by the task that holds it; how many are written, how many left alone.

    A file that is not what was read any more is left alone.  A new text appears as a whole; done again after a
    lost task it finds its own text there.
    """

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for batch in source:
            out = []
            for path, old, new in zip(batch.path, batch.old_text, batch.new_text):
                try:
                    with open(path, "rb") as f:
                        now = f.read()
                    if now == old.encode():
                        made = f"{path}.{uuid.uuid4().hex}"
                        with open(made, "wb") as f:
                            f.write(new.encode())
                        os.chmod(made, os.stat(path).st_mode)
                        os.replace(made, path)
                        now = new.encode()
                    out.append(now == new.encode())
                except OSError:
                    out.append(False)
            yield pd.DataFrame({"written": out})

    done = changed_files(fixes).select("path", "old_text", "new_text").mapInPandas(run, "written boolean")
    told = done.agg(F.count_if("written").alias("written"), F.count_if(~F.col("written")).alias("left")).first()
    return told.written, told.left
