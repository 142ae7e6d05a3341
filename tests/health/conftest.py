import textwrap
from pathlib import Path

import pytest

from healthloom.operators import resolve
from healthloom.plans import scan as S
from healthloom.plans.config import Config
from healthloom.plans.rules import Project, findings_of
from healthloom.plans.rules import REGISTRY
from healthloom.sources.parsed import Facts
from healthloom.sources.tree import read_tree

MANIFEST = "{'name': 'M', 'version': '17.0.1.0', 'depends': ['base'], 'data': [%s], 'installable': True, 'license': 'LGPL-3'}\n"


@pytest.fixture()
def module(tmp_path):
    """Writes a module: keyword ``files`` of relative path -> text."""

    def write(name: str = "mod", manifest: str | None = None, **files: str) -> Path:
        folder = tmp_path / name
        listed = [f"'{k}'" for k in files if k.endswith(".xml")]
        files["__manifest__.py"] = manifest if manifest is not None else MANIFEST % ", ".join(listed)
        for rel, text in files.items():
            path = folder / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text) if isinstance(text, bytes) else path.write_text(textwrap.dedent(text), encoding="utf-8")
        return folder

    return write


@pytest.fixture()
def rows_of(spark):
    """(file name, line) of a rule's findings over module folders."""

    def run(rule: str, *folders, stubs: resolve.Stubs | None = None, column: str | None = None, version: str = "17.0"):
        facts = Facts(read_tree(spark, [str(f) for f in folders]).persist())
        found = findings_of(REGISTRY[rule], Project(facts, version, stubs))
        if column:
            return sorted(r[0] for r in found.select(column).collect())
        return sorted((r.file_path.rpartition("/")[2], r.line) for r in found.collect())

    return run


@pytest.fixture()
def scanned(spark):
    def run(*folders, config: Config | None = None, **more) -> S.ScanResult:
        return S.scan(spark, [str(f) for f in folders], config or Config(), **more)

    return run
