"""Configuration: TOML files from a folder upwards, the nearest one winning."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.findings import Surface

FILE = "healthloom.toml"
LEVELS = 20


@dataclass
class Config:
    version: str | None = None
    addons_paths: list[str] = field(default_factory=lambda: ["."])
    target_modules: list[str] = field(default_factory=list)
    source_path: str = ""
    stubs_path: str | None = None
    min_score: float = 0
    capabilities: list[str] = field(default_factory=list)
    capability_prefix: str = "version"
    plugins: bool = False
    linters: dict[str, bool] = field(default_factory=lambda: {"ruff": True, "pylint-odoo": True})
    severity: dict[str, str] = field(default_factory=dict)
    ignore_rules: list[str] = field(default_factory=list)
    ignore_files: list[str] = field(default_factory=list)
    ignore_modules: list[str] = field(default_factory=list)
    category_weights: dict[str, float] = field(default_factory=dict)
    surfaces: dict[str, Surface] = field(default_factory=dict)


def merged(outer: dict, inner: dict) -> dict:
    """``inner`` over ``outer``, tables merged key by key."""
    out = dict(outer)
    for key, value in inner.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


def load_config(folder: str | Path, name: str = FILE) -> Config:
    top = Path(folder).resolve()
    raw: dict = {}
    for place in reversed([top, *top.parents][:LEVELS]):
        if (place / name).is_file():
            raw = merged(raw, tomllib.loads((place / name).read_text(encoding="utf-8")))
    return build_config(raw)


def build_config(raw: dict) -> Config:
    """Sections: main, linters, severity, ignore, category_weights, surfaces, plugins."""
    main, ignore = raw.get("main", {}), raw.get("ignore", {})
    held = Config()
    surfaces = {"pr_comment": {}, "ci_failure": {"min_confidence": "high"}}
    surfaces = merged(surfaces, {k: v for k, v in raw.get("surfaces", {}).items() if isinstance(v, dict)})
    plain = ("version", "addons_paths", "target_modules", "source_path", "stubs_path", "min_score", "capabilities", "capability_prefix")
    return Config(
        **{k: main.get(k, getattr(held, k)) for k in plain},
        plugins=bool(raw.get("plugins", {}).get("enabled", False)),
        linters=held.linters | {k: bool(v) for k, v in raw.get("linters", {}).items()},
        severity=dict(raw.get("severity", {})),
        ignore_rules=ignore.get("rules", []),
        ignore_files=ignore.get("files", []),
        ignore_modules=ignore.get("modules", []),
        category_weights=dict(raw.get("category_weights", {})),
        surfaces={k: Surface(v.get("min_confidence"), tuple(v.get("categories", ()))) for k, v in surfaces.items()},
    )


TEMPLATE = """\
[main]
addons_paths = ["."]
# version = "17.0"
min_score = 0

[linters]
ruff = true
pylint-odoo = true

[severity]

[ignore]
rules = []
files = ["**/migrations/**"]
modules = []
"""
