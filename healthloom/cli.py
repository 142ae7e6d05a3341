"""Commands: scan, fix, rules, symbols, init.

Exit status: 0 fine, 1 findings at or above ``--fail-on``, 2 score below
``--min-score``, 3 wrong usage.  Severity is checked before the score.
``--write-baseline`` writes the file and ends with 0.
"""

from __future__ import annotations

import argparse
import shutil
import subprocess
import sys
from pathlib import Path

from .operators import baseline, symbols
from .operators import findings as P
from .operators.scoring import below, delta_text, mean_score
from .plans import fixes, reports
from .plans import scan as S
from .plans.config import FILE, TEMPLATE, Config, load_config
from .plans.rules import REGISTRY
from .session import new_place, open_folder, session
from .sources import linters as L
from .sources.parsed import Facts
from .sources.tree import read_tree

USAGE = 3
FORMATS = ("terminal", "json", "sarif", "github", "comment")


def git(folder: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def changed_files(folder: str, ref: str) -> list[str] | None:
    """Absolute paths of files that differ from ``ref``; None if git can't tell."""
    top, names = git(folder, "rev-parse", "--show-toplevel"), git(folder, "diff", "--name-only", ref)
    if top is None or names is None:
        return None
    return [str(Path(top.strip()) / n) for n in names.splitlines() if n]


def base_mean(spark, paths: list[str], config: Config, version: str | None, ref: str, store: str | None = None) -> float | None:
    """The mean score of the commit ``ref`` with head's settings; None if git can't tell.

    Blobs are read by name, so no worktree is made; with a ``store`` that head's scan has filled only blobs that
    differ are parsed.
    """
    top = git(paths[0], "rev-parse", "--show-toplevel")
    if top is None or git(top.strip(), "rev-parse", "--verify", f"{ref}^{{commit}}") is None:
        return None
    root = Path(top.strip()).resolve()
    try:
        inside = [Path(p).resolve().relative_to(root).as_posix() for p in paths]
    except ValueError:  # a path outside of the repository
        return None
    result = S.scan_commits(spark, str(root), [ref], config, version, inside, store)[ref]
    try:
        return mean_score(result.scores)
    finally:
        result.release()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="healthloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "fix"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="*")
        c.add_argument("--version", dest="framework")
        c.add_argument("--module", action="append", default=[])
    fix = sub.choices["fix"]
    fix.add_argument("--diff", action="store_true")
    fix.add_argument("--write", action="store_true")
    s = sub.choices["scan"]
    s.add_argument("--format", choices=FORMATS, default="terminal")
    s.add_argument("--json", action="store_true", help="the same as --format json")
    s.add_argument("--output")
    s.add_argument("--diff", help="only what changed since this git reference")
    s.add_argument("--score-delta", help="compare with this git reference")
    s.add_argument("--baseline")
    s.add_argument("--write-baseline")
    s.add_argument("--fail-on", choices=("error", "warning", "info"))
    s.add_argument("--min-score", type=float)
    s.add_argument("--no-linters", action="store_true")
    s.add_argument("--cache", help="a folder that keeps the findings of unchanged trees and the facts of all contents")
    s.add_argument("--post", action="store_true", help="post the comment of --format comment to the open pull request")
    r = sub.add_parser("rules")
    r.add_argument("--category")
    t = sub.add_parser("symbols", help="keep what a source tree defines as a version of the framework")
    t.add_argument("paths", nargs="+")
    t.add_argument("--version", dest="framework", required=True)
    t.add_argument("--into", required=True, help="the store, a folder that stubs_path may name")
    i = sub.add_parser("init")
    i.add_argument("folder", nargs="?", default=".")
    return p


def settled(args) -> tuple[Config, list[str]]:
    paths = args.paths or ["."]
    config = load_config(paths[0])
    if args.module:
        config.target_modules = args.module
    if not args.paths:
        paths = config.addons_paths
    return config, paths


def run_scan(args) -> int:
    config, paths = settled(args)
    spark = session()
    changed = None
    if args.diff:
        names = changed_files(paths[0], args.diff)
        if names is not None:
            changed = spark.createDataFrame([(n,) for n in names], "path string")
    chosen = () if args.no_linters else tuple(x for x in (L.RUFF, L.PYLINT) if config.linters.get(x.name, True))
    known = baseline.read_baseline(spark, args.baseline) if args.baseline else None
    # what head and base have in common is parsed once
    store = f"{Path(args.cache).resolve().as_uri()}/facts" if args.cache else new_place(spark, "store") if args.score_delta else None
    more = {"changed": changed, "linters": chosen, "base_path": str(Path.cwd()), "known": known, "cache_dir": args.cache, "store": store}
    result = S.scan(spark, paths, config, args.framework, **more)
    if not config.stubs_path:
        print("no stubs: what the framework itself defines is unknown (stubs_path names a folder of them)", file=sys.stderr)
    for failure in result.failed:
        print(f"left out: {failure}", file=sys.stderr)
    if args.write_baseline:
        baseline.write_baseline(baseline.with_identity(result.findings, result.facts.lines), args.write_baseline)
        print(f"baseline written to {args.write_baseline}", file=sys.stderr)
        return 0
    delta = None
    if args.score_delta and (base := base_mean(spark, paths, config, args.framework, args.score_delta, store)) is not None:
        delta = delta_text(mean_score(result.scores) - base)
    here = str(Path.cwd())
    report = args.output or str(Path(open_folder(spark, "report")) / "text")
    match "json" if args.json else args.format:
        case "json":
            reports.write_json(result, report)
        case "sarif":
            reports.write_sarif(result.findings, report, here)
        case "github":
            reports.write_annotations(result.findings, report, here)
        case "comment":
            text = reports.comment_body(result, config.surfaces.get("pr_comment"), delta)
            Path(report).write_text(text + "\n", encoding="utf-8")
        case _:
            reports.write_terminal(result, report)
            if delta:
                with open(report, "a", encoding="utf-8") as f:
                    f.write(f"Score delta: {delta}\n")
    if not args.output:
        with open(report, encoding="utf-8", newline="") as f:
            shutil.copyfileobj(f, sys.stdout)
        shutil.rmtree(Path(report).parent)
    if args.post and args.format == "comment":
        reports.post_comment(text)
    if args.fail_on and P.at_or_above(result.findings, args.fail_on):
        return 1
    least = args.min_score if args.min_score is not None else config.min_score
    if not least:
        return 0
    failed = False
    for row in below(result.scores, least).orderBy("module").toLocalIterator():
        failed = True
        print(f"[FAIL] {row.module}: score {row.overall:.1f} < min {least}", file=sys.stderr)
    return 2 if failed else 0


def run_fix(args) -> int:
    if args.diff == args.write:
        print("exactly one of --diff and --write is needed", file=sys.stderr)
        return USAGE
    config, paths = settled(args)
    result = S.scan(session(), paths, config, args.framework)
    made = fixes.compute_fixes(result.findings, result.facts.files).persist()
    if args.diff:
        sys.stdout.write(reports.text_of(fixes.write_diffs, made))
        return 0
    written, left = fixes.write_fixes(made)
    print(f"{written} files written" + (f", {left} left as they have changed meanwhile" if left else ""))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "scan":
        return run_scan(args)
    if args.command == "fix":
        return run_fix(args)
    if args.command == "symbols":
        spark = session()
        facts = Facts(read_tree(spark, args.paths)).settle()
        symbols.write_version(symbols.symbols_of(facts), args.into, args.framework)
        facts.release()
        print(", ".join(symbols.versions(spark, args.into)))
        return 0
    if args.command == "rules":
        for r in REGISTRY.values():
            if not args.category or r.category == args.category:
                print(f"{r.tier} {r.name:<34} {r.category:<16} {r.confidence}{' fixable' if r.fixable else ''}")
        return 0
    target = Path(args.folder) / FILE
    if target.exists():
        print(f"{target} exists", file=sys.stderr)
        return USAGE
    target.write_text(TEMPLATE, encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
