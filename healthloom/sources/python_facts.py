"""Facts of one Python source file, from a single walk of its syntax tree.

Runs on executors (see ``parsed.py``); plain standard library.  The walk emits
*events*; which events are findings is decided in DataFrame queries.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

# The framework's base classes, field types and cursor names.
BASES = {
    "models.Model": "model", "Model": "model",
    "models.TransientModel": "transient", "TransientModel": "transient",
    "models.AbstractModel": "abstract", "AbstractModel": "abstract",
}
FIELD_TYPES = {
    "Char", "Text", "Html", "Integer", "Float", "Boolean", "Date", "Datetime", "Binary", "Selection",
    "Many2one", "One2many", "Many2many", "Monetary", "Reference",
}
RELATIONAL = {"Many2one", "One2many", "Many2many"}
CURSORS = {"cr", "env.cr", "_cr", "self.env.cr", "self._cr", "cls.env.cr", "cls._cr"}
SQL_WORDS = ("SELECT", "UPDATE", "INSERT", "DELETE", "CREATE")
ROUTES = {"http.route", "route"}
#: Marker of suppression comments: rules for the next line, or for the file.
SUPPRESS = re.compile(r"\w+-doctor:\s*disable(-file)?=([a-z0-9_-]+(?:,\s*[a-z0-9_-]+)*)")

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS = (ast.For, ast.While)


def dotted(node: ast.AST | None) -> str:
    """``a.b.c`` of a plain attribute chain, or nothing."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else ""


def constant(node: ast.AST | None):
    return node.value if isinstance(node, ast.Constant) else None


def text_or_none(value) -> str | None:
    return None if value is None else str(value)


def on_orm(node: ast.AST, known: frozenset[str]) -> bool:
    """Whether a receiver is a record set: rooted at self/cls or a known name, or through ``env[...]``."""
    while True:
        if isinstance(node, ast.Subscript):
            if (node.value.id if isinstance(node.value, ast.Name) else getattr(node.value, "attr", "")) == "env":
                return True
            node = node.value
        elif isinstance(node, ast.Attribute):
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        else:
            return isinstance(node, ast.Name) and (node.id in ("self", "cls") or node.id in known)


# --- SQL built from strings ------------------------------------------------------------------


#: What an SQL text may be put together from without being open to injection, by the way it is put together.
HARMLESS = {"braces": {"table"}, "percent": {"text", "value"}, "format": {"text", "value"}, "plus": {"text", "table"}}


def form(node: ast.AST) -> str:
    """text, value (any other literal, also a list of literals), table (the model's own table name) or other."""
    if isinstance(node, ast.Constant):
        return "text" if isinstance(node.value, str) else "value"
    if isinstance(node, (ast.Tuple, ast.List)):
        return "value" if {form(e) for e in node.elts} <= {"text", "value"} else "other"
    return "table" if dotted(node) in ("self._table", "cls._table") else "other"


def assembled(node: ast.AST) -> tuple[str, list[ast.AST]]:
    """How an expression puts a text together, and from what; nothing if it does not."""
    match node:
        case ast.JoinedStr(values=values):
            return "braces", [v.value for v in values if isinstance(v, ast.FormattedValue)]
        case ast.BinOp(op=ast.Mod(), right=right):
            return "percent", [right]
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            return "plus", [left, right]
        case ast.Call(func=ast.Attribute(attr="format", value=ast.Constant(value=str() as text))) if not any(w in text.upper() for w in SQL_WORDS):
            return "format", []  # no SQL
        case ast.Call(func=ast.Attribute(attr="format"), args=args, keywords=named):
            return "format", [*args, *(k.value for k in named)]
    return "plus", []


def harmful(way: str, parts: list[ast.AST]) -> bool:
    return any(form(p) not in HARMLESS[way] for p in parts)


def tainted(node: ast.AST, names: set[str]) -> bool:
    """Whether an SQL expression has parts that are put into its text at run time."""
    return node.id in names if isinstance(node, ast.Name) else harmful(*assembled(node))


# --- the walk --------------------------------------------------------------------------------


class Scope:
    """What the walk knows at a node; children get a changed copy where it differs."""

    __slots__ = ("orm", "loop", "targets", "risky", "taint")

    def __init__(self, orm=frozenset(), loop=0, targets=(), risky=False, taint=None):
        self.orm, self.loop, self.targets, self.risky = orm, loop, targets, risky
        self.taint = set() if taint is None else taint

    def but(self, **changes) -> Scope:
        held = {k: getattr(self, k) for k in self.__slots__}
        return Scope(**(held | changes))


def _risky(func) -> bool:
    """Computed fields, scheduled jobs, and what is decorated by depends or route."""
    if func.name.startswith(("_compute_", "_cron", "cron_")):
        return True
    marks = [d.func if isinstance(d, ast.Call) else d for d in func.decorator_list]
    return any((m.id if isinstance(m, ast.Name) else getattr(m, "attr", "")) in ("depends", "route") for m in marks)


def _empty_list(node: ast.AST) -> bool:
    return isinstance(node, ast.List) and not node.elts


def _commented(line: str) -> bool:
    """Whether ``#`` occurs outside of quotes."""
    return "#" in re.sub(r"'[^']*('|$)|\"[^\"]*(\"|$)", "", line)


class Walk:
    def __init__(self, source: str):
        self.lines = source.splitlines()
        self.out: list[dict] = []
        self.loops = 0

    def emit(self, fact: str, node: ast.AST, **data) -> None:
        self.out.append({"fact": fact, "line": node.lineno, "col": node.col_offset, "data": data})

    def visit(self, node: ast.AST, at: Scope) -> None:
        if isinstance(node, FUNCTIONS):
            at = at.but(risky=at.risky or _risky(node), taint=set())
        elif isinstance(node, LOOPS):
            self.loops += 1
            at = at.but(loop=self.loops)
            if isinstance(node, ast.For):
                ends = node.target.elts if isinstance(node.target, ast.Tuple) else [node.target]
                if on_orm(node.iter, at.orm):
                    at = at.but(orm=at.orm | {e.id for e in ends if isinstance(e, ast.Name)})
                if isinstance(node.target, ast.Name):
                    at = at.but(targets=(*at.targets, (self.loops, node.target.id)))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            dirty = tainted(node.value, at.taint)
            for target in getattr(node, "targets", None) or [node.target]:
                if isinstance(target, ast.Name):
                    (at.taint.add if dirty else at.taint.discard)(target.id)
        elif isinstance(node, ast.AugAssign) and isinstance(node.op, ast.Add) and isinstance(node.target, ast.Name):
            if harmful("plus", [node.value]):
                at.taint.add(node.target.id)
        elif isinstance(node, ast.Call):
            self.call(node, at)
        elif isinstance(node, ast.Attribute):
            self.chain(node, at)
        if isinstance(node, ast.ClassDef):
            self.class_facts(node)
        for child in ast.iter_child_nodes(node):
            self.visit(child, at)

    def call(self, node: ast.Call, at: Scope) -> None:
        func, first = node.func, node.args[0] if node.args else None
        attr = func.attr if isinstance(func, ast.Attribute) else None
        name = func.id if isinstance(func, ast.Name) else attr
        if name is None:
            return
        literal = isinstance(first, ast.JoinedStr) or isinstance(constant(first), str)
        event = {"name": name, "bare": attr is None, "first_constant": isinstance(first, ast.Constant), "first_text": literal}
        if attr is not None:
            this = self.lines[node.lineno - 1] if 0 < node.lineno <= len(self.lines) else ""
            above = self.lines[node.lineno - 2] if 1 < node.lineno <= len(self.lines) + 1 else ""
            domains = [first, *(k.value for k in node.keywords if k.arg == "domain")]
            event |= {
                "orm_here": on_orm(func.value, at.orm),
                "orm": on_orm(func.value, frozenset()),
                "in_loop": at.loop > 0,
                "risky": at.risky,
                "everything": any(d is not None and _empty_list(d) for d in domains),
                "limited": any(k.arg == "limit" for k in node.keywords),
                "excused": _commented(this) or above.strip().startswith("#"),
                "tainted_sql": attr in ("execute", "executemany")
                and dotted(func.value) in CURSORS
                and first is not None
                and tainted(first, at.taint),
            }
        self.emit("call", node, **event)

    def chain(self, node: ast.Attribute, at: Scope) -> None:
        root, depth = node, 0
        while isinstance(root, ast.Attribute):
            root, depth = root.value, depth + 1
        if depth >= 2 and isinstance(root, ast.Name):
            for loop, name in at.targets:
                if name == root.id:
                    self.emit("chain", node, loop=loop)

    # --- classes ---

    def class_facts(self, cls: ast.ClassDef) -> None:
        for func in cls.body:
            if isinstance(func, FUNCTIONS):
                self.controller(func)
        kinds = [BASES[n] for b in cls.bases if (n := dotted(b)) in BASES]
        if not kinds:
            return
        name, inherit, inherits = None, [], []
        fields: dict[str, dict] = {}
        methods: dict[str, dict] = {}
        for item in cls.body:
            if isinstance(item, ast.Assign):
                for target in item.targets:
                    label = target.id if isinstance(target, ast.Name) else ""
                    if label == "_name" and isinstance(item.value, ast.Constant):
                        name = item.value.value
                    elif label == "_inherit":
                        found = item.value.elts if isinstance(item.value, ast.List) else [item.value]
                        inherit = [constant(e) for e in found if isinstance(constant(e), str)]
                    elif label == "_inherits" and isinstance(item.value, ast.Dict):
                        pairs = zip(item.value.keys, item.value.values)
                        inherits += [str(constant(k)) for k, v in pairs if isinstance(k, ast.Constant) and isinstance(v, ast.Constant)]
                if len(item.targets) == 1 and isinstance(item.targets[0], ast.Name) and isinstance(item.value, ast.Call):
                    if held := self.field(item.targets[0].id, item.value, item.lineno):
                        fields[held["name"]] = held
            elif isinstance(item, FUNCTIONS):
                methods[item.name] = self.method(item)
        self.emit(
            "model", cls, name=text_or_none(name), inherit=inherit, inherits=list(dict.fromkeys(inherits)),
            transient="transient" in kinds, abstract="abstract" in kinds,
            fields=list(fields.values()), methods=list(methods.values()),
        )

    def field(self, name: str, call: ast.Call, line: int) -> dict | None:
        kind = dotted(call.func).rpartition(".")[2]
        if kind not in FIELD_TYPES:
            return None
        named = {k.arg: k.value.value for k in call.keywords if isinstance(k.value, ast.Constant)}
        first = constant(call.args[0]) if call.args else None
        comodel = named.get("comodel_name", first if kind in RELATIONAL else None)
        label = str(named["string"]) if "string" in named else first if kind not in RELATIONAL and isinstance(first, str) else None
        return {
            "name": name, "type": kind, "comodel": text_or_none(comodel), "compute": text_or_none(named.get("compute")),
            "store": bool(named.get("store", True)), "required": bool(named.get("required", False)), "string": label,
            "ondelete": text_or_none(named.get("ondelete")), "line": line,
        }

    def method(self, func) -> dict:
        marks, depends = [], []
        for d in func.decorator_list:
            mark = dotted(d.func if isinstance(d, ast.Call) else d)
            if mark:
                marks.append(mark)
            if isinstance(d, ast.Call) and mark == "api.depends":
                depends += [constant(a) for a in d.args if isinstance(constant(a), str)]
        nodes = list(ast.walk(func))
        called = (n.func for n in nodes if isinstance(n, ast.Call))
        supers = any((f.id if isinstance(f, ast.Name) else getattr(f, "attr", "")) == "super" for f in called)
        mine = {"self"}
        for n in nodes:
            if isinstance(n, ast.For) and isinstance(n.iter, ast.Name) and n.iter.id in mine and isinstance(n.target, ast.Name):
                mine.add(n.target.id)
        reads = {
            n.attr
            for n in nodes
            if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Load) and isinstance(n.value, ast.Name) and n.value.id in mine
        }
        return {"name": func.name, "decorators": marks, "depends": depends, "supers": supers, "reads": sorted(reads), "line": func.lineno}

    def controller(self, func) -> None:
        for d in func.decorator_list:
            if isinstance(d, ast.Call) and dotted(d.func) in ROUTES:
                named = {k.arg: k.value.value for k in d.keywords if isinstance(k.value, ast.Constant)}
                route = named.get("route", constant(d.args[0]) if d.args else "")
                sudo = any(isinstance(n, ast.Call) and getattr(n.func, "attr", "") == "sudo" for n in ast.walk(func))
                self.emit("controller", func, name=func.name, route=str(route), auth=str(named.get("auth", "user")), sudo=sudo)
                return


def suppressions(source: bytes) -> Iterator[dict]:
    """Rules that comments suppress: line 0 for the whole file, else the line below the comment."""
    try:
        tokens = list(tokenize.tokenize(io.BytesIO(source).readline))
    except (tokenize.TokenError, SyntaxError, ValueError):
        return
    for t in tokens:
        if t.type == tokenize.COMMENT:
            yield from suppressed(t.string, t.start[0])


def suppressed(comment: str, line: int) -> Iterator[dict]:
    found = list(SUPPRESS.finditer(comment))
    # a file-wide mark in a comment outranks one for a line
    chosen = next((m for m in found if m[1]), found[0] if found else None)
    if chosen:
        for rule in chosen[2].split(","):
            yield {"fact": "suppression", "line": 0 if chosen[1] else line + 1, "col": 0, "data": {"rule": rule.strip()}}


def facts(content: bytes) -> list[dict]:
    """All facts of a file.  A file that does not parse has its suppressions at most."""
    text = content.decode("utf-8", "replace")
    out = list(suppressions(content))
    try:
        tree = ast.parse(text)
        walk = Walk(text)
        walk.visit(tree, Scope())
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # too deep for the parser, too
        return out
    return out + walk.out
