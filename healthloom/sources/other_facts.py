"""Facts of manifests, XML data files and access CSVs.  Runs on executors; plain standard library."""

from __future__ import annotations

import ast
import csv
import io
import json
import re
from dataclasses import dataclass, field
from xml.parsers import expat

from .python_facts import suppressed

#: Fixed value: calls of ``ref`` in ``eval`` attributes.
REF_CALL = re.compile(r"\bref\(['\"]([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)['\"]\)")
#: Models that elements stand for.
ELEMENT_MODELS = {"menuitem": "ir.ui.menu", "template": "ir.ui.view"}


def manifest(content: bytes) -> list[dict]:
    """One fact with the fields that queries use; nothing if the file is no literal dict."""
    try:
        raw = ast.literal_eval(content.decode("utf-8", "replace"))
    except (SyntaxError, ValueError, RecursionError, TypeError, MemoryError):
        return []
    if not isinstance(raw, dict):
        return []
    strings = lambda value: [str(v) for v in value] if isinstance(value, (list, tuple)) else []
    assets = raw.get("assets") if isinstance(raw.get("assets"), dict) else {}
    data = {
        "version": raw["version"] if isinstance(raw.get("version"), str) else None,
        "depends": strings(raw.get("depends")),
        "data": strings(raw.get("data")),
        "installable": bool(raw.get("installable", True)),
        "assets": [{"bundle": str(b), "files": [f for f in v if isinstance(f, str)]} for b, v in assets.items() if isinstance(v, (list, tuple))],
        "filled": [k for k, v in raw.items() if isinstance(k, str) and v is not None and v != ""],
        "raw": json.dumps(raw, default=str),
    }
    return [{"fact": "manifest", "line": 1, "col": 0, "data": data}]


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    line: int
    above: Element | None
    children: list[Element] = field(default_factory=list)
    text: str = ""

    def every(self):
        """This element and all below, in document order, without recursion."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(reversed(e.children))


def tree(content: bytes) -> tuple[Element | None, list[tuple[str, int]]]:
    """Root element and comments with their lines.  Lines are those on which a tag starts."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    root: list[Element] = []
    open_: list[Element] = []
    comments: list[tuple[str, int]] = []

    def start(tag: str, attrs: dict[str, str]) -> None:
        e = Element(tag, attrs, parser.CurrentLineNumber, open_[-1] if open_ else None)
        (open_[-1].children if open_ else root).append(e)
        open_.append(e)

    def text(data: str) -> None:
        if open_ and not open_[-1].children:
            open_[-1].text += data

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: open_.pop()
    parser.CharacterDataHandler = text
    parser.CommentHandler = lambda data: comments.append((data, parser.CurrentLineNumber))
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, ValueError):
        return None, []
    return root[0], comments


def _noupdate(e: Element) -> bool:
    up = e.above
    while up is not None:
        if (value := up.attrs.get("noupdate")) is not None:
            return value == "1" or value.lower() == "true"
        up = up.above
    return False


def _refs(e: Element) -> list[dict]:
    out = []
    for x in e.every():
        if x.tag == "field" and x.attrs.get("name") == "inherit_id":
            continue  # told by the view
        names = [x.attrs["ref"]] if x.attrs.get("ref") else []
        out += [{"ref": r, "line": x.line} for r in names + REF_CALL.findall(x.attrs.get("eval", ""))]
    return out


def _arch(arch: Element) -> tuple[list[dict], list[dict]]:
    """Fields and object buttons of a view's own model: what lies inside another field belongs to that field's model."""
    fields: dict[str, int] = {}
    buttons: dict[str, int] = {}
    todo = [(c, False) for c in reversed(arch.children)]
    while todo:
        e, inside = todo.pop()
        name = e.attrs.get("name")
        if name and not inside:
            if e.tag == "field":
                fields.setdefault(name, e.line)
            elif e.tag == "button" and e.attrs.get("type") == "object":
                buttons.setdefault(name, e.line)
        todo.extend((c, inside or e.tag == "field") for c in reversed(e.children))
    listed = lambda found: [{"name": n, "line": k} for n, k in found.items()]
    return listed(fields), listed(buttons)


def xml(content: bytes) -> list[dict]:
    root, comments = tree(content)
    if root is None:
        return []
    out = [f for text, line in comments for f in suppressed(text, line)]
    put = lambda fact, e, **data: out.append({"fact": fact, "line": e.line, "col": 0, "data": data})
    for e in root.every():
        if (xml_id := e.attrs.get("id")) is not None:
            model = e.attrs.get("model") if e.tag == "record" else ELEMENT_MODELS.get(e.tag)
            put("record", e, id=xml_id, tag=e.tag, model=model, noupdate=_noupdate(e), refs=_refs(e))
        if e.tag != "record":
            continue
        parts = [c for c in e.children if c.tag == "field"]
        if e.attrs.get("model") == "ir.rule":
            domain = next((c.text.strip() for c in parts if c.attrs.get("name") == "domain_force"), None)
            put("access_domain", e, id=e.attrs.get("id", "<anonymous>"), domain=domain)
        if e.attrs.get("model") == "ir.ui.view":
            model, parent, fields, buttons = "", None, [], []
            for c in parts:
                match c.attrs.get("name"):
                    case "model":
                        model = c.text.strip()
                    case "inherit_id":
                        parent = c.attrs.get("ref")
                    case "arch":
                        fields, buttons = _arch(c)
            if model:
                put("view", e, id=e.attrs.get("id", ""), model=model, parent=parent, fields=fields, buttons=buttons)
    return out


def _csv_rows(text: str) -> tuple[list[dict], str]:
    """Rows up to one that can't be read, and why it can't."""
    rows: list[dict] = []
    try:
        rows.extend(csv.DictReader(io.StringIO(text, newline="")))
    except csv.Error as error:
        return rows, str(error)
    return rows, ""


def access(content: bytes) -> list[dict]:
    """Rows of an access CSV; the line is the row's ordinal, from 2.  Bytes that are not UTF-8 are replaced."""
    text = content.decode("utf-8-sig", "replace")
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))  # a field may be as long as the file
    out = []
    rows, fault = _csv_rows(text)
    if fault:
        out.append({"fact": "unreadable", "line": len(rows) + 2, "col": 0, "data": {"reason": fault}})
    for line, row in enumerate(rows, start=2):
        get = lambda *names, row=row: next((row[n] for n in names if row.get(n) is not None), "")
        data = {"id": get("id"), "name": get("name"), "model": get("model_id:id", "model_id/id"), "group": get("group_id:id", "group_id/id") or None}
        data |= {p: get(f"perm_{p}") == "1" for p in ("read", "write", "create", "unlink")}
        out.append({"fact": "access", "line": line, "col": 0, "data": data})
    return out
