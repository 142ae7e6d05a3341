"""Scalar functions over columns; all JVM-side but ``rounded``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks and score bands.
CONFIDENCE = {"low": 1, "medium": 2, "high": 3}
SOURCES = {"ruff": 1, "oca": 1, "native": 2}
SEVERITY = {"info": 1, "warning": 2, "error": 3}
BANDS = ((90, "Excellent"), (75, "Good"), (50, "Needs work"))
LOWEST_BAND = "Critical"


def rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, r in ranks.items():
        out = F.when(value == name, r).otherwise(out)
    return out


def source_rank(source: Column) -> Column:
    """Linters of the pylint family rank with the other linters."""
    return F.when(source.startswith("pylint-"), 1).otherwise(rank(source, SOURCES))


def version_at_least(version: Column, least: Column) -> Column:
    """Compares the numbers before the first dot; what is no number is below everything."""
    number = lambda c: F.split_part(c, F.lit("."), F.lit(1)).try_cast("double")
    return F.coalesce(number(version) >= number(least), F.lit(False))


def score_label(overall: Column) -> Column:
    out = F.lit(LOWEST_BAND)
    for least, name in reversed(BANDS):
        out = F.when(overall >= least, name).otherwise(out)
    return out


def external_to_model(external: Column) -> Column:
    """``model_sale_order`` -> ``sale.order``."""
    return F.replace(F.regexp_replace(external, "^model_", ""), F.lit("_"), F.lit("."))


#: Names with more separators than this have the all-dots candidate only.
MOST_SEPARATORS = 8


def candidate_models(external: Column) -> Column:
    """All model names an access row's external id may stand for; each separator is a dot or an underscore."""
    parts = F.split(F.regexp_replace(external, "^model_", ""), "_")
    separators = F.size(parts) - 1
    masks = F.when(separators > MOST_SEPARATORS, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), (F.pow(F.lit(2), F.least(separators, F.lit(MOST_SEPARATORS))) - 1).cast("int"))
    )

    def spelled(mask: Column) -> Column:
        dot = lambda k: F.pmod(F.floor(mask / F.pow(F.lit(2), k - 1)), F.lit(2)) == 0
        return F.array_join(
            F.transform(
                parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.when(dot(k), F.lit(".")).otherwise(F.lit("_")), p))
            ),
            "",
        )

    return F.transform(masks, spelled)


def external_module(name: Column) -> Column:
    """The module of a qualified id; null if there is none."""
    return F.when(name.contains("."), F.nullif(F.substring_index(name, ".", 1), F.lit("")))


def short_id(name: Column) -> Column:
    """Without what stands before the first dot."""
    return F.regexp_replace(name, r"^[^.]*\.", "")


def is_security_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    hit = F.array_contains(F.split(path, "/"), "security")
    for part in ("ir.model.access", "security", "groups"):
        hit |= name.contains(part)
    return hit


def is_view_file(path: Column) -> Column:
    parts, name = F.split(path, "/"), F.substring_index(path, "/", -1)
    hit = F.arrays_overlap(parts, F.lit(["views", "report", "wizard"]))
    for part in ("view", "action", "menu"):
        hit |= name.contains(part)
    return hit


def is_open_domain(domain: Column) -> Column:
    """No domain, or one that restricts nothing."""
    bare = F.regexp_replace(F.coalesce(domain, F.lit("")), r"(?U)\s+", "")
    return bare.isin("", "[]", "[(1,'=',1)]")


def normal_path(path: Column, base: str | None = None) -> Column:
    """Slashes forward, no ``.`` or empty segments, ``..`` folded into what stands before it, however deep.

    A relative path is taken from ``base`` if one is given and else stays
    relative.  Links in the file system are not followed: executors need not
    see the tree.
    """
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    if base:
        here = base.replace("\\", "/").rstrip("/") + "/"
        whole = F.when(whole.startswith("/") | whole.rlike("^[A-Za-z]:/"), whole).otherwise(F.concat(F.lit(here), whole))
    rooted = whole.startswith("/")
    none = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        return (
            F.when(part.isin("", "."), held)
            .when(part != "..", F.array_append(held, part))
            .when(last != "..", F.slice(held, F.lit(1), F.size(held) - 1))
            .when(rooted, held)
            .otherwise(F.array_append(held, part))
        )

    folded = F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/")
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), folded)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**`` is any number of whole segments, other wildcards stay in one."""
    segments = [s for s in glob.split("/") if s]
    out = ""
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last and not k else "(?:[^/]+/)*" if not last else "(?:/[^/]+)*"
            continue
        body = ""
        for part in re.findall(r"\[!?\]?[^\]]*\]|.", s):
            if part == "*":
                body += "[^/]*"
            elif part == "?":
                body += "[^/]"
            elif len(part) > 1:
                body += "[" + part[1:-1].replace("\\", r"\\").replace("!", "^", 1 if part[1] == "!" else 0) + "]"
            else:
                body += re.escape(part)
        follows = not last and not (segments[k + 1] == "**" and k + 2 == len(segments))
        out += body + ("/" if follows else "")
    return f"^/?{out}/?$"


def matches_globs(path: Column, globs: list[str], base: str | None = None) -> Column:
    """Whether a path, or it relative to ``base``, matches one of the globs."""
    hit = F.lit(False)
    tried = [path]
    if base:
        top = base.rstrip("/") + "/"
        tried.append(F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.char_length(path))))
    for glob in globs:
        for p in tried:
            hit |= F.coalesce(p.rlike(glob_pattern(glob)), F.lit(False))
    return hit


def escape_data(value: Column) -> Column:
    """Workflow-command data: percent, carriage return, line feed."""
    for plain, mark in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(plain), F.lit(mark))
    return value


def escape_property(value: Column) -> Column:
    value = escape_data(value)
    for plain, mark in ((":", "%3A"), (",", "%2C")):
        value = F.replace(value, F.lit(plain), F.lit(mark))
    return value


def relative_to(path: Column, base: str, otherwise: Column) -> Column:
    top = base.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.char_length(path))).otherwise(otherwise)


def rounded(value: Column) -> Column:
    """One decimal place, as a correctly rounded binary double rounds (neither half-up nor half-even on decimals)."""

    @F.udf("double")
    def one_place(x):
        return None if x is None else round(x, 1)

    return one_place(value)
