"""Secret spans in whole texts (DataFrame only).

Base kinds are patterns, matched leftmost and without overlaps.  Spark returns
matches but not where they are, so offsets come from the gaps: ``split`` at the
same pattern gives what lies between the matches, and running sums of lengths
give starts in code points.  Only texts that a cheap ``rlike`` lets through get
that far.

The method adds spans of high entropy: candidates are long runs of token
characters; a window of ``WINDOW`` characters slides over each, with the count
of every character kept up to date by the one that enters and the one that
leaves, and with it the sum of c * log2(c), from which Shannon's entropy
follows.  A candidate's class (hexadecimal, alphanumeric, base 64) sets the
threshold.  The span runs from the first window that reaches it to the end of
the last.  Placeholder words, identifiers like UUIDs and base spans are taken out
first: what stands beside them is a candidate by itself, so a key behind
``example/`` or ``dummy_`` is found.  Candidates without a digit or without a
letter are suppressed.

Defined cases: a null text is empty; a text without matches has no spans and
the hash of the empty string; spans that tie on their start go by kind; a very
long text is scanned whole, many matches cost little more than few, and one long
run costs in proportion to its length; repeated
rows and null ids are reported each; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, let

#: The base kinds.  The minimal lengths of access and hex are in their patterns, since a run
#: that is too short cannot hold a long enough one; that of assign is checked on group 2 after matching.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What a text with an assignment must hold: the pattern without what follows the sign.
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Entropy in bits per character of a window that a class must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Allow list: what is taken out of a text before candidates are looked for, with its length in characters ...
TAKEN_OUT = (
    (r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", 36),
    *((f"(?i){word}", len(word)) for word in ("example", "placeholder", "changeme", "dummy", "xxxx", "0123456789", "abcdefgh")),
)
#: ... and what is suppressed where a whole candidate is like that.
ALLOWED = (r"[^0-9]*", r"[^A-Za-z]*")

_NONE = "array<struct<start:int,kind:int,stop:int>>"


def placed(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as structs start, stop (code points), part (the group)."""
    p = F.lit(pattern)
    lengths = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.char_length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    rows = F.arrays_zip(gaps.alias("gap"), lengths.alias("size"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"))
    # the last gap has no match behind it
    rows = F.filter(rows, lambda r: r["size"].isNotNull())

    def located(held: Column) -> Column:
        starts = before_each(F.transform(held, lambda r: r["gap"] + r["size"]))

        def item(r: Column, at: Column) -> Column:
            start = (at + r["gap"]).cast("int")
            return F.struct(start.alias("start"), (start + r["size"]).alias("stop"), r["part"].alias("part"))

        return F.zip_with(held, starts, item)

    return let(rows, located)


def _spans(text: Column, hint: str, pattern: str, kind: int, least: int = 0) -> Column:
    found = placed(text, pattern, 2 if least else 0)
    if least:
        found = F.filter(found, lambda m: F.char_length(m["part"]) >= least)
    spans = F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop"))
    )
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(_NONE))


def entropy_run(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """start, stop of the part of ``candidate`` whose windows reach the threshold; null if none does.

    The entropy of a window of n characters is log2(n) - sum(c log2 c) / n over
    the counts c of its characters; one character in and one out change two terms.
    """
    terms = F.lit([0.0, *[c * math.log2(c) for c in range(1, window + 1)]])
    term = lambda c: F.element_at(terms, c + 1)

    def run(codes: Column) -> Column:
        alphabet = F.array_distinct(codes)
        steps = F.transform(
            codes,
            lambda c, at: F.struct(at.alias("at"), c.alias("enter"), F.get(codes, at - window).alias("leave")),
        )
        return let(alphabet, lambda a: F.aggregate(steps, begin(a), lambda s, r: advance(s, r, a), finish))

    def begin(alphabet: Column) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(
            F.transform(alphabet, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("total"),
            none.alias("first"), none.alias("last"),
        )

    def advance(s: Column, r: Column, alphabet: Column) -> Column:
        enter = F.array_position(alphabet, r["enter"]).cast("int")
        leave = F.coalesce(F.array_position(alphabet, r["leave"]).cast("int"), F.lit(0))
        counts = F.transform(
            s["counts"],
            lambda n, k: n + (k + 1 == enter).cast("int") - (k + 1 == leave).cast("int"),
        )
        grown = F.element_at(s["counts"], enter)
        # a character that leaves as it enters changes nothing
        rise = term(grown + 1) - term(grown)
        fall = F.when(leave > 0, let(F.element_at(s["counts"], F.greatest(leave, F.lit(1))), lambda n: term(n) - term(F.greatest(n - 1, F.lit(0)))))
        total = F.when(leave == enter, s["total"]).otherwise(s["total"] + rise - F.coalesce(fall, F.lit(0.0)))

        def after(t: Column) -> Column:
            high = (r["at"] >= window - 1) & (F.lit(math.log2(window)) - t / window >= threshold)
            return F.struct(
                counts.alias("counts"), t.alias("total"),
                F.when(high, F.coalesce(s["first"], r["at"] - (window - 1))).otherwise(s["first"]).alias("first"),
                F.when(high, r["at"] + 1).otherwise(s["last"]).alias("last"),
            )

        return let(total, after)

    def finish(s: Column) -> Column:
        return F.when(s["first"].isNotNull(), F.struct(s["first"].alias("start"), s["last"].alias("stop")))

    return let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c)), run)


def high_entropy(text: Column, base: Column, window: int = WINDOW) -> Column:
    """Spans of kind ``entropy`` outside of the base spans."""

    def threshold(part: Column) -> Column:
        return (
            F.when(part.rlike("^[0-9A-Fa-f]+$"), THRESHOLDS["hex"])
            .when(part.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"])
            .otherwise(THRESHOLDS["base64"])
        )

    masked = text
    for pattern, size in TAKEN_OUT:
        masked = F.regexp_replace(masked, pattern, " " * size)

    def pieces(m: Column) -> Column:
        """What base spans leave of a candidate."""

        def cut_at(spans: Column) -> Column:
            # what came before ends where the last of all earlier spans ends
            begins = F.transform(spans, lambda b, k: F.greatest(m["start"], F.array_max(F.transform(F.slice(spans, F.lit(1), k + 1), lambda x: x["stop"]))))
            rows = F.arrays_zip(F.concat(F.array(m["start"]), begins).alias("a"), F.concat(F.transform(spans, lambda b: b["start"]), F.array(m["stop"])).alias("b"))
            long = F.filter(rows, lambda r: r["b"] - r["a"] >= window)
            return F.transform(long, lambda r: F.struct(r["a"].alias("start"), F.substring(m["part"], r["a"] - m["start"] + 1, r["b"] - r["a"]).alias("part")))

        over = F.array_sort(F.filter(base, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
        return F.when(F.size(over) == 0, F.array(F.struct(m["start"].alias("start"), m["part"].alias("part")))).otherwise(let(over, cut_at))

    allowed = "^(?:" + "|".join(ALLOWED) + ")$"
    candidates = F.filter(F.flatten(F.transform(placed(masked, CANDIDATE), pieces)), lambda m: ~m["part"].rlike(allowed))

    def span(m: Column) -> Column:
        def placed_in_text(e: Column) -> Column:
            at = F.struct((m["start"] + e["start"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + e["stop"]).alias("stop"))
            return F.when(e.isNotNull(), at)

        # the threshold is worked out once, not at every character: its patterns read the whole candidate
        return let(threshold(m["part"]), lambda t: let(entropy_run(m["part"], t, window), placed_in_text))

    found = F.filter(F.transform(candidates, span), lambda s: s.isNotNull())
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(_NONE))


def scan(text: Column) -> Column:
    """struct of base and all spans (start, kind, stop), by start and then kind."""
    base = lambda t: F.array_sort(
        F.concat(
            _spans(t, ASSIGN_HINT, ASSIGN, 0, ASSIGN_LEAST), _spans(t, ACCESS, ACCESS, 1), _spans(t, HEX, HEX, 2)
        )
    )
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            base(t), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, high_entropy(t, b))).alias("every"))
        ),
    )


def spelled(spans: Column) -> Column:
    name = F.lit(list(KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base, every: the spans of every text as arrays of struct(start, kind, stop)."""
    return docs.select("doc_id", scan(F.col("text")).alias("found")).select("doc_id", "found.base", "found.every")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span (none overlapping an earlier one) replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda held, s: F.when(
        s["start"] >= held["at"],
        F.struct(
            s["stop"].alias("at"),
            F.concat(held["out"], F.substring(text, held["at"] + 1, s["start"] - held["at"]), F.lit(mark)).alias("out"),
        ),
    ).otherwise(held)
    return F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.char_length(text))))


def oracle() -> str:
    """DuckDB SQL for ``op8_secret_spans``: matches between gaps, and every window's entropy from counts made anew."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    masked = "s"
    for pattern, size in TAKEN_OUT:
        masked = f"regexp_replace({masked}, {quoted(pattern)}, '{' ' * size}', 'g')"

    def matches(name: str, pattern: str, group: int = 0, table: str = "t") -> str:
        p = quoted(pattern)
        return f"""{name}_m AS (
  SELECT doc_id, unnest(string_split_regex(s, {p})) AS gap, unnest(regexp_extract_all(s, {p})) AS m, unnest(regexp_extract_all(s, {p}, {group})) AS part,
         generate_subscripts(string_split_regex(s, {p}), 1) AS i FROM {table} WHERE regexp_matches(s, {p})
), {name} AS (
  SELECT doc_id, part, i, sum(length(gap) + length(m)) OVER w - length(m) AS start, sum(length(gap) + length(m)) OVER w AS stop
  FROM {name}_m WHERE m IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)"""

    allowed = " OR ".join(f"regexp_full_match(part, {quoted(p)})" for p in ALLOWED)
    spelled_as = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents
), u AS (SELECT doc_id, {masked} AS s FROM t
), {matches("assign", ASSIGN, 2)}, {matches("access", ACCESS)}, {matches("hexes", HEX)}, {matches("candidate", CANDIDATE, table="u")}, base AS (
  SELECT doc_id, 0 AS kind, 'assign' AS name, start, stop FROM assign WHERE length(part) >= {ASSIGN_LEAST}
  UNION ALL SELECT doc_id, 1, 'access', start, stop FROM access UNION ALL SELECT doc_id, 2, 'hex', start, stop FROM hexes
), over AS (
  SELECT c.doc_id, c.i, c.start AS c_start, c.stop AS c_stop, b.start, b.stop, row_number() OVER w AS k,
         max(b.stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM candidate c JOIN base b ON b.doc_id IS NOT DISTINCT FROM c.doc_id AND b.start < c.stop AND c.start < b.stop
  WINDOW w AS (PARTITION BY c.doc_id, c.i ORDER BY b.start, b.kind, b.stop)
), free AS (
  SELECT doc_id, i, c_start, greatest(c_start, coalesce(before, c_start)) AS a, start AS b FROM over
  UNION ALL SELECT doc_id, i, c_start, greatest(c_start, max(stop)), max(c_stop) FROM over GROUP BY doc_id, i, c_start
  UNION ALL SELECT doc_id, i, start, start, stop FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.i = c.i)
), piece AS (
  SELECT f.doc_id, f.i * 1000000 + f.a AS i, f.a AS start, substr(c.part, (f.a - f.c_start + 1)::BIGINT, (f.b - f.a)::BIGINT) AS part
  FROM free f JOIN candidate c ON c.doc_id IS NOT DISTINCT FROM f.doc_id AND c.i = f.i WHERE f.b - f.a >= {WINDOW}
), held AS (
  SELECT doc_id, i, part, start, CASE WHEN regexp_full_match(part, '[0-9A-Fa-f]+') THEN {THRESHOLDS["hex"]}
      WHEN regexp_full_match(part, '[A-Za-z0-9]+') THEN {THRESHOLDS["alnum"]} ELSE {THRESHOLDS["base64"]} END AS least
  FROM piece WHERE NOT ({allowed})
), windows AS (
  SELECT doc_id, i, start, least, part, unnest(range(0, length(part) - {WINDOW - 1})) AS first FROM held
), letters AS (
  SELECT doc_id, i, start, least, first, unnest(string_split(substr(part, first + 1, {WINDOW}), '')) AS letter FROM windows
), counts AS (
  SELECT doc_id, i, start, least, first, count(*) AS n FROM letters GROUP BY doc_id, i, start, least, first, letter
), high AS (
  SELECT doc_id, i, start, first FROM counts GROUP BY doc_id, i, start, least, first
  HAVING log2({WINDOW}::DOUBLE) - sum(n * log2(n::DOUBLE)) / {WINDOW} >= least::DOUBLE - 1e-9
), every AS (
  SELECT * FROM base UNION ALL
  SELECT doc_id, 3, 'entropy', start + min(first), start + max(first) + {WINDOW} FROM high GROUP BY doc_id, i, start
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce({spelled_as} FILTER (kind < 3), '') AS base, {spelled_as} AS spans FROM every GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN told ON told.doc_id = t.doc_id"""
