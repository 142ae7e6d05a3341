"""Document fingerprints by winnowing (DataFrame only).

A text's *units* are its code points that are not white space.  Every run of K
units, at every offset, has a Rabin-Karp hash modulo 2**31 - 1.  The hash of a
run of 2 n is that of its first n times BASE**n plus that of its last n, so
log2(K) passes give Horner's value of every run; the least of W hashes is found
by doubling as well (K and W are powers of two).  In each window of W hashes
the least one is chosen, the rightmost of equals, and the chosen ones are kept
with their position.  Two texts that share K + W - 1 units in a row therefore
share a chosen hash, wherever the run lies and with or without white space.
Hash and inverted position are one number, so one minimum settles both.

Edited texts need each document's successor by doc_id.  Documents are dealt to
buckets of neighbouring ids (bounds by approximate quantiles, found by binary
search in an expression); the first document of a bucket is copied to the one
before, and the first of all to the last.  So each text is shuffled once, and
no task sees more than a bucket's neighbours at a time.

Defined cases (other columns are ignored, whatever their names, and a very long
text is hashed whole): a null text is empty and has an empty fingerprint; fewer units
than K make one hash; fewer hashes than W are one window; two empty
fingerprints are alike (1), one empty fingerprint is unlike (0); null ids come
first; repeated ids follow each other by the text's hash; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, searched

UNIT, K, W = 1, 16, 32
PRIME, BASE = 2**31 - 1, 1_000_003
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 16
SHIFT = 1 << 32


def solid(text: Column) -> Column:
    """The text without white space: its units, one after the other."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def unit_hashes(text: Column) -> Column:
    of = lambda units: F.transform(F.split(units, ""), lambda u: F.pmod(F.xxhash64(u), F.lit(PRIME)))
    return F.when(solid(text) == "", F.array().cast("array<bigint>")).otherwise(of(solid(text)))


def gram_marks(units: Column, k: int = K, base: Column | int = 0) -> Column:
    """hash * 2**32 + (2**32 - 1 - position) of every run of k units; positions count from ``base``."""

    def doubled(values: Column, n: int, form: Callable[[Column, Column], Column]) -> Column:
        power = pow(BASE, n, PRIME)
        return let(values, lambda v: F.transform(v, lambda x, at: form((x * power + F.coalesce(F.get(v, at + n), F.lit(0))) % PRIME, at)))

    mark = lambda x, at: x * SHIFT + (F.lit(SHIFT - 1) - base - at)
    values, n = units, 1
    while 2 * n < k:
        values, n = doubled(values, n, lambda x, at: x), 2 * n
    marks = doubled(values, n, mark) if k > 1 else F.transform(values, mark)
    return let(marks, lambda m: F.slice(m, F.lit(1), F.greatest(F.lit(1), F.size(m) - (k - 1))))


def window_marks(marks: Column, w: int = W) -> Column:
    """The least mark of every window of w, in order."""

    def doubled(values: Column, n: int) -> Column:
        # least() passes over what lies behind the end
        return let(values, lambda v: F.transform(v, lambda x, at: F.least(x, F.get(v, at + n))))

    def windows(all_marks: Column) -> Column:
        least, n = all_marks, 1
        while n < w:
            least, n = doubled(least, n), 2 * n
        return F.slice(least, F.lit(1), F.greatest(F.lit(1), F.size(all_marks) - (w - 1)))

    return let(marks, windows)


def chosen(marks: Column, w: int = W) -> Column:
    """The least mark of every window of w, each once, in order."""
    return F.array_distinct(window_marks(marks, w))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen marks of a text (array of long); see ``hashes`` and ``positions``."""
    return chosen(gram_marks(unit_hashes(text), k), w)


def hashes(marks: Column) -> Column:
    return F.transform(marks, lambda m: F.shiftrightunsigned(m, 32))


def positions(marks: Column) -> Column:
    return F.transform(marks, lambda m: F.lit(SHIFT - 1) - m.bitwiseAND(F.lit(SHIFT - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct hashes."""
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def spelled(distinct: Column) -> Column:
    """Hashes as one string, 8 hex digits each."""
    return F.array_join(F.transform(distinct, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, hashes and positions (arrays) of every text."""
    return docs.select("doc_id", winnow(F.col("text")).alias("marks")).select(
        "doc_id", hashes(F.col("marks")).alias("hashes"), positions(F.col("marks")).alias("positions")
    )


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, late (0: a row of the bucket; else a copy that only follows it), doc_id, text, tie."""
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    facts = docs.agg(F.count("*").alias("n"), F.min("doc_id").cast("long").alias("low"), F.count("doc_id").alias("named")).first()
    buckets = max(1, min(MOST_BUCKETS, facts["n"] // bucket_rows))
    bounds: list[int] = []
    if buckets > 1 and facts["named"]:
        parts = F.lit([k / buckets for k in range(1, buckets)])
        cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), parts, 4 * buckets + 1000)).first()[0]
        bounds = sorted({c for c in cuts if c > facts["low"] or facts["named"] < facts["n"]})
    first = F.col("doc_id").isNull() if facts["named"] < facts["n"] else F.col("doc_id") == F.lit(facts["low"]).cast("long")
    bucket = searched(bounds, F.col("doc_id"))
    entry = lambda b, late: F.struct(b.alias("bucket"), F.lit(late).alias("late"))
    none = F.array().cast("array<struct<bucket:int,late:int>>")
    placed = plain.withColumn("b", bucket).withColumn("tie", F.xxhash64("text"))
    copies = [F.array(entry(F.col("b"), 0))]
    if bounds:  # the bounds are ids of rows, so a bucket's first row has the bound itself
        opens = (F.col("b") > 0) & (F.element_at(F.lit(bounds), F.greatest(F.col("b"), F.lit(1))) == F.col("doc_id"))
        copies.append(F.when(opens, F.array(entry(F.col("b") - 1, 1))).otherwise(none))
    copies = F.concat(*copies, F.when(first, F.array(entry(F.lit(len(bounds)), 2))).otherwise(none))
    return placed.select(F.inline(copies), "doc_id", "text", "tie")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document against itself with its second half replaced by its successor's start, and against the successor."""
    order = Window.partitionBy("bucket").orderBy("late", "doc_id", "tie")
    n = F.char_length("text")
    paired = neighbours(docs).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    keys = ("bucket", "late", "doc_id", "tie")
    halves = paired.select(
        *keys, n.cast("long").alias("n_chars"), "text",
        F.expr("left(text, char_length(text) - char_length(text) div 2)").alias("head"),
        F.expr("left(next, char_length(text) div 2)").alias("tail"),
    )
    units = halves.select(
        *keys, "n_chars", F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        unit_hashes(F.col("text")).alias("units"), F.char_length(solid(F.col("head"))).alias("shared"), unit_hashes(F.col("tail")).alias("more"),
    )
    # windows that lie in the first half's units are those of both texts; one less is taken over, so the rest is a window or more
    units = units.withColumn("same", F.greatest(F.lit(0), F.col("shared") - (K + W - 1)))
    rest = F.concat(F.slice("units", F.col("same") + 1, F.col("shared") - F.col("same")), F.col("more"))
    windows = units.select(
        *keys, "n_chars", "edited_sha256", "same",
        window_marks(gram_marks(F.col("units"))).alias("here"),
        window_marks(gram_marks(rest, base=F.col("same"))).alias("there"),
    )
    kept = lambda marks: F.array_distinct(hashes(F.array_distinct(marks)))
    marked = windows.select(
        *keys, "n_chars", "edited_sha256",
        kept(F.col("here")).alias("own"),
        kept(F.concat(F.slice("here", F.lit(1), F.col("same")), F.col("there"))).alias("other"),
    )
    followed = marked.withColumn("next", F.lead("own").over(order)).filter("late = 0")
    return followed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def oracle() -> str:
    """DuckDB SQL for ``op9_winnowing``; it spells out XXH64 for one character, which has pos most four bytes."""
    p1, p2, p3, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 2870177450012600261  # fixed values of XXH64
    times = lambda a, b: f"((({a})::UHUGEINT * {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    plus = lambda a, b: f"((({a})::UHUGEINT + {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    turned = lambda a, n: f"((({a})::UHUGEINT * {1 << n}::UHUGEINT) % 18446744073709551616::UHUGEINT + (({a}) >> {64 - n})::UHUGEINT)::UBIGINT"
    byte = lambda k: f"('0x' || substr(x, {2 * k - 1}, 2))::UBIGINT"
    steps = "\n".join(
        f"), b{k} AS (\n  SELECT u, x, n, CASE WHEN n < 4 AND n >= {k} THEN {times(turned(f'xor(v, {times(byte(k), p5)})', 11), p1)} ELSE v END AS v FROM b{k - 1}"
        for k in (1, 2, 3)
    )
    four = f"{byte(1)} + {byte(2)} * 256 + {byte(3)} * 65536 + {byte(4)} * 16777216"
    whole = plus(times(turned(f"xor(v, {times(four, p1)})", 23), p2), p3)
    leads = " + ".join(f"coalesce(lead(h, {j}) OVER w, 0) * {pow(BASE, K - 1 - j, PRIME)} % {PRIME}" for j in range(1, K))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars,
         coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS after,
         coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
  FROM documents WINDOW o AS (ORDER BY doc_id)
), e AS (
  SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(after, 1, n_chars // 2) AS edited FROM d
), t AS (
  SELECT doc_id, 0 AS part, regexp_replace(text, '[\\x09-\\x0D ]+', '', 'g') AS s FROM e
  UNION ALL SELECT doc_id, 1, regexp_replace(edited, '[\\x09-\\x0D ]+', '', 'g') FROM e
), c AS (
  SELECT doc_id, part, unnest(string_split(s, '')) AS u, generate_subscripts(string_split(s, ''), 1) - 1 AS pos FROM t WHERE s != ''
), b0 AS (
  SELECT u, hex(encode(u)) AS x, octet_length(encode(u)) AS n, {plus("42::UBIGINT + octet_length(encode(u))::UBIGINT", p5)} AS v FROM (SELECT DISTINCT u FROM c)
{steps}
), b4 AS (SELECT u, CASE WHEN n = 4 THEN {whole} ELSE v END AS v FROM b3
), b5 AS (SELECT u, {times("xor(v, v >> 33)", p2)} AS v FROM b4
), b6 AS (SELECT u, {times("xor(v, v >> 29)", p3)} AS v FROM b5
), b7 AS (SELECT u, xor(v, v >> 32) AS v FROM b6
), units AS (
  SELECT u, ((v % {PRIME})::BIGINT + CASE WHEN v >= 9223372036854775808 THEN {PRIME - 2**64 % PRIME} ELSE 0 END) % {PRIME} AS h FROM b7
), g AS (
  SELECT doc_id, part, pos, count(*) OVER (PARTITION BY doc_id, part) AS n, (h * {pow(BASE, K - 1, PRIME)} % {PRIME} + {leads}) % {PRIME} AS gram
  FROM c JOIN units USING (u) WINDOW w AS (PARTITION BY doc_id, part ORDER BY pos)
), m AS (
  SELECT doc_id, part, pos, greatest(1, n - {K - 1}) AS grams, gram * {SHIFT} + ({SHIFT - 1} - pos) AS mark FROM g WHERE pos < greatest(1, n - {K - 1})
), least_of AS (
  SELECT doc_id, part, pos, grams, min(mark) OVER (PARTITION BY doc_id, part ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS mark FROM m
), f AS (
  SELECT doc_id, part, mark >> 32 AS hash, min(pos) AS pos FROM least_of WHERE pos < greatest(1, grams - {W - 1}) GROUP BY ALL
), s AS (
  SELECT doc_id, part, count(*) AS n, string_agg(printf('%08x', hash), '' ORDER BY pos) AS spelled FROM f GROUP BY ALL
), ours AS (
  SELECT a.doc_id, count(*) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.part = 0 AND b.part = 1 AND a.hash = b.hash GROUP BY 1
), theirs AS (
  SELECT e.doc_id, count(*) AS n FROM e JOIN f a ON a.doc_id = e.doc_id AND a.part = 0 JOIN f b ON b.doc_id = e.next_id AND b.part = 0 AND b.hash = a.hash GROUP BY 1
)
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(own.spelled, '') AS fingerprint, coalesce(other.spelled, '') AS edited_fingerprint,
  CASE WHEN own.n IS NULL AND other.n IS NULL THEN 1.0::DOUBLE
    ELSE coalesce(ours.n, 0)::DOUBLE / (coalesce(own.n, 0) + coalesce(other.n, 0) - coalesce(ours.n, 0)) END AS near_edited,
  CASE WHEN own.n IS NULL AND next.n IS NULL THEN 1.0::DOUBLE
    ELSE coalesce(theirs.n, 0)::DOUBLE / (coalesce(own.n, 0) + coalesce(next.n, 0) - coalesce(theirs.n, 0)) END AS near_next
FROM e LEFT JOIN s own ON own.doc_id = e.doc_id AND own.part = 0 LEFT JOIN s other ON other.doc_id = e.doc_id AND other.part = 1
LEFT JOIN s next ON next.doc_id = e.next_id AND next.part = 0 LEFT JOIN ours ON ours.doc_id = e.doc_id LEFT JOIN theirs ON theirs.doc_id = e.doc_id"""
