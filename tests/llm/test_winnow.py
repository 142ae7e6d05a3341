import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from healthloom.llm import winnow


def brute_marks(text):
    """(hash, position) chosen in every window."""
    units = [u for w in re.split(r"[ \t\n\r\f\v]+", text) if w for u in re.findall(r".{1,%d}" % winnow.UNIT, w)]
    h = []
    for u in units:
        v = xxhash.xxh64_intdigest(u.encode(), 42)
        h.append((v - (1 << 64) if v >> 63 else v) % winnow.PRIME)
    grams = []
    for i in range(max(1, len(h) - winnow.K + 1) if h else 0):
        v = 0
        for j in range(winnow.K):
            v = (v * winnow.BASE + (h[i + j] if i + j < len(h) else 0)) % winnow.PRIME
        grams.append(v)
    out = []
    for i in range(max(1, len(grams) - winnow.W + 1) if grams else 0):
        window = grams[i : i + winnow.W]
        least = min(window)
        at = i + max(k for k, v in enumerate(window) if v == least)
        if (least, at) not in out:
            out.append((least, at))
    return out


def brute(texts):
    rows = []
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, following = ({m[0] for m in brute_marks(x)} for x in (t, edited, after))
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        rows.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), like(own, other), like(own, following)))
    return rows


def clean(texts):
    """Java's default white space differs from Python's beyond ASCII; the brute force keeps to ASCII."""
    return [t for t in texts if t is None or len(t) < 30_000]


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_edits_and_neighbours(spark, texts, bucket_rows, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(winnow.neighbours, "__defaults__", (bucket_rows,))
    texts = clean(texts)
    ids = sorted(random.Random(2).sample(range(-500, 10**12), len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in winnow.edited_likeness(df).collect()}
    for i, want in zip(ids, brute(texts), strict=True):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == want[:2]
        assert (r.near_edited, r.near_next) == pytest.approx(want[2:])
    same = {}
    for i, t in zip(ids, texts):
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_positions_and_the_match_guarantee(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    shared = " ".join(word() for _ in range(winnow.K + winnow.W))  # at least K + W - 1 units
    rows = []
    for k in range(40):
        a, b = (" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(2))
        rows.append((k, f"{a} {shared} {b}"))
    got = winnow.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert list(zip(r.hashes, r.positions)) == brute_marks(rows[r.doc_id][1])
    assert all(set(a.hashes) & set(b.hashes) for a in got for b in got)


def test_long_text_and_odd_rows(spark, empty, repeated):
    one = spark.createDataFrame([(1, "word " * 30_000)], "doc_id long, text string")
    assert winnow.edited_likeness(one).first().near_edited == 1.0
    assert winnow.edited_likeness(empty).count() == 0
    rows = winnow.edited_likeness(repeated).collect()
    assert len(rows) == 7 and len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)


def test_all_null_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "c d")], "doc_id long, text string")
    assert winnow.edited_likeness(rows).count() == 2


def test_likeness_of_empty(spark):
    e, a = F.array().cast("array<bigint>"), F.array(F.lit(1).cast("bigint"))
    assert spark.range(1).select(winnow.likeness(e, e), winnow.likeness(e, a)).first() == (1.0, 0.0)


def test_runs_without_white_space_match_at_every_offset(spark):
    rnd = random.Random(9)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(600))
    rows = [(k, "x" * k + text) for k in range(8)] + [(8, text[:50] + "x" + text[50:])]
    got = {r.doc_id: set(r.hashes) for r in winnow.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[0] & got[k]) > 0.7 * len(got[0]) for k in got)


def test_sql_twin(spark, texts, tmp_path):
    import duckdb

    from healthloom.llm import entry

    rows = list(enumerate(clean(texts)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: tuple(r) for r in entry.op9_winnowing(spark, str(tmp_path)).collect()}
    assert {r[0]: tuple(r) for r in con.sql(winnow.oracle()).fetchall()} == got


def test_first_half_is_shared_with_the_edited_text(spark):
    """Positions may count from anywhere, and where the halves meet nothing is lost or made up, whatever is shared."""
    sizes = sorted({2 * (winnow.K + winnow.W + d) for d in (-2, -1, 0, 1, 2)} | {0, 1, 31, 33, 62, 66, 200})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé \n") for _ in range(n)) for n in sizes] + [" " * 90, "x" * 300, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in winnow.edited_likeness(df).collect()}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want = list(dict.fromkeys(h for h, _ in brute_marks(edited)))
        assert got[k].edited_fingerprint == "".join(f"{h:08x}" for h in want), k
    units = winnow.unit_hashes(F.lit("abcdefghijklmnopqrstuvwxyz"))
    whole, moved = spark.range(1).select(winnow.positions(winnow.gram_marks(units)), winnow.positions(winnow.gram_marks(units, base=7))).first()
    assert whole == list(range(11)) and moved == list(range(7, 18))
