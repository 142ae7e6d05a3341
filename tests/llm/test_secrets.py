import hashlib
import math
import random
import re


from healthloom.llm import entry, secrets

ASSIGN = re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def brute_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


def brute_entropy(text, base):
    out, text = [], text or ""
    masked = text
    for p, size in secrets.TAKEN_OUT:
        masked = re.sub(p, " " * size, masked, flags=re.ASCII)
    pieces = []
    for m in CANDIDATE.finditer(masked):
        at = m.start()
        for a, _, b in sorted(x for x in base if x[0] < m.end() and m.start() < x[2]):
            pieces.append((at, a))
            at = max(at, b)
        pieces.append((at, m.end()))
    for a, b in pieces:
        s = masked[a:b] if b > a else ""
        if len(s) < 20 or any(re.fullmatch(p, s) for p in secrets.ALLOWED):
            continue
        kind = "hex" if re.fullmatch("[0-9A-Fa-f]+", s) else "alnum" if re.fullmatch("[A-Za-z0-9]+", s) else "base64"
        high = []
        for i in range(len(s) - 19):
            w = s[i : i + 20]
            h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if h >= secrets.THRESHOLDS[kind] - 1e-9:
                high.append(i)
        if high:
            out.append((a + high[0], 3, a + high[-1] + 20))
    return out


def make(rnd):
    parts = []
    for _ in range(rnd.randint(0, 14)):
        word = rnd.choice(["password", "Passwd", "SECRET", "token", "apikey", "api_key", "API-KEY", "secretoken"])
        value = "".join(rnd.choice("abcXYZ019+/_.=-é\"' ") for _ in range(rnd.randint(0, 12)))
        high = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rnd.randint(15, 60)))
        parts += [
            word + rnd.choice(["=", ":", '": "', "' = '", "  :=", "", " = "]) + value,
            "AKIA" + "".join(rnd.choice("AKI09Z") for _ in range(rnd.randint(0, 24))),
            "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(10, 40))),
            "😀é" * rnd.randint(0, 3), high, "plain prose words",
            "aaaaaaaaaaaaaaaaaaaaaa1", "123e4567-e89b-12d3-a456-426614174000", rnd.choice(["dummy_", "docs/Example/KEY=", "xxxxx-", f"{rnd.getrandbits(96):024x}-"]) + high,
            high + "-token=" + high,
        ]
        rnd.shuffle(parts)
    return rnd.choice(["", " ", "\n"]).join(parts) if rnd.random() < 0.2 else " ".join(parts)


def spelled(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_against_brute_force(spark, texts):
    rnd = random.Random(5)
    rows = list(enumerate([*texts, *(make(rnd) for _ in range(300)), "token=abcdef " * 2000]))
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    extra = 0
    for r in found:
        base = brute_base(rows[r.doc_id][1])
        assert [tuple(s) for s in r.base] == base, rows[r.doc_id][1]
        more = brute_entropy(rows[r.doc_id][1], base)
        assert [tuple(s) for s in r.every] == sorted(base + more), rows[r.doc_id][1]
        extra += len(more)
    assert extra > 100


def test_sql_twin(spark, texts, tmp_path):
    import duckdb

    rnd = random.Random(9)
    rows = list(enumerate([*texts, *(make(rnd) for _ in range(150))]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: tuple(r) for r in entry.op8_secret_spans(spark, str(tmp_path)).collect()}
    assert {r[0]: tuple(r) for r in con.sql(secrets.oracle()).fetchall()} == got
    assert sum("entropy" in r[5] for r in got.values()) > 20


def test_many_matches_cost_little_more_than_few(spark):
    import time

    took = {}
    for n in (500, 500, 32_000):
        df = spark.createDataFrame([(1, "token=abcdef " * n)], "doc_id long, text string")
        began = time.time()
        assert len(secrets.find_secrets(df).first().base) == n
        took[n] = time.time() - began
    assert took[32_000] < 12 * max(took[500], 1.0)


KEY = "aZ9kQ3vX7mT1pL5wR8cB2nD6"


def test_a_key_beside_what_is_taken_out_is_found(spark):
    rows = ["docs/example/KEY_NAME=" + KEY, "dummy_" + KEY, "0123456789abcdef01234567-" + KEY, "token=abcdef1 " + KEY]
    for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect():
        spans = [s for s in r.every if s.kind == 3]
        assert len(spans) == 1 and KEY in rows[r.doc_id][spans[0].start : spans[0].stop], rows[r.doc_id]


def test_one_long_run_costs_in_proportion_to_its_length(spark):
    import time

    rnd = random.Random(1)
    took = {}
    for n in (20_000, 20_000, 1_000_000):
        run = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwyz2468") for _ in range(n))
        df = spark.createDataFrame([(1, run)], "doc_id long, text string")
        began = time.time()
        spans = secrets.find_secrets(df).first().every
        assert sum(s.stop - s.start for s in spans if s.kind == 3) > 0.99 * n  # a placeholder may stand in it by chance
        took[n] = time.time() - began
    assert took[1_000_000] < 100 * max(took[20_000], 1.0)


def test_prose_and_allow_list_stay_silent(spark):
    calm = ["the internationalization of telecommunications", "123e4567-e89b-12d3-a456-426614174000", "src/main/java/com/acme/widgets/Loader", "A" * 500]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(calm)), "doc_id long, text string")).collect()
    assert not any(r.every for r in rows)


def test_redaction(spark):
    df = spark.createDataFrame([("é password=hunter22 end",)], "text string")
    found = df.select("text", secrets.scan(df.text)["every"].alias("spans"))
    assert found.select(secrets.redacted(found.text, found.spans)).first()[0] == "é [secret] end"


def test_query_and_odd_rows(spark, empty, repeated, tmp_path):
    repeated.write.parquet(str(tmp_path / "documents.parquet"))
    rows = entry.op8_secret_spans(spark, str(tmp_path)).collect()
    assert len(rows) == 7 and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.find_secrets(empty).count() == 0
