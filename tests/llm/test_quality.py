import numpy as np
from pyspark.sql import functions as F

from healthloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.classify(docs, labels.filter(half)).join(labels.filter(~half), "doc_id").toPandas()
    assert len(got) > 100
    right = got.keep.to_numpy() == (got.quality == 1).to_numpy()
    assert right.mean() > 0.95
    assert got[got.quality == 1].keep.mean() > 0.97


def test_sparse_sites_are_near_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(h, None if h == "h0" else "p", float(p)) for h in ("h0", "h1", "h2", "h3") for p in rng.beta(8, 2, 200)]
    rows += [("bad", "p", float(p)) for p in rng.beta(2, 8, 200)] + [("tiny", "p", 0.01)]
    evidence = spark.createDataFrame(rows, "host string, path string, p double").withColumn("logit", F.log(F.col("p") / (1 - F.col("p")))).cache()
    got = quality.judged(evidence, quality.site_table(evidence)).groupBy("host").agg(F.avg("path_posterior").alias("m")).collect()
    m = {r.host: r.m for r in got}
    assert m["bad"] < 0.35 and m["h1"] > 0.7
    assert 0.45 < m["tiny"] < 0.85  # its own evidence is taken out, so it is the prior's


def test_no_labels_keep_everything(docs, spark, empty, repeated):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.keep_good(docs, none).columns == docs.columns
    assert quality.classify(empty, none).count() == 0
    assert quality.classify(repeated, none).count() == 7


def test_newton_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = rng.random(5000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))
    assert np.allclose(quality.newton(x, y.astype(float)), [1, 2, -1], atol=0.2)


def brute_posteriors(rows, weight=quality.SITE_WEIGHT):
    """rows: (host, path, p) -> posteriors of host and path, each without the row's own evidence, in plain sums."""
    from collections import defaultdict

    def moments(groups, above):
        n = sum(len(g) for g in groups.values())
        if len(groups) < 2 or n <= len(groups):
            return 100.0
        mean = {k: sum(g) / len(g) for k, g in groups.items()}
        inside = max(sum((v - mean[k]) ** 2 for k, g in groups.items() for v in g) / (n - len(groups)), 1e-9)
        between = sum(len(g) * (mean[k] - above[k]) ** 2 for k, g in groups.items())
        spread = (between - (len(groups) - 1) * inside) / max(n - sum(len(g) ** 2 for g in groups.values()) / n, 1e-9)
        return min(max(inside / spread, 1.0), 1e4) if spread > 1e-9 else 1e4

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, a, p in rows:
        hosts[h].append(p)
        paths[h, a].append(p)
    mean = sum(p for *_, p in rows) / len(rows)
    k_host = moments(hosts, {h: mean for h in hosts})
    above = {h: (sum(g) + k_host * mean) / (len(g) + k_host) for h, g in hosts.items()}
    k_path = moments(paths, {k: above[k[0]] for k in paths})
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    out = []
    for h, a, p in rows:
        host = (sum(hosts[h]) - p + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        path = (sum(paths[h, a]) - p + k_path * host) / (len(paths[h, a]) - 1 + k_path)
        own = logit(p) + weight * (logit(path) - logit(mean))
        out.append((host, path, 1 / (1 + np.exp(-own))))
    return out


def test_posteriors_are_those_of_plain_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{h}" if h else None, None if a == 2 else f"p{a}", float(np.clip(rng.beta(2 + h, 3), 1e-3, 0.999))) for h in range(4) for a in range(3) for _ in range(1 + 5 * h * a)]
    evidence = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, host string, path string, p double")
    evidence = evidence.withColumn("logit", F.log(F.col("p") / (1 - F.col("p")))).repartition(5).cache()
    got = quality.judged(evidence, quality.site_table(evidence)).orderBy("k").collect()
    want = brute_posteriors(rows)
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert np.allclose((r.host_posterior, r.path_posterior, r.posterior), w, atol=1e-9)
        assert r.keep == (w[2] >= quality.THRESHOLD)


def test_words_speak_where_measures_do_not(spark):
    """Two kinds of text of one shape: only their words tell them apart."""
    rng = np.random.default_rng(2)
    kinds = [["alder", "birch", "cedar", "maple"], ["amber", "coral", "ivory", "ochre"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2], 40)), "en", "s", k % 2) for k in range(400)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] < 200], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert np.mean([got[r[0]] == bool(r[4]) for r in rows if r[0] >= 200]) > 0.97


def test_repeated_labelled_rows_and_a_long_text(spark):
    rows = [(k % 7, "good words here" if k % 7 < 4 else "@@ ## !!", "en", "s") for k in range(70)] + [(50, "good words " * 200_000, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k < 4)) for k in range(7)], "doc_id long, quality int")
    first, again = (sorted(map(tuple, quality.classify(d, labels).collect()), key=str) for d in (docs, docs.repartition(9)))
    assert len(first) == 71 and [r[0] for r in first] == [r[0] for r in again]
    assert np.allclose([r[6] for r in first], [r[6] for r in again])
