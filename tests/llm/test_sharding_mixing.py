import zlib
from collections import Counter, defaultdict

import pytest

from healthloom.llm import mixing, sharding


def test_slots_and_growth(docs, texts):
    rows = {r.doc_id: r for r in sharding.shard_documents(docs, 5).collect()}
    slots = defaultdict(list)
    for k, text in enumerate(texts):
        r = rows[3 * k + 1]
        body = (text or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_removed_shard_moves_its_own_rows_only(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    names = [f"n{k}" for k in range(8)]
    before = sharding.assign(ids, "doc_id", names).select("doc_id", "shard").toPandas().set_index("doc_id").shard.map(lambda k: names[k])
    fewer = [n for n in names if n != "n3"]
    after = sharding.assign(ids, "doc_id", fewer).select("doc_id", "shard").toPandas().set_index("doc_id").shard.map(lambda k: fewer[k])
    moved = before.index[before != after.reindex(before.index)]
    assert (before[moved] == "n3").all()
    assert all(abs(n - 2500) < 250 for n in Counter(before).values())


def test_weights(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    got = Counter(r.shard for r in sharding.assign(ids, "doc_id", ["a", "b", "c"], [1.0, 3.0, 0.0]).collect())
    assert abs(got[1] / 20000 - 0.75) < 0.02 and not got[2]


def test_shards_empty_repeated_written(spark, empty, repeated, docs, tmp_path):
    assert sharding.shard_documents(empty).count() == 0
    rows = sharding.shard_documents(repeated, 2).collect()
    assert len(rows) == 7 and len({(r.shard, r.slot) for r in rows}) == 7
    sharding.write_shards(docs, str(tmp_path / "s"), "doc_id", ["a", "b", "c"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= 2 * sizes[s]]
        if not over:
            return {**capped, **{s: weight[s] * level for s in open_}}
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]


def test_mix(docs, texts):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    targets = brute_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.size == len((texts[(r.doc_id - 1) // 3] or "").encode().split())
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_copies_hold_the_words_taken(docs):
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    got = Counter()
    for r in copies.collect():
        got[r.doc_id] += len((r.text or "").encode().split())  # bytes: ASCII white space alone
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_inclusion_follows_the_odds(spark):
    rows = [(k, "a", 1, 1.6 if k % 2 else 0.4) for k in range(8000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double").cache()
    targets = spark.createDataFrame([("a", 8000, 4000.0)], "source string, source_size long, target double").cache()
    got = mixing.take(sized, targets).groupBy(mixing.F.col("doc_id") % 2).sum("taken").collect()
    got = {r[0]: r[1] for r in got}
    assert sum(got.values()) == 4000
    assert abs(got[1] / 4000 - 0.8) < 0.03


def test_mix_empty_repeated(empty, repeated):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(repeated).collect()
    assert len(rows) == 7 and all(r.source_size == 11 for r in rows)
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.5
    assert mixing.mixed_copies(repeated).count() > 0


def test_no_document_of_a_capped_source_is_sorted(spark):
    rows = [(k, "abc"[k % 3], " ".join(["w"] * (1 + k % 5))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized, lines = mixing._planned(docs, 1.5, 2.0, mixing.SEED)
    held = mixing._ranked(sized, lines, 2.0, mixing.SEED, mixing.CELLS)
    sorted_ = Counter(r.source for r in held.filter("cell = line_cell").collect())
    capped = {r.source for r in lines.collect() if r.target == 2 * r.source_size}
    assert capped == {"a"} and not sorted_["a"] and all(n < 60 for n in sorted_.values())
    for r in mixing.mix(docs).collect():
        assert r.source != "a" or r.taken == 2 * r.size


def test_a_full_line_cell_is_cut_again(spark):
    """With few cells and a low bound the line's cell is cut again and again; what is taken stays the same."""
    rows = [(k % 700, "ab"[k % 2], 1 + k % 9) for k in range(3000)] + [(5, "a", 3)] * 40
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4).cache()
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in "ab"}
    targets = spark.createDataFrame([(s, n, 1.37 * n) for s, n in size.items()], "source string, source_size long, target double").cache()
    got = {}
    for cells, most in ((1, 10**9), (2, 40), (4096, 10_000)):
        lines = mixing.source_lines(sized, targets, cells=cells, most=most).cache()
        if most == 40:
            assert lines.agg({"cells": "max"}).first()[0] > cells and lines.agg({"in_line": "max"}).first()[0] <= 60
        out = mixing.taken(sized, lines, mixing.on_line(sized, lines), cells=cells)
        got[cells] = sorted((r.source, r.doc_id, r.size, r.taken) for r in out.collect())
    assert got[1] == got[2] == got[4096]
    for s, n in size.items():
        assert sum(t for source, _, _, t in got[1] if source == s) == round(1.37 * n)


def test_only_ids_and_sizes_of_the_lines_cells_are_sorted(spark):
    rows = [(k, "abc"[k % 3], f"text {k} " + "w " * (k % 50)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized, lines = mixing._planned(docs, 1.5, 2.0, mixing.SEED)
    assert mixing.on_line(sized, lines).count() <= 30
    plan = mixing.mixed_copies(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "same" in plan  # the one over repeats


def test_a_very_long_text_in_the_mix(spark):
    docs = spark.createDataFrame([(1, "a", "word " * 300_000), (2, "b", "x y"), (3, "b", None)], "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert rows[1].size == 300_000 and rows[3].taken == 0
    assert sum(r.taken for r in rows.values()) in range(450_000, 450_006)
