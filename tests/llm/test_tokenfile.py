import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from healthloom.llm import entry, tokenfile


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([4, 64, 512]), st.sampled_from([50, 90, 100]))
def test_round_trip(values, block, percentile):
    ids = np.array(values, np.uint32)
    data = tokenfile.encode_segment(ids, block, percentile)
    assert tokenfile.decode_segment(data).tolist() == values
    if len(values) > 3:
        assert tokenfile.decode_segment(data, 2, len(values) - 3).tolist() == values[2:-1]


def test_outliers_go_to_the_exception_list():
    ids = np.full(512, 7, np.uint32)
    ids[100] = 2**31
    assert len(tokenfile.encode_segment(ids)) < 512 // 8 + 60


def test_files_in_order_with_places(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entry.tokenizer_path())
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs, path, entry.tokenizer_path())
    rows = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.doc_id)
    at = 0
    for k, (text, r) in enumerate(zip(texts, rows, strict=True)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (3 * k + 1, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_segments_of_a_shard_follow_each_other(spark, texts, docs, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs.coalesce(1), path, entry.tokenizer_path(), segment_ids=700)
    held = spark.read.parquet(path)
    assert held.groupBy("shard").count().agg({"count": "max"}).first()[0] > 5
    rows = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.doc_id)
    whole = sorted(tokenfile.read_tokens(spark, written_whole(docs, tmp_path), with_ids=True).collect(), key=lambda r: r.doc_id)
    assert rows == whole


def written_whole(docs, tmp_path):
    tokenfile.write_tokens(docs, str(tmp_path / "whole"), entry.tokenizer_path())
    return str(tmp_path / "whole")


def test_a_very_long_text_is_one_row(spark, tmp_path):
    from tokenizers import Tokenizer

    text = "long wordy line, and more\n" * 40_000
    df = spark.createDataFrame([(2, text), (1, "x")], "doc_id long, text string")
    tokenfile.write_tokens(df, str(tmp_path / "long"), entry.tokenizer_path())
    rows = {r.doc_id: r for r in tokenfile.read_tokens(spark, str(tmp_path / "long")).collect()}
    ids = [*Tokenizer.from_file(entry.tokenizer_path()).encode(text, add_special_tokens=False).ids, 0]
    assert (rows[2].start, rows[2].n_tokens) == (2, len(ids))
    assert rows[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.integers(1, 5), st.integers(1, 200), st.randoms())
def test_bits_go_in_and_out(width, rows, n, rnd):
    values = np.array([[rnd.getrandbits(width) for _ in range(n)] for _ in range(rows)], np.uint32)
    packed = tokenfile.pack_bits(values, width)
    assert packed.shape == (rows, (n * width + 7) // 8)
    assert (tokenfile.unpack_bits(packed, width, n) == values).all()


def test_empty_and_repeated(spark, empty, repeated, tmp_path):
    tokenfile.write_tokens(empty, str(tmp_path / "a"), entry.tokenizer_path())
    assert tokenfile.read_tokens(spark, str(tmp_path / "a")).count() == 0
    tokenfile.write_tokens(repeated, str(tmp_path / "b"), entry.tokenizer_path())
    rows = sorted(tokenfile.read_tokens(spark, str(tmp_path / "b")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 5, 5, 7, 7, 9]
