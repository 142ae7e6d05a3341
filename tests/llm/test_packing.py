import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from healthloom.llm import entry, packing, tokens


@pytest.fixture(scope="module")
def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entry.tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_memo_gives_the_librarys_ids(texts, ids_of):
    encode = tokens.encoder(entry.tokenizer_path())
    spaces = ["a  b", "   x", "  two", "end  ", "\r\n\r\nx", "\x85\x85 y", "a\x1c b", "'s 'll it's'", "1 23  456", "　\n\n z"]
    spaces += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "a\n \nb", "a\n b", "a \nb", "x\n", "\nx", "don't, can't. we'll;"]
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice(" \n\t  \x1cab1'é.,s") for _ in range(60)) for _ in range(300)]
    for text in [*texts, *spaces, *mixed]:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == ids_of(text)[:-1], repr(text)


def test_other_tokenizer_files_go_to_the_library(texts, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    spec = json.load(open(entry.tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    own = tmp_path / "prefixed.json"
    own.write_text(json.dumps(spec), encoding="utf-8")
    for path in (str(own), public_tokenizers.path("word_bpe_49k.json")):
        encode, library = tokens.encoder(path), Tokenizer.from_file(path)
        for text in texts:
            assert np.frombuffer(encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """The rule itself, a piece at a time: gaps of all sequences that come out of it, by content."""
    left = sorted(lengths, reverse=True)
    open_ = []
    large = [n for n in left if 3 * n > capacity]
    while large:
        n = large.pop(0)
        mate = next((m for m in large if n + m <= capacity), None)
        if mate is not None:
            large.remove(mate)
        open_.append([n] if mate is None else [n, mate])
    for n in (n for n in left if 3 * n <= capacity):
        fits = [s for s in open_ if capacity - sum(s) >= n]
        if fits:
            min(fits, key=lambda s: capacity - sum(s)).append(n)
        else:
            open_.append([n])
    return open_


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_groups_at_once_need_as_many_sequences_as_one_piece_at_a_time(lengths):
    want = one_by_one(lengths, 60)
    got = packing.best_fit(Counter(lengths), 60)
    assert sum(times for _, times in got) == len(want)
    gaps = Counter()
    for pattern, times in got:
        gaps[60 - sum(n * c for n, c in pattern)] += times
    assert gaps == Counter(60 - sum(s) for s in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=200))
def test_patterns_hold_every_piece_once(lengths):
    counts = Counter(lengths)
    used, bins = Counter(), 0
    for pattern, times in packing.best_fit(counts, 60):
        assert times > 0 and sum(n * c for n, c in pattern) <= 60
        assert sum(c for n, c in pattern if 3 * n > 60) <= 2
        for n, c in pattern:
            used[n] += c * times
        bins += times
    assert used == counts
    assert bins <= 1 + 1.5 * -(-sum(lengths) // 60) + 1


def test_pairs_take_the_largest_partner_that_fits():
    got = packing.match_large(Counter({60: 1, 40: 1, 35: 1}), 100)
    assert got == [((60, 40), 1), ((35,), 1)]


def test_all_documents_are_packed(docs, texts, ids_of):
    capacity = 512
    rows = packing.pack_documents(docs, entry.tokenizer_path(), capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids = ids_of(text)
        parts = sorted(by_doc[3 * k + 1], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        if len(ids) <= capacity:
            assert len(parts) == 1
        assert all(p.length == capacity for p in parts[1:])
        at = 0
        for p in parts:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // capacity) * 1.1 + 1


def test_sequences_hold_the_ids(docs, texts, ids_of):
    pieces = tokens.cut_pieces(docs, entry.tokenizer_path(), 512, with_ids=True).cache()
    packed = packing.pack(pieces, 512)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed, 512).collect()}
    rows = packed.collect()
    assert len(rows) > len(texts)
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length].astype("<u4").tobytes() == bytes(r.ids)


def test_empty_and_repeated(empty, repeated):
    assert packing.pack_documents(empty, entry.tokenizer_path()).count() == 0
    assert packing.pack_documents(repeated, entry.tokenizer_path()).count() == 7


def test_a_wrong_length_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 99)], "doc_id long, piece int, length long"), 60)
