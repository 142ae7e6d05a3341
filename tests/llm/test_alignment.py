import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from healthloom.llm import alignment, entry

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}

    def spans(text):
        """(ids and byte ranges of A, of B) by the libraries over the whole text, or nothing."""
        if not text:
            return [], []
        want = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [bytes(letter[c] for c in a.id_to_token(k)) for k in ids[0]], []
        for k in ids[1]:
            p = b.id_to_piece(k)
            parts[1].append(bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode())
        if any(b"".join(p) != want for p in parts):
            return [], []
        out = []
        for k, p in zip(ids, parts):
            at, found = 0, []
            for i, x in zip(k, p):
                found.append((i, at, at + len(x)))
                at += len(x)
            out.append(found)
        return out

    return spans


def brute(spans, texts):
    """One token pair at a time: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text."""
    rows, counts = [], Counter()
    for t in texts:
        a, b = spans(t)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 700 else sweep(a, b)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        i = j = 0
        for c in cuts:
            own = [], []
            while i < len(a) and a[i][2] <= c:
                own[0].append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= c:
                own[1].append(str(b[j][0]))
                j += 1
            groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
            low = c
        rows.append((len(a), len(b), groups, links))
        counts.update(links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in rows
    ]


def sweep(a, b):
    """The same links for long texts: each token with those of the other side from its first byte to its last."""
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


ODD = [
    "<|endoftext|> </s> <s>x<unk>", "two  spaces  and three   ", " leads", "ends ", " ", "  ", "\n \n", "a\n b\t c", "▁ in", "x▁y",
    "　wide 　white", "café naïve 你好世界 \U0001f600\U0001f600", "it's 12'345", "\x00nul \x1c sep", "<0x41> <0x0A>",
    "deadbeef" * 60, "กำนำ" * 9, "áé ​ zero", "İİ",
]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def rows_of(found):
    from pyspark.sql import functions as F

    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return {r.doc_id: tuple(r)[1:] for r in found.select("doc_id", *NAMES, sha).collect()}


@pytest.mark.parametrize("looked_up", [alignment.LOOKED_UP, 300, 0])
def test_equals_brute_force_whatever_is_broadcast(spark, docs, texts, libraries, looked_up):
    every = [*texts, *ODD]
    more = spark.createDataFrame([(3 * (len(texts) + k) + 1, t, "en") for k, t in enumerate(ODD)], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").unionByName(more.select("doc_id", "text", "lang"))
    want = brute(libraries, every)
    got = rows_of(alignment.align_and_count(df, A, B, looked_up))
    assert got == {3 * k + 1: w for k, w in enumerate(want)}
    assert any(w[0] == 0 and t for w, t in zip(want, every)) and any(w[3] > w[0] for w in want)


def test_query_on_a_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(table, brute(libraries, [r.text for r in table]))}
    assert {r.doc_id: tuple(r)[1:] for r in entry.op11_token_alignment(spark, sf).collect()} == want


def test_empty_and_repeated(empty, repeated, libraries):
    assert alignment.align_and_count(empty, A, B).count() == 0
    rows = repeated.collect()
    want = sorted(brute(libraries, [r.text for r in rows]))
    found = alignment.align_and_count(repeated, A, B)
    assert found.count() == len(rows)
    assert sorted(tuple(r)[1:] for r in found.select("doc_id", *NAMES).collect()) == [w[:-1] for w in want]


def test_a_very_long_text(spark, libraries):
    rnd = random.Random(4)
    texts = [" ".join(f"{rnd.choice('abcdef')}{rnd.randrange(3000)}" for _ in range(200_000)), "Zm9v+" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(alignment.align_and_count(df, A, B))
    assert [got[0], got[1]] == brute(libraries, texts)


def test_components_are_the_groups_between_common_ends():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.randint(1, 30)
        a, b = (sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n)), n}) for _ in range(2))
        common = [0, *sorted({*a} & {*b})]
        want = [([i for i, e in enumerate(a) if x < e <= y], [j for j, e in enumerate(b) if x < e <= y]) for x, y in zip(common, common[1:])]
        found = alignment.components(a, b)
        assert found == want
        starts = lambda ends: [0, *ends[:-1]]
        pairs = [(i, j) for i, (s, e) in enumerate(zip(starts(a), a)) for j, (t, f) in enumerate(zip(starts(b), b)) if s < f and t < e]
        assert sorted(p for g in found for p in alignment.links(g, a, b)) == pairs
