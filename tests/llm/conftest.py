import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, shard string, size string"


def make_texts():
    rnd = random.Random(7)
    syllables = ["an", "ther", "ou", "st", "ion", "ré", "ß", "ti"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rnd.choice([3, 40, 200])) for _ in range(30)]
    long = prose(6000)
    near = [base[1] + " tail", base[1] + " other tail"]
    odd = [
        None, "", " ", "\t\n ", "x", "A b c", "😀" * 9, "a  b   c\n\nd  e", "<|endoftext|> it's 12 o'clock",
        'api_key = "abcDEF123+/=" token: 12345 PASSWORD:=hunter2hunter2', "AKIA" + "Z9" * 10 + " AKIA12",
        "é" * 3 + " deadbeef" * 4 + " " + "0123456789abcdef" * 3, "key q8Zt3LmX0vBn7RkY2wPd5HsJ end", "ABC", "abc", "aBc",
        'secret=token"=abcdefgh', "\x1c\x1d fs", "nospace" * 400, "tab\tin\vit\fall",
    ]
    return base + [long, long.upper(), base[0], base[0], base[2].upper()] + near + odd


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Texts with extra, clashing columns; a source that has most rows, a null source."""
    rows = [
        (3 * k + 1, t, "en", None if k % 11 == 5 else f"s{k % 3 if k % 2 else 0}", 0, "x", "y", "z") for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark):
    """Repeated rows, null ids, ties."""
    rows = [(5, "Same words here"), (5, "Same words here"), (None, "same words HERE"), (7, None), (7, None), (9, "other one"), (None, None)]
    return spark.createDataFrame([(*r, "en", None, 1, "a", "b", "c") for r in rows], SCHEMA)
