"""Token ids of whole texts, in Arrow batches on the executors.

The ids are those that the ``tokenizers`` library gives by default with
``add_special_tokens=False``.  For a byte-level BPE file a memo saves work:
byte-level BPE never merges across the boundaries that its pre-tokenizer sets,
and such a boundary always stands before white space that follows a character
that is none.  A text is cut there, and each piece's ids are kept in a bounded
memo; a piece that is new is split by the vocabulary's own pattern and its parts
are encoded by the library's model.  In a text where no two characters of white
space are side by side, the boundaries are the spaces and line ends themselves.

A text that holds the string of an added token (which the library reads as that
token) goes to the library as a whole, and so does every text if the file has
another pre-tokenizer or a normalizer.

A memo lives as long as its Python worker and is cleared when full, so memory
does not grow with the input.

Defined cases: a null text is empty; an empty text has no ids but the end id; a
very long text is cut into pieces of the capacity; repeated rows and null ids
give a row each; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

shipped(__name__)

#: The characters with Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that a part of letters never takes in and that make a part of their own at the end of a piece.
MARKS = frozenset(",.;:?!")
#: Entries of a memo's younger generation, and the longest piece that it keeps.
MEMO, LONGEST = 400_000, 48


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: its own if it has one, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class _OtherWhite(Exception):
    """A text has white space side by side."""


def is_plain_byte_level(tokenizer_json: str) -> bool:
    """Whether a tokenizer file has the pre-tokenizer that the memo knows, no normalizer and no dropout."""
    import json

    spec = json.loads(tokenizer_json)
    before = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    return (
        before.get("type") == "ByteLevel"
        and before.get("add_prefix_space") is False
        and before.get("use_regex", True) is True
        and spec.get("normalizer") is None
        and spec.get("truncation") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("ignore_merges")
    )


def encoder(tokenizer_path: str, memo: bool = True) -> Callable[[str], bytes]:
    """text -> ids as little-endian unsigned 32-bit integers.  One per Python worker.

    ``memo=False`` encodes every text by the library as a whole.
    """
    import os
    import re
    import struct

    import regex

    held = sys.modules.setdefault("_token_memo", types.ModuleType("_token_memo"))
    known_as = f"{tokenizer_path}:{memo}"
    if (known := vars(held).get(known_as)) is not None:
        return known
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)

    def whole(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    with open(tokenizer_path, encoding="utf-8") as spec:
        memo = memo and is_plain_byte_level(spec.read())
    if not memo:
        vars(held)[known_as] = whole
        return whole

    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    model, letters = tokenizer.model, byte_letters()
    cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
    plain_start = re.compile(f"\n?[^{WHITE}]").match
    parts = regex.compile(PATTERN).findall

    class Memo(dict):
        """piece -> ids; ``made`` works out those of a new piece.

        Of two generations the older one goes when the younger is full, so what is used often stays.
        """

        def __init__(self, made: Callable[[str], bytes]):
            self.made, self.old = made, {}

        def __missing__(self, key: str) -> bytes:
            if (ids := self.old.get(key)) is None:
                ids = self.made(key)
                if len(key) > LONGEST:
                    return ids
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = ids
            return ids

    def of_letters(spelled: str) -> bytes:
        found = model.tokenize(spelled)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def of_word(w: str) -> bytes:
        return of_letters(w.encode("utf-8", "replace").decode("latin-1").translate(letters))

    words = Memo(of_word)
    joined = lambda p: b"".join(map(words.__getitem__, parts(p)))

    def of_spaced(p: str) -> bytes:
        if p.isalpha():  # letters alone are one part
            return of_letters(letters[32] + p) if p.isascii() else of_word(" " + p)
        if p[-1:] in MARKS and p[:-1].isalpha():  # and one mark behind them is another
            return spaced[p[:-1]] + words[p[-1]]
        if plain_start(p) is None:
            raise _OtherWhite
        return joined(p if p[0] == "\n" else " " + p)

    pieces = Memo(joined)  # what stands between two boundaries
    spaced = Memo(of_spaced)  # the same behind a space, which the key leaves out, or from a line end on

    def encode(text: str) -> bytes:
        if any(content in text for content in added):
            return whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return pieces[first] + b"".join(map(spaced.__getitem__, rest))
        except _OtherWhite:  # white space side by side: boundaries are looked for one by one
            return b"".join(map(pieces.__getitem__, cut(text)))

    vars(held)[known_as] = encode
    return encode


def batches(source: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[list[list]]:
    """Columns of bounded slices: at most 64 rows, fewer where texts are long."""
    for batch in source:
        rows = max(1, min(64, most * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pydict()


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document with its end id.

    Only documents above ``capacity`` are cut; the first piece is then the
    short one.  A null text is empty (its end id alone).
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        fields = [
            pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
            pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64()), pa.field("ids", pa.binary()),
        ]
        layout = pa.schema(fields if with_ids else fields[:-1])
        out: list[tuple] = []
        size = 0
        for columns in batches(source):
            for doc_id, text in zip(columns["doc_id"], columns["text"]):
                ids = encode(text or "") + end
                n = len(ids) // 4
                start, piece = 0, 0
                length = n if n <= capacity else n % capacity or capacity
                while start < n:
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, piece, start, length, zlib.crc32(part), part))
                    start, piece, length = start + length, piece + 1, capacity
                size += len(ids)
            if len(out) >= 4096 or with_ids and size >= 8 << 20:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), layout)], schema=layout)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), layout)], schema=layout)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
