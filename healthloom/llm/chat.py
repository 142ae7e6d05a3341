"""Chat formatting by schema fingerprints (DataFrame only).

A record's layout is told by a fingerprint: the XXH64 of its sorted nested
field paths.  A declarative mapping per fingerprint names where the turns are
and what their role and text are called; one rule per mapping, written with
DataFrame functions, turns the layout into canonical turns (role, text).  New
layouts are new mappings, not new code.

The template marks a turn as ``<s>[role] text [/]</s>`` and a line end.  Marks
can't be forged: inside texts and roles ``<`` is written ``<lt>``, ``[`` is
``<lb>`` and ``]`` is ``<rb>``, so no control string of this or another
template with one of them survives, and the replacement is undone in the
reverse order.  The loss
mask covers the texts of the roles in ``TRAINED``.

Defined cases: a null text is empty; a null role is the empty role; a null
turn number comes first; equal turn numbers go by role and text; repeated rows
are repeated turns; a conversation without turns does not occur; a very long
text is formatted whole; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import before_each, let

TRAINED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"
#: Escapes, applied in this order and undone in the reverse order; the first keeps the marks of the others apart.
ESCAPES = (("<", "<lt>"), ("[", "<lb>"), ("]", "<rb>"))


# --- layouts ---------------------------------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> int:
    """XXH64 (seed 42, signed) of the sorted paths, as the SQL function gives it."""
    import xxhash

    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Mapping:
    """Where turns are.  ``turns``: an array column with ``role`` and ``text`` fields, roles renamed by ``roles``;
    or ``pairs``: (role, column) in order, where empty columns give no turn."""

    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    pairs: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def over(self, field: Callable[[str], Column]) -> Column:
        """The canonical turns, given how a field of the record is reached."""
        if self.turns:

            def role(r: Column) -> Column:
                return F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in self.roles], r)

            return F.transform(
                field(self.turns), lambda t: F.struct(role(t[self.role]).alias("role"), t[self.text].alias("text"))
            )
        made = []
        for who, columns in self.pairs:
            filled = F.concat_ws("\n", *[F.nullif(field(c), F.lit("")) for c in columns])
            made.append(F.struct(F.lit(who).alias("role"), filled.alias("text")))
        # an empty system column is no turn; empty prompts and answers are
        return F.filter(F.array(*made), lambda t: (t["text"] != "") | (t["role"] != "system"))


MAPPINGS = (
    Mapping(("prompt", "response"), pairs=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), pairs=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("instruction", "input", "output"), pairs=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("system", "instruction", "input", "output"), pairs=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("question", "answer"), pairs=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping(("turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping(("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
)


def mapping_for(df: DataFrame, ignore: tuple[str, ...] = (), mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping of a table's schema; columns in ``ignore`` (ids and the like) are no part of the layout."""
    layout = T.StructType([f for f in df.schema.fields if f.name not in ignore])
    known = {fingerprint(list(m.paths)): m for m in mappings}
    found = known.get(fingerprint(field_paths(layout)))
    if found is None:
        raise ValueError(f"no mapping for the layout {field_paths(layout)}")
    return found


def canonical_turns(df: DataFrame, ids: tuple[str, ...] = (), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``ids`` and ``turns`` (canonical) of a table in a known layout."""
    return df.select(*ids, mapping_for(df, ids, mappings).over(F.col).cast(TURNS).alias("turns"))


def canonical_json(lines: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``turns`` and ``schema_fp`` of a column ``value`` of JSON records of mixed layouts.

    Each record's own paths are hashed (top-level names, and the names inside
    the first element of an array); a record of an unknown layout has null turns.
    """
    kinds = {
        m: T.StructType(
            [T.StructField(m.turns, T.ArrayType(T.StructType([T.StructField(m.role, T.StringType()), T.StructField(m.text, T.StringType())])))]
            if m.turns
            else [T.StructField(c, T.StringType()) for _, cs in m.pairs for c in cs]
        )
        for m in mappings
    }
    top = F.json_object_keys("value")
    nested = lambda key: F.json_object_keys(
        F.call_function("get_json_object", F.col("value"), F.concat(F.lit("$."), key, F.lit("[0]")))
    )
    spelled = F.flatten(
        F.transform(
            top,
            lambda key: F.coalesce(
                F.transform(nested(key), lambda inner: F.concat(key, F.lit("[]."), inner)), F.array(key)
            ),
        )
    )
    keyed = lines.withColumn("schema_fp", F.xxhash64(F.array_join(F.array_sort(spelled), "\n")))
    turns = F.lit(None).cast(TURNS)
    for m, kind in kinds.items():
        record = F.from_json("value", kind)
        turns = F.when(F.col("schema_fp") == fingerprint(list(m.paths)), _over(record, m)).otherwise(turns)
    return keyed.withColumn("turns", turns)


def _over(record: Column, mapping: Mapping) -> Column:
    return let(record, lambda r: mapping.over(lambda name: r[name]))


def gathered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns of a table with a row per turn (the record is a conversation, so its turns meet in one row)."""
    entry = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(entry), _in_order).alias("held"))
    return grouped.select("conv_id", F.transform("held", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _in_order(a: Column, b: Column) -> Column:
    """Turn (null first), then role, then text."""
    key = lambda x: (x["turn"].isNotNull().cast("int"), F.coalesce(x["turn"].cast("long"), F.lit(0)), x["role"], x["text"])
    order = F.lit(0)
    for u, v in reversed(list(zip(key(a), key(b)))):
        order = F.when(u < v, -1).when(u > v, 1).otherwise(order)
    return order


# --- template --------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def render(turns: Column) -> Column:
    """Canonical turns -> one formatted string."""
    one = lambda t: F.concat(
        F.lit("<s>["), escape(F.coalesce(t["role"], F.lit(""))), F.lit("] "), escape(F.coalesce(t["text"], F.lit(""))), F.lit(" [/]</s>\n")
    )
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The formatted string -> canonical turns.  Reads the marks alone."""
    blocks = F.filter(F.split(formatted, r" \[/\]</s>\n", -1), lambda b: b != "")

    def turn(b: Column) -> Column:
        close = F.instr(b, "] ")
        return F.struct(
            unescape(F.substring(b, F.lit(5), close - 5)).alias("role"),
            unescape(F.substring(b, close + 2, F.char_length(b))).alias("text"),
        )

    return F.transform(blocks, turn)


def loss_spans(formatted: Column, trained: tuple[str, ...] = TRAINED) -> Column:
    """start, stop (code points of the formatted string) of the texts under the loss mask."""
    tail = len(" [/]</s>\n")

    def spans(blocks: Column) -> Column:
        starts = before_each(F.transform(blocks, lambda b: F.char_length(b) + tail))

        def span(b: Column, at: Column) -> Column:
            close = F.instr(b, "] ")
            role = unescape(F.substring(b, F.lit(5), close - 5))
            own = F.struct((at + close + 1).cast("int").alias("start"), (at + F.char_length(b)).cast("int").alias("stop"))
            return F.when(role.isin(*trained), own)

        return F.filter(F.zip_with(blocks, starts, span), lambda s: s.isNotNull())

    return let(F.filter(F.split(formatted, r" \[/\]</s>\n", -1), lambda b: b != ""), spans)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans): what a trainer reads."""
    formatted = turns.select("conv_id", render(F.col("turns")).alias("formatted"))
    return formatted.withColumn("loss", loss_spans(F.col("formatted")))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns, from the formatted strings and their loss spans alone."""
    turns = F.col("turns")
    masked = F.array_join(
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), ""
    )
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    held = formatted.withColumns({"turns": parse(F.col("formatted")), "masked": masked})
    return held.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    """DuckDB SQL for ``op6_chat_format``."""
    escaped = "replace(replace(replace({0}, '<', '<lt>'), '[', '<lb>'), ']', '<rb>')"
    order = "ORDER BY turn NULLS FIRST, encode(role), encode(text)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS spelled,
         coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS masked,
         sum(length({escaped.format("role")}) + length({escaped.format("text")}) + {len("<s>[] ") + len(" [/]</s>") + 1})::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spelled) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256, formatted_chars FROM g"""
