"""Chat formatting with schema fingerprints, in DataFrame functions only.

A layout says declaratively which nested field paths a table of conversations
has and how its turns read.  The paths of a table (or the keys of a JSON text,
row by row) are hashed; the fingerprint selects the layout.  All layouts become
canonical turns (conv_id, turn, role, text), which one template renders.

Template: ``<turn>### ROLE: TEXT</turn>\\n`` for each turn.  Inside roles and
texts the characters that control strings are made of are escaped one by one
(\\ < # : as \\b \\l \\h and, in roles, \\c), so no control string can occur there,
whatever a text says, and each text can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SEPARATOR, CLOSE = "<turn>### ", ": ", "</turn>\n"

#: Other names of the canonical roles (fixed values).
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths: a.b for fields of structs, a[] for elements of arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(found) -> str:
    """A hash of a set of paths."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """fields: the paths that make it; turns: array<struct<role,text>> of a row,
    or None if a row already is one turn; role, text: of such a row."""

    name: str
    fields: tuple[str, ...]
    turns: Callable[[], Column] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.fields)


def _turn(role, text) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _named(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(role)), role)


def _asked(instruction: str, more: str | None = None) -> Column:
    if more is None:
        return F.col(instruction)
    has = F.coalesce(F.col(more), F.lit("")) != ""
    return F.when(has, F.concat(F.coalesce(F.col(instruction), F.lit("")), F.lit("\n\n"), F.col(more))).otherwise(F.col(instruction))


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), lambda: F.transform("messages", lambda m: _turn(_named(m["role"]), m["content"]))),
    Layout("conversations", ("conversations[].from", "conversations[].value"), lambda: F.transform("conversations", lambda m: _turn(_named(m["from"]), m["value"]))),
    Layout("prompt, response", ("prompt", "response"), lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("response")))),
    Layout("prompt, completion", ("prompt", "completion"), lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))),
    Layout("question, answer", ("question", "answer"), lambda: F.array(_turn("user", F.col("question")), _turn("assistant", F.col("answer")))),
    Layout("instruction, output", ("instruction", "output"), lambda: F.array(_turn("user", _asked("instruction")), _turn("assistant", F.col("output")))),
    Layout("instruction, input, output", ("instruction", "input", "output"), lambda: F.array(_turn("user", _asked("instruction", "input")), _turn("assistant", F.col("output")))),
    Layout("system, prompt, response", ("system", "prompt", "response"), lambda: F.array(_turn("system", F.col("system")), _turn("user", F.col("prompt")), _turn("assistant", F.col("response")))),
)

_BY_FINGERPRINT = {x.fingerprint: x for x in LAYOUTS}
_KNOWN = {p for x in LAYOUTS for p in x.fields}


def layout_of(found) -> Layout:
    """The layout with the fingerprint of the known ones among these paths; where
    further known fields are there too, the layout of most fields they contain."""
    own = set(found) & _KNOWN
    if (hit := _BY_FINGERPRINT.get(fingerprint(own))) is not None:
        return hit
    inside = [x for x in LAYOUTS if set(x.fields) <= own]
    if not inside:
        raise ValueError(f"no layout for the fields {sorted(found)}")
    return max(inside, key=lambda x: len(x.fields))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout.

    Further columns are ignored.  Null text is kept as null, null or empty lists
    of turns have no rows.  An unknown layout raises ValueError.
    """
    layout = layout_of(paths(df.schema))
    if layout.turns is None:
        return df.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(layout.turns()).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


#: Layouts that JSON texts can have, with the schema to read each.
_JSON = {
    "messages": "messages array<struct<role:string,content:string>>",
    "conversations": "conversations array<struct<`from`:string,value:string>>",
} | {x.name: ", ".join(f"{f} string" for f in x.fields) for x in LAYOUTS if x.turns is not None and not any("[]" in f for f in x.fields)}


def _json_layouts(column: str) -> Column:
    """The name of a JSON text's layout: that with the fingerprint of its known key
    paths, else, as in ``layout_of``, that of most fields they contain; else null.

    The keys of all elements of a list of turns count, not only of the first."""
    top = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    lists = F.from_json(column, "messages array<map<string,string>>, conversations array<map<string,string>>")

    def inner(name: str) -> Column:
        keys = F.array_distinct(F.flatten(F.transform(lists[name], F.map_keys)))
        return F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)), F.array().cast("array<string>"))

    known = F.array(*[F.lit(p) for p in sorted(_KNOWN)])
    own = F.array_sort(F.array_intersect(F.concat(top, inner("messages"), inner("conversations")), known))
    mark = F.substring(F.sha2(F.array_join(own, "\n"), 256), 1, 16)
    chosen = [x for x in LAYOUTS if x.name in _JSON]
    exact = F.create_map(*[F.lit(y) for x in chosen for y in (x.fingerprint, x.name)])
    inside = [F.when(F.size(F.array_except(F.array(*[F.lit(f) for f in x.fields]), own)) == 0, x.name) for x in sorted(chosen, key=lambda x: -len(x.fields))]
    return F.coalesce(F.try_element_at(exact, mark), *inside)


def canonical_turns_json(df: DataFrame, column: str, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of JSON texts, whose layouts may differ by row.

    Each row's key paths are sorted and hashed, and the hash selects the row's
    layout; rows with further known fields take the layout of most of them.
    Elements of a list that lack a role or a text have null there.  Rows of no
    known layout have no turns here: ``unknown_json`` returns them, nulls too.  Rows that
    repeat give their turns each; an empty table gives none.
    """
    parsed = df.select(F.col(conv_id).alias("conv_id"), F.col(column).alias("_json"), _json_layouts(column).alias("_layout"))
    turns = None
    for layout in LAYOUTS:
        if layout.name in _JSON:
            fields = F.from_json("_json", _JSON[layout.name])
            part = parsed.filter(F.col("_layout") == layout.name).select("conv_id", fields.alias("_f")).select("conv_id", "_f.*")
            part = part.select("conv_id", F.posexplode(layout.turns()).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
            turns = part if turns is None else turns.unionByName(part)
    return turns


def unknown_json(df: DataFrame, column: str) -> DataFrame:
    """The rows, with all their columns, that ``canonical_turns_json`` has no layout
    for: null texts, texts that are no JSON object, objects of other fields."""
    return df.filter(_json_layouts(column).isNull())


def format_conversations(turns: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, mask: the spans (start, length in code points) of
    ``formatted`` that hold the texts of the roles ``learnt``.

    turns: conv_id, turn, role, text.  Turns go by (turn, role, text), nulls
    first; null text and role count as empty.  Rows that repeat a turn are turns
    of their own.  A null conv_id is one conversation.
    """
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(SEPARATOR))
    parts = given.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = parts.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.concat("head", "body", F.lit(CLOSE)).alias("part"),
        (F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
        F.col("role").isin(*learnt).alias("on"),
    )
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "part", "start", "length", "on"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["on"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["part"]), "").alias("formatted"), spans.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and learnt (the texts under the mask), read
    from ``formatted`` and ``mask`` alone.  A row for each row; an empty table gives none."""
    whole = F.split("formatted", CLOSE, -1)
    parts = F.slice(whole, 1, F.size(whole) - 1)

    def turn(p: Column) -> Column:
        p = F.substr(p, F.lit(len(OPEN) + 1), F.length(p))
        role = F.substring_index(p, SEPARATOR, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + len(SEPARATOR) + 1, F.length(p))).alias("text"))

    under = F.transform("mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(parts, turn).alias("turns"), F.array_join(under, "").alias("learnt"))
