"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is a set of nested field paths with a mapping to turns. The fingerprint of a row is the SHA-256 of
the sorted known paths that hold a value in it; each layout claims the fingerprints of its required paths
with any subset of its optional ones. So one table may mix layouts, and unknown columns do not matter.
The mapping is an expression over columns, and all work stays in built-in functions.

Formatting keeps one text for each conversation. Every turn is `<|turn|>role LF text <|end|> LF`; control
strings inside roles and texts are escaped with a backslash letter, so they can never be read as marks, and
`read_back` returns exactly what went in. The loss mask is a list of spans (start, length) in code points.

Defined cases: null texts are empty; null roles are empty; turns go by (order, role, text), null order first,
so repeated rows stay as repeated turns; a row that fits no layout has null `layout` and no turns;
an empty table gives an empty table. A conversation is one value, so it must fit a row.
"""

from __future__ import annotations

import hashlib
import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

TURN, END = "<|turn|>", "<|end|>"
#: Control strings that texts may not show unescaped.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Paths (`a`, `a.b`, `a[].b`) and how turns come from them: (role or role path, text path) each."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[str]:
        subsets = itertools.chain.from_iterable(
            itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [hash_of(self.required + more) for more in subsets]


def hash_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Role words of the shared-conversation layout, as fixed values.
SHARED = (("human", "user"), ("gpt", "assistant"), ("system", "system"))
LAYOUTS = (
    Layout("turn", (), ("role", "text"), (("@role", "text"),)),
    Layout("messages", ("messages[].role",), ("messages[].content",), (("@messages[].role", "messages[].content"),)),
    Layout("shared", ("conversations[].from",), ("conversations[].value",),
           (("@conversations[].from", "conversations[].value"),), SHARED),
    Layout("instruction", ("instruction",), ("input", "output"),
           (("user", "instruction\n\ninput"), ("assistant", "output"))),
    Layout("prompt", ("prompt",), ("response",), (("user", "prompt"), ("assistant", "response"))),
    Layout("nested_prompt", ("prompt.text",), ("response.text",),
           (("user", "prompt.text"), ("assistant", "response.text"))),
)


def _has(schema: DataType, path: str) -> bool:
    """True if the path leads to a string in this schema."""
    for step in path.split("."):
        name, listed = step.removesuffix("[]"), step.endswith("[]")
        if not isinstance(schema, StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
        if listed:
            if not isinstance(schema, ArrayType):
                return False
            schema = schema.elementType
    return isinstance(schema, StringType)


def _column(path: str) -> Column:
    return F.col(".".join(f"`{s}`" for s in path.split(".")))


def _present(path: str) -> Column:
    if "[]." not in path:
        return _column(path).isNotNull()
    outer, inner = path.split("[].")
    return F.coalesce(F.exists(_column(outer), lambda m: m[inner].isNotNull()), F.lit(False))


def _turns(layout: Layout, schema: StructType) -> Column:
    """Array of (role, text) by the layout's mapping; paths the schema lacks read as null."""

    def turn(role: Column, text: Column) -> Column:
        for old, new in layout.roles:
            role = F.when(role == old, new).otherwise(role) if old != new else role
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def value(path: str) -> Column:
        return _column(path) if _has(schema, path) else F.lit(None).cast("string")

    (role, text), *rest = layout.turns
    if "[]." in text:
        outer, inner = text.split("[].")
        inner_role = role.split("[].")[1]
        has_text = _has(schema, text)
        return F.transform(_column(outer), lambda m: turn(
            m[inner_role], m[inner] if has_text else F.lit(None).cast("string")))
    return F.array(*[
        turn(value(r[1:]) if r.startswith("@") else F.lit(r), F.array_join(
            F.array_compact(F.array(*[value(p) for p in t.split("\n\n")])), "\n\n"))
        for r, t in [(role, text), *rest]])


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`records` with `fingerprint`, `layout` (null if none fits) and `turns` (role, text).

    Where no layout has the exact fingerprint, as other columns share names with layouts, the one with the longest
    required paths among those present is taken and the other columns are ignored.
    """
    schema = records.schema
    usable = [x for x in layouts if all(_has(schema, p) for p in x.required)
              and all(_has(schema, t) for r, t in x.turns[:1] if not x.required)]
    paths = sorted({p for x in layouts for p in x.required + x.optional if _has(schema, p)})
    shown = [F.when(_present(p), F.lit(p)) for p in paths]
    mark = F.sha2(F.concat_ws("\n", *shown) if shown else F.lit(""), 256)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in sorted(usable, key=lambda x: sum(map(len, x.required))):
        known = [_present(p) for p in x.required or x.optional if _has(schema, p)]
        fits = functools.reduce(Column.__and__ if x.required else Column.__or__, known)
        name = F.when(fits, F.lit(x.name)).otherwise(name)
        turns = F.when(fits, _turns(x, schema)).otherwise(turns)
    for x in reversed(usable):
        fits = F.col("fingerprint").isin(x.fingerprints())
        name = F.when(fits, F.lit(x.name)).otherwise(name)
        turns = F.when(fits, _turns(x, schema)).otherwise(turns)
    marked = records.withColumn("fingerprint", mark)
    return marked.withColumns({"layout": name, "turns": F.coalesce(turns, F.array().cast(TURNS))})


def escape(text: Column) -> Column:
    """Backslashes become `\\e`; the first letter of a control string becomes `\\l` (<) or `\\b` ([)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(("\\l" if control[0] == "<" else "\\b") + control[1:]))
    return out


def unescape(text: Column) -> Column:
    for mark, plain in (("\\n", "\n"), ("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_chat(turns: DataFrame, key: str, order: str | None = None, learn: str = "assistant") -> DataFrame:
    """One row per `key` from rows with `turns`: the formatted text and the loss spans of `learn` turns; without turns both are empty."""
    sorting = F.col(order) if order else F.lit(0)
    flat = turns.select(F.col(key), sorting.alias("at"), F.posexplode_outer("turns").alias("nth", "turn"))
    talks = flat.groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("at", "nth", "turn.role", "turn.text"))).alias("said"))
    talks = talks.withColumn("said", F.filter("said", lambda t: t["nth"].isNotNull()))
    parts = talks.select(key, F.transform("said", lambda t: F.struct(
        F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))).alias("parts"))
    whole = parts.select(
        key, F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
        .alias("formatted"),
        F.aggregate(
            "parts",
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).alias("at"),
                F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length")))))
                .otherwise(acc["spans"]).alias("spans")),
            lambda acc: acc["spans"]).alias("loss_spans"))
    return whole


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt text, unescaped, read from `formatted` and `loss_spans` alone."""
    mark, end = r"<\|turn\|>", r"<\|end\|>\n"
    turns = F.transform(
        F.array_remove(F.split("formatted", end), ""),
        lambda t: F.struct(
            unescape(F.regexp_extract(t, rf"(?s)^{mark}([^\n]*)\n", 1)).alias("role"),
            unescape(F.regexp_replace(t, rf"^{mark}[^\n]*\n", "")).alias("text")))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": learnt})
