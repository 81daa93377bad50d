"""Chat formatting: layouts recognised by a fingerprint of their field paths, one template, reversible.

Tables of conversations come in many layouts. The nested field paths of a table (or of each JSON
record) are sorted and hashed; the hash selects a declarative mapping that says where role and text
are, and the mapping is turned into DataFrame expressions that yield canonical turns. The template
writes each turn as

    ### <role>
    <text, control strings escaped>
    </turn>

and masks the loss to the texts of assistants. Everything is DataFrame functions.

Defined cases: a null text is empty; a null role is empty; a null order sorts first and ties are
ordered by role and text; repeated rows are repeated turns; an empty table gives an empty table;
columns and fields that no mapping names make no part of the fingerprint and are not read; a table
with the fields of two layouts is an error, such a record has null turns, like one of no known
layout. One conversation is one output row, so a row needs memory for its own conversation, however
long its texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

ASSISTANT = "assistant"
_HEAD, _END = "### ", "</turn>"
_STOP = f"\n{_END}\n"


# Layouts ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``rows``: a row is a turn, (key, order, role, text). ``list``: a record holds a list of turns,
    (list field, role field, text field). ``fields``: a record holds one text per role, ((role,
    fields joined by a blank line), ...). ``roles`` renames roles.
    """

    kind: str
    fields: tuple
    paths: tuple[str, ...]
    roles: tuple[tuple[str, str], ...] = ()


_NAMES = (("human", "user"), ("gpt", ASSISTANT), ("bot", ASSISTANT), ("model", ASSISTANT))
MAPPINGS = (
    Mapping("rows", ("conv_id", "turn", "role", "text"), ("conv_id", "role", "text", "turn")),
    Mapping("list", ("messages", "role", "content"), ("messages", "messages[].content", "messages[].role"), _NAMES),
    Mapping("list", ("conversations", "from", "value"), ("conversations", "conversations[].from", "conversations[].value"), _NAMES),
    Mapping(
        "list", ("request.messages", "author.role", "content.text"),
        ("request", "request.messages", "request.messages[].author", "request.messages[].author.role", "request.messages[].content", "request.messages[].content.text"), _NAMES,
    ),
    Mapping("fields", (("user", ("prompt",)), (ASSISTANT, ("response",))), ("prompt", "response")),
    Mapping("fields", (("user", ("prompt",)), (ASSISTANT, ("completion",))), ("completion", "prompt")),
    Mapping("fields", (("user", ("instruction", "input")), (ASSISTANT, ("output",))), ("input", "instruction", "output")),
    Mapping("fields", (("user", ("instruction",)), (ASSISTANT, ("output",))), ("instruction", "output")),
    Mapping("fields", (("system", ("system",)), ("user", ("question",)), (ASSISTANT, ("answer",))), ("answer", "question", "system")),
    Mapping("fields", (("user", ("question",)), (ASSISTANT, ("answer",))), ("answer", "question")),
)


# All paths that some mapping names; only these make a fingerprint, so other fields do not matter.
NAMED = frozenset(p for m in MAPPINGS for p in m.paths)


def _split(path: str) -> tuple[str, str]:
    parent, _, leaf = path.rpartition(".")
    return parent, leaf


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for the items of a list."""
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        at = f"{prefix}.{f.name}" if prefix else f.name
        out += [at, *paths(f.dataType, at)]
    return sorted(out)


def fingerprint(found: list[str] | tuple[str, ...]) -> int:
    """XXH64 of the sorted paths, as Spark's xxhash64 gives it."""
    x = xxhash.xxh64_intdigest("\n".join(sorted(found)).encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def _print_of(found: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(found), "\n"))


def _after(prefix: Column):
    return lambda x: F.concat(prefix, x)


def _dollar(path: str) -> str:
    """A field path as a JSON path; of a list its first item."""
    return "$" + (f".{path}" if path else "").replace("[]", "[0]")


def json_paths(record: Column) -> Column:
    """The field paths of a JSON record that some mapping names, at any depth; of a list those of its first item."""
    found = []
    for parent in sorted({_split(p)[0] for p in NAMED}):
        at = record if not parent else F.get_json_object(record, _dollar(parent))
        keys = F.coalesce(F.json_object_keys(at), F.array().cast("array<string>"))
        found.append(F.transform(keys, _after(F.lit(f"{parent}." if parent else ""))))
    return F.filter(F.concat(*found), lambda p: p.isin(*sorted(NAMED)))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(m: Mapping, role: Column) -> Column:
    out = role
    for old, new in m.roles:
        out = F.when(role == old, new).otherwise(out)
    return out


def _record_turns(m: Mapping, record: Column) -> Column:
    if m.kind == "list":
        name, role, text = m.fields
        items = F.from_json(F.get_json_object(record, _dollar(name)), "array<string>")
        return F.transform(items, lambda x: _turn(_renamed(m, F.get_json_object(x, _dollar(role))), F.get_json_object(x, _dollar(text))))
    value = lambda names: F.array_join(F.filter(F.array(*(F.get_json_object(record, f"$.{n}") for n in names)), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return F.array(*(_turn(F.lit(role), value(names)) for role, names in m.fields))


def records_to_turns(df: DataFrame, record: str, key: str) -> DataFrame:
    """Conversations (key, turns) of heterogeneous JSON records; a record of no known layout has null turns."""
    known = _print_of(json_paths(F.col(record)))
    turns_of = None
    for m in MAPPINGS:
        if m.kind != "rows":
            expr = _record_turns(m, F.col(record))
            turns_of = F.when(known == F.lit(fingerprint(m.paths)), expr) if turns_of is None else turns_of.when(known == F.lit(fingerprint(m.paths)), expr)
    return df.select(F.col(key).alias("conv_id"), known.alias("layout"), turns_of.alias("turns"))


def rows_to_turns(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turns) of a table with a row per turn, recognised by its field paths.

    One shuffle by conversation; a conversation's rows meet in its output row.
    """
    layouts = {fingerprint(m.paths): m for m in MAPPINGS if m.kind == "rows"}
    m = layouts.get(fingerprint([p for p in paths(df.schema) if p in NAMED]))
    if m is None:
        raise ValueError(f"no mapping for the field paths {paths(df.schema)}")
    key, order, role, text = m.fields
    turn = F.struct(F.col(order).alias("at"), _renamed(m, F.coalesce(F.col(role), F.lit(""))).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.select(F.col(key).alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


# Template --------------------------------------------------------------------------------------

_CONTROL = r"(\\|###|</turn>)"


def escape(text: Column) -> Column:
    """A backslash before every backslash and control string."""
    return F.regexp_replace(text, F.lit(_CONTROL), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\" + _CONTROL), F.lit("$1"))


def format_turns(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss``, the spans of assistants' texts in it (code points, end exclusive).

    The terminator of a turn stands on a line of its own; inside a text it always has a backslash
    before it, so it cannot be mistaken. Roles are percent-encoded.
    """
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(_HEAD), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == ASSISTANT).alias("learn"),
        ),
    )
    places = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(_STOP)).alias("at"),
            F.when(p["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(_STOP))), "")
    return df.withColumn("_pieces", pieces).withColumn("formatted", formatted).withColumn("loss", places).drop("_pieces")


def parse(formatted: Column) -> Column:
    """The turns (role, text) written in a formatted conversation."""
    pieces = F.filter(F.split(formatted, "\n</turn>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring(p, F.lit(len(_HEAD) + 1), F.instr(p, "\n") - len(_HEAD) - 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


# Query -----------------------------------------------------------------------------------------

_PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted, then read back from the output."""
    table = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    # The probe comes as a record of another layout.
    said = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(_PROBE).alias("content")) for r in ("user", ASSISTANT)))
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.to_json(F.struct(said.alias("messages"), F.lit("probe").alias("origin"))).alias("record"))
    done = format_turns(rows_to_turns(table).unionByName(records_to_turns(probe, "record", "id").drop("layout")))
    back = done.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss")), "").alias("learned"), F.length("formatted").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(url_encode(role)) + 1 + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 9)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
