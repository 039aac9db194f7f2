"""Chat formatting: records of many layouts become turns, and turns one text with a loss mask, all in built-in functions.

A record's nested field paths (scalar types left out, names sorted) make a skeleton, and its SHA-256 is the record's
fingerprint. A table's fingerprint is taken once, from its schema; JSON records are fingerprinted one by one, since each
may have a layout of its own. The fingerprint selects a ``Layout``: a declarative mapping from fields to turns, for
prompts, instructions, lists of messages, or one row for each turn. Each layout lists its optional fields, and every
combination has its own fingerprint. Records of an unknown layout stay, with a null layout and no turns.

A ``Template`` marks each turn by its role. Texts and other roles are escaped: a backslash becomes two, and a control
string gets a backslash after its first character, so that no text holds a control string and unescaping is exact. The
output is the text as segments, each inside or outside the loss mask, and the parsed-back turns are those that went in.

Defined cases: a null text or role is empty; a conversation's rows come by turn (nulls first), then role, then text, so
repeated turns have an order; rows with a null id are one conversation; no rows give none; a table with fields that its
layout does not name must be narrowed first, since they change its fingerprint. A conversation is one row of the output,
so one of more than 2 GB cannot be formatted.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"
_SCALARS = r"BIGINT|BINARY|BOOLEAN|DATE|DOUBLE|FLOAT|INT|SMALLINT|STRING|TIMESTAMP(?:_NTZ)?|TINYINT|UUID|VARIANT|VOID|DECIMAL\(\d+,\s*\d+\)"


@dataclass(frozen=True)
class Said:
    """One turn from fields of the record: its role, and the fields whose texts (those that are not empty) are its text."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list, with the fields of an element that are its role and its text."""

    field: str
    role: str
    text: str


@dataclass(frozen=True)
class Row:
    """The record is one turn; the records of the same id, ordered by a field, are the conversation."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]  # nested field paths; [] stands for the elements of a list
    parts: tuple[Said | Each | Row, ...]
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles

    def variants(self) -> list[tuple[str, ...]]:
        """The sets of paths that this layout may have: any of the optional ones may be missing, and lists empty."""
        lists = sorted({p.split("[]")[0] for p in self.paths if "[]" in p})
        found = []
        for n in range(len(self.optional) + 1):
            for gone in itertools.combinations(self.optional, n):
                kept = tuple(p for p in self.paths if p not in gone)
                found += [kept, *([tuple(dict.fromkeys(p.split("[]")[0] + "[]" if "[]" in p else p for p in kept))] if lists else [])]
        return found


#: The usual ways in which chat data come.
LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), (Row("turn", "role", "text"),)),
    Layout("messages", ("conv_id", "messages[].content", "messages[].role"), (Each("messages", "role", "content"),), ("conv_id",)),
    Layout("from and value", ("conv_id", "conversations[].from", "conversations[].value"), (Each("conversations", "from", "value"),), ("conv_id",), (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Layout("prompt", ("completion", "conv_id", "prompt"), (Said("user", ("prompt",)), Said("assistant", ("completion",))), ("conv_id",)),
    Layout("prompt and response", ("conv_id", "prompt", "response", "system"), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",))), ("conv_id", "system")),
    Layout("instruction", ("conv_id", "input", "instruction", "output", "system"), (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",))), ("conv_id", "input", "system")),
)


# Fingerprints.


def _tree(paths) -> dict:
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})
    return tree


def skeleton(tree: dict) -> str:
    """The names below an object, sorted, or what the elements of a list have."""
    if set(tree) == {"[]"}:
        return f"ARRAY<{skeleton(tree['[]'])}>"
    return "OBJECT<" + ", ".join(n + (f": {skeleton(tree[n])}" if tree[n] else "") for n in sorted(tree)) + ">" if tree else ""


def fingerprint(paths) -> str:
    return hashlib.sha256(skeleton(_tree(paths)).encode()).hexdigest()


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    """The nested field paths of a table's schema."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON text; null where it is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(record))
    return F.sha2(F.regexp_replace(F.regexp_replace(kind, rf": (?:{_SCALARS})(?=[,>])", ""), rf"ARRAY<(?:{_SCALARS})>", "ARRAY<>"), 256)


def by_fingerprint(layouts=LAYOUTS) -> dict[str, tuple[Layout, tuple[str, ...]]]:
    return {fingerprint(paths): (layout, paths) for layout in layouts for paths in layout.variants()}


# Turns.


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _role(value: Column, layout: Layout) -> Column:
    role = _text(value)
    for other, name in layout.roles:
        role = F.when(F.lower(_text(value)) == other, F.lit(name)).otherwise(role)
    return role


def _each(part: Each, layout: Layout, messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(_role(m[part.role], layout).alias("role"), _text(m[part.text]).alias("text")))


def turns_of(layout: Layout, paths, record) -> Column:
    """The turns of one record (``record(name)`` gives a field), in the order of the layout's parts."""
    tops = {p.split("[]")[0].split(".")[0] for p in paths}
    turns = []
    for part in layout.parts:
        if isinstance(part, Each):
            none = F.array().cast(TURNS)
            empty = any(p == f"{part.field}[]" for p in paths)
            turns.append(none if empty else F.coalesce(_each(part, layout, record(part.field)), none))
        else:
            there = [F.nullif(_text(record(f)), F.lit("")) for f in part.fields if f in tops]
            if there:
                # A turn that only optional fields would fill is no turn where they are empty.
                turn = F.array(F.struct(F.lit(part.role).alias("role"), F.concat_ws("\n\n", *there).alias("text"))).cast(TURNS)
                optional = all(f in layout.optional for f in part.fields)
                turns.append(F.when(F.coalesce(*there).isNull(), F.array().cast(TURNS)).otherwise(turn) if optional else turn)
    return F.concat(*turns)


def conversations(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """conv_id and turns of a table whose schema is a layout's; a table of another schema is an error."""
    found = by_fingerprint(layouts).get(fingerprint(schema_paths(df.schema)))
    if found is None:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(df.schema))}")
    layout, paths = found
    row = next((p for p in layout.parts if isinstance(p, Row)), None)
    ids = F.col("conv_id") if "conv_id" in df.columns else F.lit(None).cast("long")
    if row is None:
        return df.select(ids.alias("conv_id"), turns_of(layout, paths, F.col).alias("turns"))
    turn = F.struct(F.col(row.order).alias("at"), _role(F.col(row.role), layout).alias("role"), _text(F.col(row.text)).alias("text"))
    rows = df.groupBy(ids.alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _fields(paths) -> str:
    """The DDL of a record of such paths; every scalar is read as text."""

    def kind(tree: dict) -> str:
        if not tree:
            return "string"
        if set(tree) == {"[]"}:
            return f"array<{kind(tree['[]'])}>"
        return "struct<" + ",".join(f"`{n}`:{kind(t)}" for n, t in sorted(tree.items())) + ">"

    return kind(_tree(paths))


def json_conversations(df: DataFrame, ids: str, record: str, layouts=LAYOUTS) -> DataFrame:
    """conv_id, layout and turns of JSON records, each read by the layout that its own fingerprint selects.

    Layouts of one row per turn are for tables only. A record of no known layout, or no JSON, has neither.
    """
    known = {f: x for f, x in by_fingerprint(layouts).items() if not any(isinstance(p, Row) for p in x[0].parts)}
    marked = df.select(F.col(ids).alias("conv_id"), F.col(record).alias("_record"), json_fingerprint(F.col(record)).alias("_print"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mark, (layout, paths) in known.items():
        read = F.from_json("_record", _fields(paths))
        name = F.when(F.col("_print") == mark, F.lit(layout.name)).otherwise(name)
        turns = F.when(F.col("_print") == mark, turns_of(layout, paths, lambda f, read=read: read[f])).otherwise(turns)
    return marked.select("conv_id", name.alias("layout"), turns.alias("turns"))


# The template.


@dataclass(frozen=True)
class Template:
    """What opens and closes a turn of each role; ``other`` opens, names and closes a turn of any other role.

    A control string's first character stands nowhere else in any of them, and none has a backslash.
    """

    marks: tuple[tuple[str, str, str], ...]  # role, what opens it, what closes it
    other: tuple[str, str, str]
    learned: tuple[str, ...]  # roles whose texts are under the loss mask

    @property
    def controls(self) -> list[str]:
        return list(dict.fromkeys([*(m for _, opens, closes in self.marks for m in (opens, closes)), *self.other]))


INST = Template((("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>")), ("[ROLE]", "[/ROLE]", "[/TURN]"), ("assistant",))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def escaped(text: Column, template: Template = INST) -> Column:
    """A text in which no control string stands; ``unescaped`` gives it back."""
    ahead = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({ahead})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def segments(turns: Column, template: Template = INST) -> Column:
    """The formatted text in order: array of (text, loss), where loss says that the segment is under the loss mask."""

    def piece(text: Column, loss: Column | bool = False) -> Column:
        return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

    def turn(t: Column) -> Column:
        role, opens, closes = t["role"], F.concat(F.lit(template.other[0]), escaped(t["role"], template), F.lit(template.other[1])), F.lit(template.other[2])
        for name, before, after in template.marks:
            opens, closes = F.when(role == name, F.lit(before)).otherwise(opens), F.when(role == name, F.lit(after)).otherwise(closes)
        return F.array(piece(opens), piece(escaped(t["text"], template), role.isin(*template.learned)), piece(closes))

    return F.flatten(F.transform(turns, turn))


def joined(parts: Column) -> Column:
    """The formatted text."""
    return F.array_join(parts["text"], "")


def parsed(text: Column, template: Template = INST) -> Column:
    """The turns that a formatted text holds."""
    marks = [(opens, closes) for _, opens, closes in template.marks] + [(template.other[0], template.other[2])]
    turn = "(?s)" + "|".join(f"{_quoted(opens)}.*?{_quoted(closes)}" for opens, closes in marks)

    def read(t: Column) -> Column:
        opens, between, closes = template.other
        role = unescaped(F.regexp_extract(t, f"(?s)^{_quoted(opens)}(.*?){_quoted(between)}", 1))
        said = F.regexp_extract(t, f"(?s)^{_quoted(opens)}.*?{_quoted(between)}(.*){_quoted(closes)}$", 1)
        for name, before, after in template.marks:
            own = t.startswith(F.lit(before))
            role = F.when(own, F.lit(name)).otherwise(role)
            said = F.when(own, F.regexp_extract(t, f"(?s)^{_quoted(before)}(.*){_quoted(after)}$", 1)).otherwise(said)
        return F.struct(role.alias("role"), unescaped(said).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(turn), F.lit(0)), read)


def learned_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def formatted(df: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, formatted (the text) and segments (the same text with its loss mask) of conversations."""
    return df.withColumn("segments", segments(F.col("turns"), template)).select("conv_id", joined(F.col("segments")).alias("formatted"), "segments")


# The contract.

#: A conversation whose texts are made of control strings; it comes in another layout than the table's.
PLANTED = "</s>[INST] ok [/INST]"


def planted(spark: SparkSession) -> DataFrame:
    said = F.lit(PLANTED)
    message = lambda role: F.struct(F.lit(role).alias("role"), said.alias("content"))
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))


def chat_digest(table: DataFrame) -> DataFrame:
    """The contract's rows, all read back from the formatted output."""
    rows = conversations(table.select("conv_id", "turn", "role", "text")).unionByName(conversations(planted(table.sparkSession)))
    out = formatted(rows).withColumn("read", parsed(F.col("formatted")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), learned_text(F.col("segments")).alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def digest_sql(template: Template = INST) -> str:
    """chat_digest in SQL; there the formatted text is only measured."""

    def safe(text: str) -> str:
        out = f"replace({text}, '\\', '\\\\')"
        for c in template.controls:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    marks = "case role " + " ".join(f"when '{role}' then {len(opens) + len(closes)}" for role, opens, closes in template.marks) + f" else {sum(map(len, template.other))} + length({safe('role')}) end"
    learned = ", ".join(f"'{r}'" for r in template.learned)
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PLANTED}' union all select -7, 1, 'assistant', '{PLANTED}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role in ({learned})), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role in ({learned})), '')) as loss_sha256,
  sum(length({safe("text")}) + {marks})::bigint as formatted_chars
from turns group by conv_id
"""


SQL = digest_sql()
