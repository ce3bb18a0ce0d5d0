"""Operator 3, chat formatting by schema fingerprints.

A record is a JSON text or a struct. Its nested field paths are those that it has: ``$.messages[].role`` stands for a
field of the elements of a list, and a list has its elements' fields if any of them does, or if it is empty. For each
layout, in order of preference, the hash of those of its paths that the record has is compared with the hash of all its
paths; the first that agrees gives the declarative mapping to canonical turns (role, text). ``fingerprint`` is the hash
of all known paths that the record has, and ``unused`` lists those that the chosen mapping doesn't read, so nothing is
left out silently. A table with one row for each turn is gathered into records first: columns are paths of its rows, and
the first known set of them that it has names the conversation, the order, the role and the text.

Turns are then laid out by one template:

    <|im_start|>role\\n text <|im_end|>\\n        (without the blanks)

Control strings inside a text get a backslash behind their first sign, and one more if they have some already; that is
a bijection, so ``read_back`` restores every text. In a role, a backslash becomes ``\\b`` and a line feed ``\\n``. The loss
mask is kept as run lengths for each turn (lead, loss, tail; in characters of the output), so it needs no running sum.

Only DataFrame functions. Rows of a conversation meet in one aggregation, pre-aggregated by task: one conversation is one
output value, which no layout can split.

Defined results: a null role or text is empty, and so is one that an element of a list lacks; turns of equal number are
ordered by role and text, nulls first; a null conv_id is one conversation; a record that no layout fits, or that is no
record, is kept with layout null and turns null; an empty list gives no turns; further columns and fields are ignored; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?SYS>>|/?INST\]"
ASSISTANT = "assistant"
#: Names that speakers have in some layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Turns that single fields hold, each (role, fields joined by a blank line), then those of a list (field, role, text)."""

    name: str
    said: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        field, role, text = self.listed or ("", "", "")
        return tuple(sorted({f"$.{f}" for _, fs in self.said for f in fs} | ({f"$.{field}[].{role}", f"$.{field}[].{text}"} if field else set())))


_LISTS = (("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "role", "text"))
_USER, _SYSTEM, _ASSISTANT = "user", "system", "assistant"
#: In order of preference: a list of turns before single fields, the more specific before what it includes.
LAYOUTS = (
    *(Layout(f"system_{x[0]}", ((_SYSTEM, ("system",)),), x) for x in _LISTS),
    *(Layout(x[0], (), x) for x in _LISTS),
    Layout("instruction_input", ((_USER, ("instruction", "input")), (_ASSISTANT, ("output",)))),
    Layout("instruction", ((_USER, ("instruction",)), (_ASSISTANT, ("output",)))),
    Layout("system_prompt_response", ((_SYSTEM, ("system",)), (_USER, ("prompt",)), (_ASSISTANT, ("response",)))),
    Layout("prompt_response", ((_USER, ("prompt",)), (_ASSISTANT, ("response",)))),
    Layout("prompt_completion", ((_USER, ("prompt",)), (_ASSISTANT, ("completion",)))),
    Layout("question_answer", ((_USER, ("question",)), (_ASSISTANT, ("answer",)))),
)


@dataclass(frozen=True)
class Reader:
    """How a kind of record is read: whether it has a path, a field's text, and a list's elements as (role, text)."""

    has: Callable[[str], Column]
    text: Callable[[str], Column]
    elements: Callable[[str, str, str], Column]


def _parts(path: str) -> tuple[str, str | None]:
    """The field of a path, and the field of its elements if it is a list's."""
    field, _, inner = path.removeprefix("$.").partition("[].")
    return field, inner or None


def of_variant(v: str) -> Reader:
    get = lambda of, path, kind: f"try_variant_get({of}, '$.{path}', '{kind}')"

    def has(path: str) -> Column:
        field, inner = _parts(path)
        if inner is None:
            return F.expr(f"{get(v, field, 'variant')} is not null")
        items = get(v, field, "array<variant>")
        return F.expr(f"coalesce(size({items}) = 0 or exists({items}, i -> {get('i', inner, 'variant')} is not null), false)")

    def elements(field: str, role: str, text: str) -> Column:
        return F.expr(f"transform({get(v, field, 'array<variant>')}, i -> named_struct('role', {get('i', role, 'string')}, 'text', {get('i', text, 'string')}))")

    return Reader(has, lambda field: F.expr(get(v, field, "string")), elements)


def schema_paths(kind: T.StructType) -> Iterator[str]:
    """Paths of a struct's fields and of the fields of its lists of structs."""
    for f in kind.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            yield from (f"$.{f.name}[].{x.name}" for x in f.dataType.elementType.fields)
        else:
            yield f"$.{f.name}"


def of_struct(record: Column, kind: T.StructType) -> Reader:
    """A struct has the fields of its type wherever it isn't null itself; a list's fields, where the list isn't null."""
    held = set(schema_paths(kind))

    def has(path: str) -> Column:
        if path not in held:
            return F.lit(False)
        field, inner = _parts(path)
        return record.isNotNull() if inner is None else record[field].isNotNull()

    def elements(field: str, role: str, text: str) -> Column:
        return F.transform(record[field], lambda i: F.struct(i[role].cast("string").alias("role"), i[text].cast("string").alias("text")))

    return Reader(has, lambda field: record[field].cast("string"), elements)


def _mark(reader: Reader, paths: tuple[str, ...]) -> Column:
    """Hash of those of ``paths`` that the record has."""
    return F.xxhash64(F.array_join(F.array(*(F.when(reader.has(p), F.lit(p)) for p in paths)), ","))


def _turns(reader: Reader, layout: Layout, roles: dict[str, str]) -> Column:
    named = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)) if roles else None
    role_of = lambda r: F.coalesce(*([named[F.lower(r)]] if roles else []), r, F.lit(""))
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    said = []
    for role, (first, *more) in layout.said:
        text = F.concat_ws("\n\n", reader.text(first), *(F.when(reader.text(f) != "", reader.text(f)) for f in more)) if more else reader.text(first)
        said.append(turn(F.lit(role), text))
    if not layout.listed:
        return F.array(*said)
    listed = F.transform(reader.elements(*layout.listed), lambda x: turn(role_of(x["role"]), x["text"]))
    return F.concat(F.array(*said), listed) if said else listed


def _canonical(rows: DataFrame, id_cols: list[str], reader: Reader, layouts: tuple[Layout, ...], possible: set[str] | None = None, roles: dict[str, str] = ROLES) -> DataFrame:
    known = tuple(sorted({p for x in layouts for p in x.paths}))
    name = turns = unused = None
    for x in layouts:
        if possible is not None and not set(x.paths) <= possible:
            continue  # its mapping can't be read from this type, and no record of it can have its paths
        same = _mark(reader, x.paths) == F.xxhash64(F.lit(",".join(x.paths)))
        left = F.filter(F.array(*(F.when(reader.has(p), F.lit(p)) for p in known if p not in x.paths)), lambda p: p.isNotNull())
        case = lambda so_far, value: F.when(same, value) if so_far is None else so_far.when(same, value)  # noqa: B023, E731
        name, turns, unused = case(name, F.lit(x.name)), case(turns, _turns(reader, x, roles)), case(unused, left)
    if name is None:
        name, turns, unused = (F.lit(None).cast(t) for t in ("string", "array<struct<role:string,text:string>>", "array<string>"))
    return rows.select(*id_cols, _mark(reader, known).alias("fingerprint"), name.alias("layout"), turns.alias("turns"), unused.alias("unused"))


def canonical_records(records: DataFrame, id_cols: list[str], json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``id_cols``, fingerprint, layout, turns (array of role and text) and unused of JSON records of mixed layouts."""
    rows = common.pick(records, [*id_cols, json_col]).select(*id_cols, F.try_parse_json(json_col).alias("v"))
    return _canonical(rows, id_cols, of_variant("v"), layouts)


def canonical_structs(records: DataFrame, id_cols: list[str], record: str, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] = ROLES) -> DataFrame:
    """The same of a column of structs; ``roles`` renames speakers."""
    kind = records.schema[record].dataType
    return _canonical(records.select(*id_cols, F.col(record).alias("r")), id_cols, of_struct(F.col("r"), kind), layouts, set(schema_paths(kind)), roles)


#: Layouts of tables with one row for each turn, in order of preference: conversation, order, role, text.
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "message_index", "role", "content"), ("thread_id", "position", "from", "value"))


def gathered(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of a table with one row for each turn, ``record`` being a struct with the list ``turns`` in order."""
    held = set(schema_paths(rows.schema))
    found = next((x for x in ROW_LAYOUTS if {f"$.{c}" for c in x} <= held), None)
    if found is None:
        raise ValueError(f"no layout of rows has its paths among {sorted(held)}")
    key, at, role, text = found
    row = F.struct(F.col(at).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return common.pick(rows, list(found)).groupBy(F.col(key).alias("conv_id")).agg(F.struct(F.sort_array(F.collect_list(row)).alias("turns")).alias("record"))


def canonical_rows(rows: DataFrame) -> DataFrame:
    """conv_id, fingerprint, layout, turns and unused of a table with one row for each turn; its roles stay as they are."""
    return canonical_structs(gathered(rows), ["conv_id"], "record", roles={})


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", r"$1$2$3")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def apply_template(turns: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols``, formatted, and mask: for each turn the characters before, under and after the loss."""
    laid = turns.withColumn("t", F.transform(F.coalesce("turns", F.expr("array()")), lambda x: F.struct(F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == ASSISTANT).alias("own"))))
    mask = F.transform("t", lambda x: F.struct(
        F.when(x["own"], F.length(x["head"])).otherwise(F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("lead"),
        F.when(x["own"], F.length(x["body"])).otherwise(F.lit(0)).alias("loss"),
        F.when(x["own"], F.lit(len(END))).otherwise(F.lit(0)).alias("tail"),
    ))
    return laid.select(*id_cols, F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id_cols``, turns and loss_texts, both restored from the output alone."""
    parts = F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda x: x != "")
    head = F.lit(len(START) + 1)
    turn = lambda x: F.struct(_unrole(F.substring_index(F.substring(x, head, F.length(x)), "\n", 1)).alias("role"), unescape(F.substring(x, F.instr(x, F.lit("\n")) + 1, F.length(x))).alias("text"))
    loss = F.zip_with(parts, "mask", lambda x, m: F.struct((m["tail"] > 0).alias("own"), F.substring(x, m["lead"] + 1, m["loss"]).alias("text")))
    return formatted.select(*id_cols, F.transform(parts, turn).alias("turns"), F.transform(F.filter(loss, lambda x: x["own"]), lambda x: unescape(x["text"])).alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.pick(common.table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"])
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = read_back(apply_template(canonical_rows(rows.unionByName(more)), ["conv_id"]), ["conv_id"])
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


SQL_TEXT = r"""
with r as (select conv_id, turn, role as r, text as x, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (select *, regexp_replace(text, '([<\[])(\\*)(CONTROL)', '\1\\\2\3', 'g') as et, replace(replace(regexp_replace(role, '([<\[])(\\*)(CONTROL)', '\1\\\2\3', 'g'), '\', '\b'), chr(10), '\n') as er from r)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, x nulls first)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, x nulls first) filter (role = 'assistant'), '')) as loss_sha256,
 sum(length(er) + length(et) + 24)::bigint as formatted_chars
from e group by conv_id
""".replace("CONTROL", _CONTROL)

QUERIES = {"op3_chat": op3_chat}
SQL = {"op3_chat": SQL_TEXT}
