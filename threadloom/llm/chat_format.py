"""Chat formatting with built-in functions only.

A record is a JSON object of some layout. Its nested field paths (those that any mapping knows, sorted; for a list, those
of all its items) are hashed, and the hash selects a declarative mapping to canonical turns: an array of (role, text). The
template then writes each turn as

    <turn ROLE>TEXT</turn>\\n

with backslash, '<' and (in roles) '>' escaped, so that no text can hold a mark, and gives the loss mask as run
lengths (skip, take, rest) for each turn: `take` characters of assistant text count. read_turns() inverts it.

Nulls, empties and repeats: a null text or role is an empty string; a record whose layout no mapping
knows, or that is no JSON object, comes back with null turns; empty lists give empty strings; repeated
records are all kept. A list with items that are no objects (nulls, texts, lists) keeps its others, in order, and its layout ends in
'+malformed'; one without any object, or a text, object or null in its place, has the layout 'malformed' and null turns. Null turns
give a null text and mask. A content that is itself a list or object stays as its JSON text; fields such as tool_calls aren't turns and pass by. Texts are formatted whole, up to Spark's own bound of a string. Further fields of a record
and columns of the table pass by; columns named layout, turns, formatted or loss_mask give way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import column, fresh, scratch, table

#: The JSON reader's bounds, lifted: a text may be as long as a string can be.
JSON = {"maxStringLen": str(2**31 - 1)}
#: What the conversations layout calls the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. `items` names a list with (role, text) fields; `parts` lists (role, fields to join)."""

    name: str
    items: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    #: The list has no item, so its items show no fields.
    empty: bool = False
    #: The list's names of the roles, where they are others.
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.items:
            name, role, text = self.items
            return sorted([name, *[f for _, fs in self.parts for f in fs]] if self.empty else [name, f"{name}[].{role}", f"{name}[].{text}", *[f for _, fs in self.parts for f in fs]])
        return sorted(f for _, fs in self.parts for f in fs)

    def fingerprint(self) -> str:
        return hashlib.sha256(",".join(self.paths()).encode()).hexdigest()


def _with_system(m: Mapping) -> list[Mapping]:
    return [m, replace(m, name=f"{m.name}+system", parts=(("system", ("system",)), *m.parts))]


MAPPINGS = [
    x
    for m in (
        Mapping("messages", ("messages", "role", "content")),
        Mapping("conversations", ("conversations", "from", "value"), roles=tuple(ROLES.items())),
        Mapping("turns", ("turns", "role", "text")),
        *(Mapping(f"{a}-empty", (a, b, c), empty=True) for a, b, c in (("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "role", "text"))),
        Mapping("prompt-completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
        Mapping("prompt-response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
        Mapping("question-answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
        Mapping("instruction-output", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
        Mapping("instruction-input-output", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    )
    for x in _with_system(m)
]


_MAP = "map<string,string>"
_NONE = "array<string>"


def _items(fields: Column, name: str) -> Column:
    """A list's items, each a map from its fields to their JSON or text, null for what is no object; null where the field isn't a list."""
    whole = F.from_json(fields[name], f"array<{_MAP}>", JSON)
    one_by_one = F.transform(F.from_json(fields[name], "array<string>", JSON), lambda i: F.from_json(i, _MAP, JSON))
    return F.when(whole.isNotNull() & F.forall(whole, lambda i: i.isNotNull()), whole).otherwise(one_by_one)


def _fingerprint(fields: Column, lists: dict[str, Column], mappings: list[Mapping]) -> Column:
    """The hash of the nested field paths that some mapping knows, sorted."""
    known = sorted({p for m in mappings for p in m.paths()})
    found = [F.coalesce(F.map_keys(fields), F.array().cast(_NONE))]
    for name, items in lists.items():
        inner = F.flatten(F.transform(items, lambda i: F.coalesce(F.map_keys(i), F.array().cast(_NONE))))
        found.append(F.coalesce(F.transform(inner, lambda k: F.concat(F.lit(f"{name}[]."), k)), F.array().cast(_NONE)))  # noqa: B023
    paths = F.array_sort(F.array_intersect(F.array_distinct(F.concat(*found)), F.array(*map(F.lit, known))))
    return F.sha2(F.array_join(paths, ","), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _apply(m: Mapping, fields: Column, lists: dict[str, Column]) -> Column:
    parts = []
    for role, names in m.parts:
        values = [F.coalesce(fields[f], F.lit("")) for f in names]
        text = values[0]
        for v in values[1:]:
            text = F.when(v == "", text).otherwise(F.concat(text, F.lit("\n"), v))
        parts.append(_turn(F.lit(role), text))
    out = F.array(*parts) if parts else None
    if m.items:
        name, role, text = m.items
        named = lambda t: t[role]
        if m.roles:
            names = F.create_map(*[F.lit(x) for pair in m.roles for x in pair])
            named = lambda t: F.coalesce(F.element_at(names, t[role]), t[role])
        turns = F.transform(lists[name], lambda t: _turn(named(t), t[text]))
        out = F.concat(out, turns) if parts else turns
    return out


def canonical_turns(records: DataFrame, record: str = "record", mappings: list[Mapping] | None = None) -> DataFrame:
    """Adds layout (string) and turns (array<struct<role, text>>) to records, by the record's fingerprint.

    Items of a list may differ in their fields; a field that an item lacks counts as empty.
    """
    mappings = mappings or MAPPINGS
    lists = sorted({m.items[0] for m in mappings if m.items})
    records = records.drop("layout", "turns")
    whole, mark, *names = fresh(records, "fields", "print", *lists)
    # each column is parsed once: Spark doesn't inline what costs much into several places
    out = records.withColumn(whole, F.from_json(column(record), _MAP, JSON))
    out = out.withColumns({n: _items(F.col(whole), x) for n, x in zip(names, lists, strict=True)})
    items = {x: F.filter(n, lambda i: i.isNotNull()) for n, x in zip(names, lists, strict=True)}
    read = {x: F.col(n) for n, x in zip(names, lists, strict=True)}
    out = out.withColumn(mark, _fingerprint(F.col(whole), items, mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for m in mappings:
        here = F.col(mark) == m.fingerprint()
        name, found = F.lit(m.name), _apply(m, F.col(whole), items)
        if m.items:
            given, good = F.size(read[m.items[0]]), F.size(items[m.items[0]])
            lost = read[m.items[0]].isNull() | ((good == 0) & (given > 0))
            name = F.when(lost, "malformed").when(good < given, f"{m.name}+malformed").otherwise(name)
            found = F.when(~lost, found)
        layout, turns = F.when(here, name).otherwise(layout), F.when(here, found).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns}).drop(whole, mark, *names)


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    """Pairs of backslashes become '<', then the escaped '<' a backslash, then the two change places."""
    return F.translate(F.replace(F.replace(x, F.lit("\\\\"), F.lit("<")), F.lit("\\l"), F.lit("\\")), "<\\", "\\<")


def _escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit(">"), F.lit("\\g"))


def _unescape_role(x: Column) -> Column:
    return unescape(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("<"), F.lit("\\\\")))


OPEN, CLOSE = "<turn ", "</turn>\n"


def format_turns(rows: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds formatted (string) and loss_mask (array<struct<skip, take, rest>>, characters of each turn) to rows; null turns give nulls."""
    (parts,) = fresh(rows, "parts")
    head = lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit(">"))
    out = rows.withColumn(parts, F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))))
    formatted = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    mask = F.transform(
        parts,
        lambda p: F.struct(
            (F.length(p["head"]) + F.when(p["learn"], 0).otherwise(F.length(p["body"]))).alias("skip"),
            F.when(p["learn"], F.length(p["body"])).otherwise(0).alias("take"),
            F.lit(len(CLOSE)).alias("rest"),
        ),
    )
    return out.withColumn("formatted", formatted).withColumn("loss_mask", mask).drop(parts)


def read_turns(rows: DataFrame) -> DataFrame:
    """From formatted and loss_mask: turns as they were, and learned, the texts under the loss mask."""
    pieces = F.expr(rf"slice(split(formatted, '\\Q{CLOSE.strip()}\\E\n', -1), 1, size(split(formatted, '\\Q{CLOSE.strip()}\\E\n', -1)) - 1)")
    (whole,) = fresh(rows, "pieces")
    out = rows.withColumn(whole, F.when(F.col("formatted") == "", F.array().cast("array<string>")).otherwise(pieces))
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ">", 1)
    turns = F.transform(
        whole,
        lambda p: F.struct(_unescape_role(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + F.lit(len(OPEN) + 2))).alias("text")),
    )
    taken = F.zip_with(whole, "loss_mask", lambda p, m: F.when(m["take"] > 0, unescape(F.substr(p, m["skip"] + 1, m["take"]))))
    return out.withColumn("turns", turns).withColumn("learned", F.array_compact(taken)).drop(whole)


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of a conversation, by turn, as one JSON record.

    A question and its answer become a prompt-response record, with a system text before them one with a system field;
    longer conversations a list of messages, or of turns where their conv_id is odd. A conversation is one record, so
    its rows meet in one task: it must fit there, as its text is one string.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    roles = F.array_join(F.transform("rows", lambda r: r["role"]), ",")
    text = lambda k: F.col("rows")[k]["content"]
    listed = lambda name, value: F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias(value))).alias(name)))
    record = (
        F.when((roles == "user,assistant") & (F.size("rows") == 2), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when((roles == "system,user,assistant") & (F.size("rows") == 3), F.to_json(F.struct(text(0).alias("system"), text(1).alias("question"), text(2).alias("answer"))))
        .when(F.pmod("conv_id", F.lit(2)) == 1, listed("turns", "text"))
        .otherwise(listed("messages", "content"))
    )
    return grouped.select("conv_id", record.alias("record"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = scratch(spark, "chat")
    done = format_turns(canonical_turns(records_of(rows))).select("conv_id", "layout", "formatted", "loss_mask")
    done.write.option("compression", "zstd").parquet(out)
    back = read_turns(spark.read.schema(done.schema).parquet(out))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text)
    + 2 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', ''))
    + 2 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', ''))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
