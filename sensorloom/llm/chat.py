"""Chat records of any layout as canonical turns, and turns as training text with a loss mask.

A record is a JSON object. Its nested field paths (with the kind of each field, without the exact scalar
type) are hashed into a fingerprint, and the fingerprint selects a declarative ``Layout``: either scalar
fields with the role each one plays, in order, or an array of messages with a role field and a text field.
Layouts cover prompt/completion, instruction and message records; a caller adds further ones. All of it is DataFrame expressions.

Training text marks a turn as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts
each run "<", backslashes, "|" gets one more backslash, so a text never holds a control string, and taking one
backslash away restores it. Roles are percent-encoded. The loss mask has one entry per turn: how many
characters of the turn come before its text, how many the text has, and whether they count.

Defined results: a null or missing text is empty, a null role is the empty role; a record that is no JSON object or whose
fingerprint no layout has keeps null turns and its fingerprint, so it can be reported; repeated records
are formatted each; turns tie on (turn, role, text) in that order, nulls first; an empty table gives an
empty table; columns other than the key and the record are not carried over. A conversation is one row,
so it has to fit into a cell, as its formatted text does.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """``fields``: (path, role) of scalar texts in turn order; ``optional``: those that may be missing, null
    or empty, and then make no turn. Or ``messages``: the path of the array, with ``role`` and ``text`` inside; ``roles`` renames."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    messages: str = ""
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)

    def shapes(self) -> list[str]:
        """The path listings that this layout answers to."""
        if self.messages:
            inner = ", ".join(f"{k}: *" for k in sorted((self.role, self.text)))
            return [f"OBJECT<{self.messages}: ARRAY<OBJECT<{inner}>>>", f"OBJECT<{self.messages}: ARRAY<*>>"]
        always = [f for f, _ in self.fields if f not in self.optional]
        picks = product((False, True), repeat=len(self.optional))
        return ["OBJECT<" + ", ".join(f"{k}: *" for k in sorted(always + [o for o, on in zip(self.optional, p) if on])) + ">" for p in picks]


LAYOUTS = (
    Layout("prompt", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("question", fields=(("system", "system"), ("question", "user"), ("answer", "assistant")), optional=("system",)),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("output", "assistant")), optional=("system",)),
    Layout("messages", messages="messages"),
    Layout("from_value", messages="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
)


def shape(record: Column) -> Column:
    """The nested field paths of a JSON record; scalar types and nulls all read "*"."""
    kinds = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(kinds, r"(?<=: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9,]*\))?(?=[,>])", "*")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def turns_of(layout: Layout, parsed: Column) -> Column:
    """The canonical turns of a parsed record of this layout."""
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.messages:
        # Field by field: a struct cast would turn a lone number into an error.
        kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
        found = F.try_variant_get(parsed, f"$.{layout.messages}", kind)

        def named(m: Column) -> Column:
            role = m[layout.role]
            for old, new in layout.roles.items():
                role = F.when(m[layout.role] == old, new).otherwise(role)
            return turn(role, m[layout.text])

        return F.transform(found, named)
    texts = [(name, role, F.try_variant_get(parsed, f"$.{name}", "string")) for name, role in layout.fields]
    made = [F.when(F.coalesce(t, F.lit("")) != "", turn(F.lit(r), t)) if n in layout.optional else turn(F.lit(r), t) for n, r, t in texts]
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``key``, ``fingerprint``, ``layout`` (name) and ``turns``: array of (role, text)."""
    parsed = records.select(F.col(key), F.try_parse_json(record).alias("parsed"), fingerprint(shape(F.col(record))).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        mine = F.col("fingerprint").isin(*[fingerprint(F.lit(s)) for s in layout.shapes()])
        name, turns = F.when(mine, layout.name).otherwise(name), F.when(mine, turns_of(layout, F.col("parsed"))).otherwise(turns)
    return parsed.select(F.col(key), "fingerprint", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def render(chats: DataFrame, key: str, trained: str = TRAINED_ROLE) -> DataFrame:
    """``key``, ``formatted`` and ``mask``: per turn (skip, take, loss). Null turns give null for both."""
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    block = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END + "\n")))
    mask = F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("skip"), F.length(escape(t["text"])).alias("take"), (t["role"] == trained).alias("loss")))
    return chats.select(F.col(key), F.array_join(block, "").alias("formatted"), mask.alias("mask"))


def read_back(rendered: DataFrame, key: str) -> DataFrame:
    """``key``, ``turns`` as they stand in the formatted text, and ``loss_texts``: what the mask covers, unescaped, in order."""
    blocks = F.filter(F.split("formatted", r"\Q" + END + "\n" + r"\E", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        line = F.instr(block, F.lit("\n"))
        role = F.url_decode(F.substring(block, F.lit(len(START) + 1), line - len(START) - 1))
        return F.struct(role.alias("role"), unescape(F.substring(block, line + 1, F.length(block))).alias("text"))

    covered = F.zip_with(blocks, F.col("mask"), lambda b, m: F.when(m["loss"], unescape(F.substring(b, m["skip"] + 1, m["take"]))))
    return rendered.select(F.col(key), "formatted", F.transform(blocks, turn).alias("turns"), F.filter(covered, lambda t: t.isNotNull()).alias("loss_texts"))


def records_of(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one JSON ``record`` per conversation, in the layout that its shape suggests: a plain
    question and answer, one with a system text, or a list of messages (two naming styles)."""
    told = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(key).alias("k"), F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), told.alias("t")).alias("m"))
    chats = rows.groupBy("k").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    roles = F.concat_ws("\n", F.transform("ms", lambda m: m["r"]))
    at = lambda i: F.get("ms", F.lit(i))["t"]
    plain = ~F.exists("ms", lambda m: ~m["r"].isin("system", "user", "assistant"))
    style = F.transform("ms", lambda m: F.struct(F.when(m["r"] == "user", "human").when(m["r"] == "assistant", "gpt").otherwise(m["r"]).alias("from"), m["t"].alias("value")))
    record = (
        F.when((roles == "user\nassistant") & (F.size("ms") == 2), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("completion"))))
        .when((roles == "system\nuser\nassistant") & (F.size("ms") == 3) & (at(0) != ""), F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))))
        .when(plain & (F.pmod(F.col("k"), F.lit(2)) == 1), F.to_json(F.struct(style.alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("ms", lambda m: F.struct(m["r"].alias("role"), m["t"].alias("content"))).alias("messages"))))
    )
    return chats.select(F.col("k").alias(key), record.alias("record"))
