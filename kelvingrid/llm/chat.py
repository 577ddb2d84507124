"""Chat formatting with DataFrame functions only.

Records come as JSON in several layouts.  The nested field paths that a record fills are listed and hashed; the
hash selects a declarative mapping, which turns the record into canonical turns (role, text).  Turns are then
rendered with a template that marks them, with control strings inside texts escaped, and a mask of the
stretches that a model is to learn (the assistant texts).  ``read_back`` is the exact inverse.

Template: ``<s>text</s>`` for an assistant turn, ``[INST]role``, a line feed, ``text[/INST]`` for any other.  A control string
inside a text gets one backslash behind its first character (and one more if it has some already).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Fields that are read from a record; all others are ignored.
RECORD = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
    "prompt string, response string, completion string, instruction string, input string, output string, system string"
)
#: Nested field paths and the SQL condition under which a record fills them.
PATHS = {
    "completion": "r.completion is not null", "conversations[].from": "exists(r.conversations, x -> x.`from` is not null)",
    "conversations[].value": "exists(r.conversations, x -> x.value is not null)", "input": "r.input is not null", "instruction": "r.instruction is not null",
    "messages[].content": "exists(r.messages, x -> x.content is not null)", "messages[].role": "exists(r.messages, x -> x.role is not null)",
    "output": "r.output is not null", "prompt": "r.prompt is not null", "response": "r.response is not null", "system": "r.system is not null",
}


@dataclass(frozen=True)
class Layout:
    """Paths that a record of this layout fills, and its turns: either a list field with its role and text fields, or fixed (role, SQL text) turns."""

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()


LAYOUTS = [
    Layout("messages", ("messages[].content", "messages[].role"), each=("messages", "role", "content")),
    Layout("messages_system", ("messages[].content", "messages[].role", "system"), each=("messages", "role", "content"), fixed=(("system", "r.system"),)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each=("conversations", "`from`", "value")),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", "r.prompt"), ("assistant", "r.response"))),
    Layout("prompt_completion", ("completion", "prompt"), fixed=(("user", "r.prompt"), ("assistant", "r.completion"))),
    Layout("prompt_response_system", ("prompt", "response", "system"), fixed=(("system", "r.system"), ("user", "r.prompt"), ("assistant", "r.response"))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", "r.instruction"), ("assistant", "r.output"))),
    Layout("instruction_input", ("input", "instruction", "output"), fixed=(("user", "if(r.input = '', r.instruction, concat(r.instruction, '\\n\\n', r.input))"), ("assistant", "r.output"))),
]
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

CONTROL_AHEAD = r"(?<=<)(?=\\*/?s>)|(?<=\[)(?=\\*/?INST\])"
ESCAPED_AHEAD = r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def escaped(text: str) -> str:
    return f"regexp_replace({text}, {_q(CONTROL_AHEAD)}, {_q(chr(92) * 2)})"


def unescaped(text: str) -> str:
    return f"regexp_replace({text}, {_q(ESCAPED_AHEAD)}, '')"


def _role_out(role: str) -> str:
    return escaped(f"replace(replace({role}, {_q(chr(92))}, {_q(chr(92) + 'b')}), '\\n', {_q(chr(92) + 'l')})")


def _role_in(role: str) -> str:
    return f"replace(replace({unescaped(role)}, {_q(chr(92) + 'l')}, '\\n'), {_q(chr(92) + 'b')}, {_q(chr(92))})"


def layout_hash(paths: Column) -> Column:
    """Fingerprint of a sorted list of nested field paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name; null if no mapping has this fingerprint) and ``turns`` (array of role, text; empty for such records).

    Fields that are null or missing are not filled; unknown fields are ignored.  A null text or role inside a list is
    empty.  Records that are null or no JSON object have no layout.  Rows are independent; an empty table gives no rows.
    """
    options = {"maxStringLen": str((1 << 31) - 1)}
    parsed = records.withColumn("r", F.from_json(record_col, RECORD, options))
    filled = "filter(array(" + ",".join(f"if(coalesce({cond}, false), {_q(path)}, null)" for path, cond in sorted(PATHS.items())) + "), x -> x is not null)"
    hashed = parsed.withColumn("layout_hash", layout_hash(F.expr(filled)))
    name, turns = F.lit(None).cast("string"), F.expr("cast(array() as array<struct<role:string,text:string>>)")
    for layout in layouts:
        parts = []
        if layout.fixed:
            parts.append("array(" + ",".join(f"named_struct('role', {_q(role)}, 'text', {text})" for role, text in layout.fixed) + ")")
        if layout.each:
            field, role, text = layout.each
            named = f"coalesce(x.{role}, '')"
            for other, canonical in ROLE_NAMES.items() if layout.name == "conversations" else ():
                named = f"if(x.{role} = {_q(other)}, {_q(canonical)}, {named})"
            parts.append(f"transform(r.{field}, x -> named_struct('role', {named}, 'text', coalesce(x.{text}, '')))")
        same = F.col("layout_hash") == layout_hash(F.array(*(F.lit(p) for p in sorted(layout.paths))))
        name = F.when(same, layout.name).otherwise(name)
        turns = F.when(same, F.expr(f"concat({', '.join(parts)})")).otherwise(turns)
    return hashed.select(*records.columns, name.alias("layout"), turns.alias("turns"))


def format_turns(turned: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, an array of (s, e) in code points of ``formatted``, e exclusive."""
    text = escaped("x.text")
    bodied = turned.withColumn("bodies", F.expr(f"transform(turns, x -> named_struct('learn', x.role = 'assistant', 'head', if(x.role = 'assistant', '<s>', concat('[INST]', {_role_out('x.role')}, '\\n')), 'body', {text}))"))
    sized = bodied.withColumn("rendered", F.expr("transform(bodies, x -> concat(x.head, x.body, if(x.learn, '</s>', '[/INST]')))"))
    placed = sized.withColumn("starts", F.expr("aggregate(rendered, array(0), (acc, x) -> array_append(acc, element_at(acc, -1) + length(x)))"))
    spans = "transform(filter(zip_with(bodies, slice(starts, 1, size(bodies)), (x, at) -> named_struct('learn', x.learn, 's', at + length(x.head), 'n', length(x.body))), x -> x.learn), x -> named_struct('s', x.s, 'e', x.s + x.n))"
    return placed.select(*turned.columns, F.array_join("rendered", "").alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_back(formatted: str = "formatted") -> str:
    """SQL: the turns (role, text) that a formatted record stands for."""
    head = "locate('\\n', x)"
    return f"""transform(regexp_extract_all({formatted}, {_q(TURN)}, 0), x -> if(startswith(x, '<s>'),
        named_struct('role', 'assistant', 'text', {unescaped("substring(x, 4, length(x) - 7)")}),
        named_struct('role', {_role_in(f"substring(x, 7, {head} - 7)")}, 'text', {unescaped(f"substring(x, {head} + 1, length(x) - {head} - 7)")})))"""


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> str:
    """SQL: what the mask covers, unescaped, in order, with nothing between."""
    return f"array_join(transform({spans}, x -> {unescaped(f'substring({formatted}, x.s + 1, x.e - x.s)')}), '')"


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as JSON records; a user turn with its answer as prompt and response, all else as messages.

    Turns are ordered by number, then role and text (null number first); repeated rows are repeated turns; null role or text: empty.
    A conversation is one record, so all of its turns meet in one row.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    pair = F.expr("size(t) = 2 and t[0].role = 'user' and t[1].role = 'assistant'")
    messages = F.to_json(F.struct(F.expr("transform(t, x -> named_struct('role', x.role, 'content', x.content))").alias("messages")))
    return grouped.select("conv_id", F.when(pair, F.to_json(F.struct(F.expr("t[0].content").alias("prompt"), F.expr("t[1].content").alias("response")))).otherwise(messages).alias("record"))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Formats every conversation and digests what is read back from the output."""
    out = format_turns(canonical_turns(conversation_records(rows))).select("conv_id", "layout", "formatted", "loss_spans")
    read = out.select("conv_id", "layout", F.length("formatted").cast("long").alias("formatted_chars"), F.expr(read_back()).alias("turns"), F.expr(loss_text()).alias("learnt"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "layout",
    )
