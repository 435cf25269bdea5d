"""Chat formatting by schema fingerprints, in SQL functions alone.

Records are JSON texts of unknown layout. Each is read with one schema that has the fields of every known layout, so fields
nobody maps are ignored; the paths that are there are hashed to a fingerprint, and the fingerprint selects a declarative mapping
to canonical turns (role, text). Turns are written in one template, whose control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: All fields that mappings read.
FIELDS = (
    "messages array<struct<role string, content string>>, conversations array<struct<from string, value string>>, turns array<struct<role string, text string>>, "
    "system string, instruction string, input string, output string, prompt string, completion string, response string, question string, answer string"
)
#: The parser otherwise gives null for a record with a string of over 20 million characters or a number of over 1,000 digits.
NO_LIMITS = {"maxStringLen": str(2**31 - 1), "maxNumLen": str(2**31 - 1)}
#: Template: marks of a turn, and the strings that are escaped in texts (its own and those of other common templates).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TAIL = r"(\||/?INST\]|/?s>)"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_TAIL}", rf"([<\[])(\\*)\\{_TAIL}"


@dataclass(frozen=True)
class Mapping:
    """A layout: its paths, and SQL for its turns over the record's fields `p`."""

    name: str
    paths: tuple[str, ...]
    turns: str


_ROLES = "CASE lower(trim({0})) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE {0} END"
_TURN = "named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _pair(user: str, assistant: str, system: bool) -> str:
    turns = [_TURN.format(role=f"'{r}'", text=t) for r, t in [("system", "p.system")] * system + [("user", user), ("assistant", assistant)]]
    return f"array({', '.join(turns)})"


def _mappings() -> list[Mapping]:
    out = [Mapping("turns", ("turns[].role", "turns[].text"), f"transform(p.turns, x -> {_TURN.format(role="coalesce(x.role, '')", text='x.text')})")]
    listed = {
        "messages": (("messages[].role", "messages[].content"), f"transform(p.messages, x -> {_TURN.format(role="coalesce(x.role, '')", text='x.content')})"),
        "conversations": (("conversations[].from", "conversations[].value"), f"transform(p.conversations, x -> {_TURN.format(role=f"coalesce({_ROLES.format('x.from')}, '')", text='x.value')})"),
    }
    single = {
        "instruction": (("instruction", "output"), "p.instruction", "p.output"),
        "instruction_response": (("instruction", "response"), "p.instruction", "p.response"),
        "instruction_input": (("instruction", "input", "output"), "CASE WHEN p.input = '' THEN p.instruction ELSE concat(p.instruction, '\\n\\n', p.input) END", "p.output"),
        "prompt": (("prompt", "completion"), "p.prompt", "p.completion"),
        "prompt_response": (("prompt", "response"), "p.prompt", "p.response"),
        "question": (("question", "answer"), "p.question", "p.answer"),
    }
    for system in (False, True):
        more = ("system",) * system
        for name, (paths, sql) in listed.items():
            out.append(Mapping(name + "_system" * system, paths + more, f"concat(array({_TURN.format(role="'system'", text='p.system')}), {sql})" if system else sql))
        for name, (paths, user, assistant) in single.items():
            out.append(Mapping(name + "_system" * system, paths + more, _pair(user, assistant, system)))
    return out


MAPPINGS = _mappings()


def _known() -> dict[str, list[str]]:
    """Fields of FIELDS, with the fields of their records where they are lists."""
    return {f.name: [b.name for b in f.dataType.elementType.fields] if isinstance(f.dataType, ArrayType) else [] for f in StructType.fromDDL(FIELDS).fields}


def path_text(paths: tuple[str, ...]) -> str:
    """How a record with these paths describes itself: its fields in the order of FIELDS, those of a list's records after the list."""
    out = []
    for name, below in _known().items():
        own = [f"{name}[].{b}" for b in below if f"{name}[].{b}" in paths]
        out += [f"{name}[]", *own] if own else [name] if name in paths else []
    return ",".join(out)


def fingerprint(record: str) -> Column:
    """Hash of the field paths of `p`, the record's known fields, that are not null; null for a null record."""
    found = []
    for name, below in _known().items():
        c = F.col(f"{record}.{name}")
        found.append(F.when(c.isNotNull(), F.lit(f"{name}[]" if below else name)))
        # An empty list, or one of empty records, has no paths below.
        found += [F.when(F.expr(f"exists({record}.{name}, x -> x.`{b}` IS NOT NULL)"), F.lit(f"{name}[].{b}")) for b in below]
    return F.when(F.col(record).isNotNull(), F.xxhash64(F.concat_ws(",", *found)))


def escape(text: str | Column) -> Column:
    """Puts one more backslash into every control string."""
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def unescape(text: str | Column) -> Column:
    """Takes that backslash out again."""
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def _role_in(c: Column) -> Column:
    # A doubled backslash becomes a line feed, of which there is none; \\l and \\n are undone, and the two characters change places.
    aside = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\n")), F.lit("\\l"), F.lit("<"))
    return F.translate(F.replace(aside, F.lit("\\n"), F.lit("\\")), "\\\n", "\n\\").alias("role")


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """records with `layout` (null: unknown or broken) and `turns` (array of role, text; null for those)."""
    parsed = records.withColumn("p", F.from_json(column, FIELDS, NO_LIMITS)).withColumn("print", fingerprint("p"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role string, text string>>")
    for m in reversed(MAPPINGS):
        own = F.col("print") == F.xxhash64(F.lit(path_text(m.paths)))
        layout = F.when(own, F.lit(m.name)).otherwise(layout)
        turns = F.when(own, F.expr(m.turns)).otherwise(turns)
    return parsed.withColumn("layout", layout).withColumn("turns", turns).drop("p", "print")


def format_chats(records: DataFrame, column: str = "record") -> DataFrame:
    """Formats every record (JSON text in `column`); all other columns stay, and `layout`, `turns`, `formatted` and `loss_mask` follow.

    loss_mask has an entry for each turn: so many code points to skip, to take (assistant texts; else 0), to skip. A record of
    unknown layout (a list without entries has no paths), of broken JSON or null has null in the new columns; null texts and roles are
    empty ones. Repeated records are formatted each time; an empty table gives an empty result. Input columns with the names
    of the new ones are replaced.
    """
    rows = canonical(records, column)
    rows = rows.withColumn("parts", F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))))
    rows = rows.withColumn("formatted", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), ""))

    def mask(x: Column) -> Column:
        head, body = F.length(x["head"]), F.length(x["body"])
        take = F.when(x["loss"], body).otherwise(0)
        return F.struct(head.alias("skip"), take.alias("take"), (body - take + len(CLOSE)).alias("rest"))

    return rows.withColumn("loss_mask", F.transform("parts", mask)).drop("parts")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `read_turns` (array of role, text) and `loss_text` to rows of formatted and loss_mask, from these two alone."""
    parts = F.split("formatted", CLOSE.replace("|", r"\|"))
    rows = formatted.withColumn("split_parts", parts).withColumn("split_parts", F.slice("split_parts", 1, F.size("split_parts") - 1))

    def turn(x: Column) -> Column:
        cut = F.locate("\n", x)
        return F.struct(_role_in(F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)), unescape(F.substring(x, cut + 1, F.length(x))).alias("text"))

    rows = rows.withColumn("read_turns", F.transform("split_parts", turn))
    under = F.zip_with("split_parts", "loss_mask", lambda x, m: unescape(F.substring(x, m["skip"] + 1, m["take"])))
    return rows.withColumn("loss_text", F.array_join(under, "")).drop("split_parts")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn (conv_id, turn, role, text) as one JSON record for each conversation, turns in order; ties
    go by role and text, null texts and roles are empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(turn))
    return conversations.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))).alias("record"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from the formatted text."""
    rows = read_back(format_chats(conversation_records(conversations)))
    turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
