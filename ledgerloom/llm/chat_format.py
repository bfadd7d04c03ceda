r"""Chat formatting with schema fingerprints, in DataFrame expressions only (operator 2).

Records of any layout (a VARIANT column) are fingerprinted: ``schema_of_variant`` gives the
nested field paths, scalar types are blanked out, and the SHA-256 of what is left is the
record's fingerprint.  Each :class:`Layout` declares an example of its shape and the SQL
expression that turns such a record into canonical turns ``array<struct<role, text>>``;
the example's own fingerprint (a folded constant) selects it.  A record with fields beside
those of a layout has another fingerprint; it takes the first layout, in their order, all of
whose own paths it has (``fits``).  A record that fits no layout gets no turns and a null
layout; nothing is dropped.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` per turn.  Control strings inside texts are
escaped reversibly: one backslash goes in after the first character of each, and where
backslashes stand there already, one more; so no control string is left in a text, and
taking one backslash out again gives the text back.  Roles are percent-encoded.

The output keeps the formatted conversation as ``segments`` (text, loss): the loss mask
covers exactly the texts of assistant turns.  :func:`read_back` recovers turns from the
joined text alone and the loss text from the mask.

Null texts and roles are empty; turns with equal numbers stand in the order of role and
text, null turn numbers first; repeated rows are turns, or records, of their own; texts of any
length are formatted whole; an empty table gives no rows.  Extra columns are left alone, but
those with the names of the results (fingerprint, layout, turns, segments, text) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings that never stay as they are inside a text: first character, then the rest.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def _control_pattern(backslashes: str) -> str:
    rests = "|".join(sorted({c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS}, key=len, reverse=True))
    return rf"([<\[])({backslashes})({rests})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _control_pattern(r"\\*"), r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _control_pattern(r"\\*").replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


@dataclass(frozen=True)
class Layout:
    """``examples``: JSON records of this shape (one for each set of fields it may have); ``turns``: SQL over the VARIANT column ``record``.

    ``fits``: SQL that says whether a record with other fields too has this layout's own.
    """

    name: str
    examples: tuple[str, ...]
    turns: str
    fits: str


def _texts(*paths: str) -> str:
    return " and ".join(f"try_variant_get(record, '{p}', 'string') is not null" for p in paths)


def _list(path: str, role: str, text: str) -> str:
    return f"coalesce(size(try_variant_get(record, '{path}', 'array<struct<{role}:string,{text}:string>>')) > 0 and forall(try_variant_get(record, '{path}', 'array<struct<{role}:string,{text}:string>>'), x -> x.{role} is not null), false)"


def _pair(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', variant_get(record, '{path}', 'string'))"


LAYOUTS = (
    Layout("turns", ('{"turns":[{"role":"","text":""}]}', '{"turns":[]}'), f"variant_get(record, '$.turns', '{TURNS}')", _list("$.turns", "role", "text")),
    Layout("messages", ('{"messages":[{"role":"","content":""}]}', '{"messages":[]}'), "transform(variant_get(record, '$.messages', 'array<struct<role:string,content:string>>'), x -> named_struct('role', x.role, 'text', x.content))", _list("$.messages", "role", "content")),
    Layout("conversations", ('{"conversations":[{"from":"","value":""}]}', '{"conversations":[]}'), "transform(variant_get(record, '$.conversations', 'array<struct<from:string,value:string>>'), x -> named_struct('role', CASE x.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.from END, 'text', x.value))", _list("$.conversations", "from", "value")),
    Layout("system prompt", ('{"system":"","prompt":"","response":""}',), f"array({_pair('system', '$.system')}, {_pair('user', '$.prompt')}, {_pair('assistant', '$.response')})", _texts("$.system", "$.prompt", "$.response")),
    Layout("prompt", ('{"prompt":"","response":""}',), f"array({_pair('user', '$.prompt')}, {_pair('assistant', '$.response')})", _texts("$.prompt", "$.response")),
    Layout("prompt completion", ('{"prompt":"","completion":""}',), f"array({_pair('user', '$.prompt')}, {_pair('assistant', '$.completion')})", _texts("$.prompt", "$.completion")),
    Layout("question", ('{"question":"","answer":""}',), f"array({_pair('user', '$.question')}, {_pair('assistant', '$.answer')})", _texts("$.question", "$.answer")),
    Layout("instruction", ('{"instruction":"","output":""}', '{"instruction":"","input":"","output":""}'), "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', variant_get(record, '$.instruction', 'string'), nullif(variant_get(record, '$.input', 'string'), ''))), " + _pair("assistant", "$.output") + ")", _texts("$.instruction", "$.output")),
)


def fingerprint(record: str) -> str:
    """SQL: the hash of the nested field paths of a VARIANT, whatever its scalars are."""
    return rf"sha2(regexp_replace(schema_of_variant({record}), '(: |<)(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|VARIANT|VOID|DECIMAL\\([0-9]+,[0-9]+\\))(?=[,>])', '$1_'), 256)"


def to_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and canonical ``turns``."""
    marked = df.withColumn("fingerprint", F.expr(fingerprint(record)))
    cases = [(layout, " or ".join(f"fingerprint = {fingerprint(f'parse_json({text!r})')}" for text in layout.examples)) for layout in layouts]
    name = "CASE " + " ".join(f"WHEN {when} THEN '{layout.name}'" for layout, when in cases) + " " + " ".join(f"WHEN {layout.fits} THEN '{layout.name}'" for layout in layouts) + " END"
    turns = "CASE " + " ".join(f"WHEN layout = '{layout.name}' THEN {layout.turns.replace('(record,', f'({record},')}" for layout in layouts) + " END"
    named = marked.withColumn("layout", F.expr(name))
    return named.withColumn("turns", F.coalesce(F.expr(turns), F.array().cast(TURNS)))


def formatted(df: DataFrame) -> DataFrame:
    """Replaces ``turns`` by ``segments``: array<struct<text, loss>>, the template's text in order."""
    def parts(turn: Column) -> Column:
        role = F.coalesce(turn["role"], F.lit(""))
        return F.array(
            F.struct(F.concat(F.lit(START), F.url_encode(role), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(F.coalesce(turn["text"], F.lit(""))).alias("text"), (role == "assistant").alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    return df.withColumn("segments", F.flatten(F.transform("turns", parts))).drop("turns")


def full_text(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(df: DataFrame) -> DataFrame:
    """Adds ``text`` (the whole formatted text), ``turns`` (parsed from it) and ``loss_texts`` (what the mask covers), unescaped."""
    split = F.split("text", r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(split, F.lit(1), F.size(split) - 1), lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return df.withColumn("text", full_text()).withColumn("turns", F.transform(bodies, turn)).withColumn("loss_texts", loss)


def records_of_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows by turn folded into one record a conversation, in the layout ``turns``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    folded = rows.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return folded.select(key, F.to_variant_object(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))).alias("record"))


def digests(df: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`read_back` recovers."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return df.withColumns({
        "n_turns": F.size("turns").cast("long"), "turns_sha256": F.sha2(whole, 256),
        "loss_chars": F.length(loss).cast("long"), "loss_sha256": F.sha2(loss, 256), "formatted_chars": F.length("text").cast("long"),
    })
