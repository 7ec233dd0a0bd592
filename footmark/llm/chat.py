"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a row (conv_id, turn, role, parts); a part is a struct (kind, text, ref, tokens) of kind text, image,
audio or document.  The visitor flattens the parts of a message in order: text is escaped, every other part becomes
a placeholder ``<kind:turn.part>`` and an attachment record with its reference and expanded token count.

The template is ``<s>`` and, per turn, ``[INST]role[/INST]text</s>``.  Inside roles and texts a backslash, ``[`` and
``<`` are written ``\\s``, ``\\b`` and ``\\a``, so no control string can appear there and the output can be read back
without loss.  ``runs`` is the output in pieces with a loss flag: assistant texts are under the mask.

Nulls and edge cases: a null role, text or part list is empty; a null kind counts as text; rows of a null ``conv_id``
are one conversation; turns that tie are ordered by role and content; repeated rows are repeated turns; an empty
table gives an empty result; other columns are ignored.  A conversation is one output row, so its turns meet in one
task; different conversations never do more than share a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: control strings of the template ---
BEGIN, ROLE, ROLE_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\s"), ("[", "\\b"), ("<", "\\a"))
#: Tokens of a part that does not say how many it has.
TOKENS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """The backslash goes last: before that, each backslash still begins one escape."""
    for raw, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """Messages with plain text have one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("long").alias("tokens")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(turn: Column, parts: Column) -> tuple[Column, Column]:
    """Content with placeholders, and the attachments, of one message."""
    parts = F.coalesce(parts, F.array())
    mark = lambda p, i: F.concat(F.lit("<"), escape(p["kind"]), F.lit(":"), F.coalesce(turn, F.lit(-1)).cast("string"), F.lit("."),
                                 i.cast("string"), F.lit(">"))
    content = F.array_join(F.transform(parts, lambda p, i: F.when(is_text(p), escape(p["text"])).otherwise(mark(p, i))), "")
    default = F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair])
    attached = F.filter(F.transform(parts, lambda p, i: F.when(~is_text(p), F.struct(
        mark(p, i).alias("placeholder"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        F.coalesce(p["tokens"].cast("long"), default[p["kind"]].cast("long"), F.lit(0).cast("long")).alias("tokens")))),
        lambda x: x.isNotNull())
    return content, attached


def format_conversations(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, formatted, runs, attachments, attachment_tokens of each conversation."""
    content, attached = visit(F.col("turn"), F.col("parts"))
    rows = messages.select(key, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"),
                                         attached.alias("attached")).alias("m"))
    turns = rows.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("turns"))
    run = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(F.transform("turns", lambda m: F.array(
        run(F.concat(F.lit(ROLE), escape(m["role"]), F.lit(ROLE_END)), F.lit(False)),
        run(m["content"], m["role"] == "assistant"),
        run(F.lit(TURN_END), F.lit(False)))))
    runs = F.concat(F.array(run(F.lit(BEGIN), F.lit(False))), pieces)
    return (turns.select(key, F.size("turns").cast("long").alias("n_turns"), runs.alias("runs"),
                         F.flatten(F.transform("turns", lambda m: m["attached"])).alias("attachments"))
            .withColumn("formatted", F.array_join(F.col("runs.text"), ""))
            .withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, placeholders still in the text."""
    body = formatted.substr(F.lit(len(BEGIN) + 1), F.length(formatted))
    chunks = F.split(body, r"</s>")
    own = F.slice(chunks, 1, F.size(chunks) - 1)
    return F.transform(own, lambda c: F.struct(
        unescape(F.substring_index(c.substr(F.lit(len(ROLE) + 1), F.length(c)), ROLE_END, 1)).alias("role"),
        unescape(F.substring_index(c, ROLE_END, -1)).alias("text")))


def loss_text(runs: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(runs, lambda r: r["loss"]), lambda r: r["text"]), ""))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what can be read from the output."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted.withColumn("read", turns).withColumn("loss", loss_text(F.col("runs")))
            .select(key, F.size("read").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
