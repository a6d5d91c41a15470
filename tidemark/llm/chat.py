"""Conversations from event logs, rendered for training with reversible escapes.

Events of a conversation, in the order of ``seq``: ``open`` begins a message,
``delta`` adds text to it, ``edit`` and ``regenerate`` replace what it had,
``delete`` takes it away. A regeneration also voids what came before it in
later messages of the conversation.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
RESETS = ("open", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """Puts one more backslash between ``<`` and ``|``, so no mark is left; ``unescape`` takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that are left after all events.

    ``events``: conv_id, seq, kind, message, role, text. ``seq`` and
    ``message`` may have any type with an order; messages follow each other in
    theirs. Events are folded by (conversation, message), so a conversation
    with very many events is many small tasks.

    Events that repeat a (conv_id, seq) are one (the smallest), as after a
    second delivery. Null texts add nothing. The role is that of the last event
    that has one, else empty. Null conversations and messages count as values.
    An event of another kind is left out.
    """
    events = events.filter(F.col("kind").isin("delta", *RESETS))
    body = ["kind", "message", "role", "text"]
    events = events.groupBy("conv_id", "seq").agg(F.min(F.struct(*body)).alias("e")).select("conv_id", "seq", "e.*")
    reset, again = F.when(F.col("kind").isin(*RESETS), F.col("seq")), F.when(F.col("kind") == "regenerate", F.col("seq"))
    marks = events.groupBy("conv_id", "message").agg(F.max(reset).alias("reset"), F.max(again).alias("again"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("void", F.max("again").over(before))
    marks = marks.select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "reset", "void")
    live = events.join(marks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("message").eqNullSafe(F.col("m")))
    kept = (F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))) & (F.col("void").isNull() | (F.col("seq") > F.col("void")))
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    last = F.max(F.when(kept, F.struct("seq", "kind")))
    role = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"]
    messages = live.groupBy("conv_id", "message").agg(role.alias("role"), parts.alias("parts"), last.alias("last"))
    messages = messages.filter("last is not null and last.kind <> 'delete'")
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return messages.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one text for each conversation, and the code point ranges of assistant texts in it.

    A conversation is one training example and so one row; it is put together
    from messages that are rendered one by one.
    """
    turn = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n"))
    rows = messages.select("conv_id", "message", "role", turn.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("all", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("message")
    rows = rows.withColumn("begin", F.sum(F.char_length("all")).over(order) - F.char_length("all") + F.char_length("head"))
    span = F.struct(F.col("begin"), (F.col("begin") + F.char_length("body")).alias("end"))
    rows = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message", "all"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
    )
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["all"]), "").alias("formatted"), "loss")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts that a formatted conversation has."""
    turns = []
    for turn in formatted.split(BEGIN)[1:]:
        role, _, rest = turn.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.index(END)])))
    return turns


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the formatted text and its mask."""

    def run(batches):
        for batch in batches:
            done = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learnt = "".join(unescape(text[s["begin"] : s["end"]]) for s in loss)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learnt)]
                done.append((len(turns), digests[0], len(learnt), digests[1], len(text)))
            columns = zip(*done) if done else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rendered.schema["conv_id"].dataType.simpleString()
    return rendered.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def as_events(turns: DataFrame, chunk: int = 200) -> DataFrame:
    """A log that folds into a table of turns (conv_id, turn, role, text).

    Every turn is opened and streamed in pieces. As in the log of a live
    service, some take a detour, by a hash of conversation and turn: a wrong
    text that is edited; a first answer, and a message in reply to it, that a
    regeneration voids; a message behind the turn that is deleted.

    Turns that repeat a number are messages of their own, in the order of role
    and text. Null texts are empty and only opened; null conversations, numbers
    and roles are values. Very long texts are many events. Other columns are
    not read.
    """
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"copy": F.row_number().over(tie), "way": F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))})

    def event(kind: str, text=None, role=None, branch: int = 0) -> Column:
        text, role = (F.lit(None).cast("string") if x is None else x for x in (text, role))
        return F.struct(F.lit(kind).alias("kind"), F.lit(branch).alias("branch"), role.alias("role"), text.alias("text"))

    numbers = F.sequence(F.lit(0), F.floor((F.char_length("text") + chunk - 1) / chunk).cast("int"))
    streamed = F.transform(F.filter(numbers, lambda i: i > 0), lambda i: event("delta", F.substr("text", (i - 1) * chunk + 1, F.lit(chunk))))
    opened, user = event("open", role=F.col("role")), F.lit("user")
    wrong = F.reverse(F.substr("text", F.lit(1), F.lit(chunk)))
    log = (
        F.when(F.col("way") == 1, F.concat(F.array(opened, event("delta", wrong), event("edit")), streamed))
        .when(
            F.col("way") == 2,
            F.concat(
                F.array(opened), streamed, F.array(event("open", role=user, branch=1), event("delta", F.lit("Again?"), branch=1), event("regenerate")),
                streamed,
            ),
        )
        .when(
            F.col("way") == 3,
            F.concat(F.array(opened), streamed, F.array(event("open", wrong, user, branch=1), event("delete", branch=1))),
        )
        .otherwise(F.concat(F.array(opened), streamed))
    )
    rows = rows.select("conv_id", "turn", "copy", F.posexplode(log).alias("at", "e"))
    seq, message = F.struct("turn", "copy", "at"), F.struct("turn", "copy", "e.branch")
    return rows.select("conv_id", seq.alias("seq"), "e.kind", message.alias("message"), "e.role", "e.text")
