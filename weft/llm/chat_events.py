"""Chat formatting from event logs: fold streamed deltas, edits and regenerations, then render."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.texts import portions

# The template. A turn is OPEN role CLOSE text END; no text or role can hold one of these after escaping.
OPEN, CLOSE, END = "<s><|", "|>\n", "</s>\n"


def escape(text: Column) -> Column:
    r"""Control strings made harmless: \ becomes \\, and the first sign of a control string \l for <, \b for [ or \p for |."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"<(?=/?s>|\|)", r"\\l")
    out = F.regexp_replace(out, r"\[(?=/?INST\])", r"\\b")
    return F.regexp_replace(out, r"\|(?=>)", r"\\p")


def escape_role(role: Column) -> Column:
    r"""As `escape`, and \p for any | and \n for a line end, which would end the role."""
    return F.replace(F.replace(escape(role), F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


_BACK = {"\\": "\\", "l": "<", "b": "[", "p": "|", "n": "\n"}
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def parse(turn: str) -> tuple[str, str, int]:
    """Role and text, unescaped, of one rendered turn, and where its text begins."""
    at = turn.index(CLOSE) + len(CLOSE)
    if not turn.startswith(OPEN) or not turn.endswith(END):
        raise ValueError("this is no turn of the template")
    return unescape(turn[len(OPEN) : at - len(CLOSE)]), unescape(turn[at : -len(END)]), at


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, position, role, text) of a log of events (conv_id, message, seq, kind, role, text).

    Events of a message in order of seq: `start` opens it with a role, `delta`
    adds text, `edit` replaces the text, `regenerate` discards it, `delete`
    removes the message for good. A message's position is its least seq; any
    ordered type serves as seq, and events of a conversation may interleave.
    Events are folded per message, so a hot conversation spreads over tasks.
    Equal events count once (logs repeat). Events of one seq fold in the order
    start, regenerate, edit, delta, then by text. Null texts are empty, the role
    is the last one that isn't null, else empty. A null conv_id is a
    conversation of its own. Unknown kinds only count for the position.
    """
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(("start", "regenerate", "edit", "delta")) for x in (kind, k)])
    event = F.struct(F.col("seq"), F.coalesce(F.element_at(rank, F.col("kind")), F.lit(9)).alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "kind", "role")
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(event)).alias("log"))
    reset = F.array_max(F.transform(F.filter("log", lambda e: e["kind"].isin("start", "regenerate", "edit")), lambda e: F.struct(e["seq"].alias("seq"), e["rank"].alias("rank"))))
    folded = logs.where(~F.exists("log", lambda e: F.coalesce(e["kind"] == "delete", F.lit(False)))).withColumn("reset", reset)
    live = F.filter("log", lambda e: e["kind"].isin("edit", "delta") & (F.col("reset").isNull() | (F.struct(e["seq"].alias("seq"), e["rank"].alias("rank")) >= F.col("reset"))))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select(
        "conv_id", F.col("log")[0]["seq"].alias("position"), F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """Adds `turn`, the rendered turn, and `loss_start` and `loss_end`: code points of it under the loss mask (those of an assistant's text).

    A conversation's formatted text is its turns by position, with nothing
    between; it is kept by turns so that no conversation has to fit a row.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    out = messages.withColumn("turn", F.concat(head, body, F.lit(END)))
    end = F.char_length("turn") - len(END)
    return out.withColumn("loss_start", F.when(F.col("role") == "assistant", F.char_length(head)).otherwise(end)).withColumn("loss_end", end)


def digest(rendered: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from rendered turns.

    Turns are dealt by conversation, sorted by position and streamed: a task
    holds one batch and two running digests, however long a conversation is.
    """

    conv_type = rendered.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        now, state, done, kind = None, None, [], None

        def close():
            n, turns, chars, loss, formatted = state
            done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def table():
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in portions(batches):
            kind = batch.schema.field("conv_id").type
            for conv, turn, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "loss_start", "loss_end")), strict=True):
                if now is None or conv != now[0]:
                    if state:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _ = parse(turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                under = unescape(turn[start:end])
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(turn)
            if done:
                yield table()
                done.clear()
        if state:
            close()
            yield table()

    dealt = rendered.select("conv_id", "position", "turn", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.select("conv_id", "turn", "loss_start", "loss_end").mapInArrow(read, f"conv_id {conv_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """A log of the turns (conv_id, turn, role, text) as a streaming client writes it.

    Assistants stream a draft, regenerate it, then stream the text in deltas of
    `chunk` characters; others begin to type and send the whole text as an edit.
    Rows of one turn are told apart by role, text and their number.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", nth)
    parts = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % chunk), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    draft = event("delta", F.substring("text", 1, 20))
    streamed = F.concat(F.array(event("start", F.lit("")), draft, event("regenerate", F.lit(""))), F.transform(parts, lambda p: event("delta", p)))
    typed = F.array(event("start", F.lit("")), draft, event("edit", F.col("text")))
    log = rows.select("conv_id", "turn", "nth", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("step", "event"))
    return log.select(
        "conv_id", F.struct("turn", "nth").alias("message"), F.struct("turn", "nth", "step").alias("seq"),
        F.col("event.kind").alias("kind"), F.when(F.col("event.kind") == "start", F.col("role")).alias("role"), F.col("event.text").alias("text"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All `conversations`, and one of control strings, through events, folding, rendering and back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest(render(fold_events(as_events(turns.union(probe)))))
