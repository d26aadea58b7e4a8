"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all turns before
it are the context, and only its reply is trainable. Written out in full, the
examples of one conversation would repeat its first turns once for each reply,
which grows with the square of its turns. The files therefore hold each
formatted turn once, in order, and an example as a span of the conversation's
formatted text: it starts where the conversation starts, ends at ``end``, and
its loss mask is the span from ``loss_start`` to ``loss_end``. ``expanded``
writes examples out.

A turn is formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and
texts every ``<`` followed by backslashes (or none) and ``|`` gets one
backslash more, which keeps control strings out of texts and is undone by
taking one away. Line ends in a role are escaped in the same way.

Turns are dealt to tasks by ranges of (conversation, turn, role, text), so that
a conversation of any length is spread over tasks. Each task counts positions
from where a conversation begins in its part; ``offsets`` holds, for the
conversations that go on from one part into the next, what came before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, partitions, scratch

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def _role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def plain_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def formatted_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, place, start, end, loss_start, loss_end (null but for assistant turns), formatted; numbers count from the conversation's first turn in its part.

    Turns stand in the order of turn, then role, then text; a null turn comes
    first. Null roles and texts are empty. Repeated rows stay repeated turns. A
    null conv_id is a conversation of its own. Positions count characters.
    Other columns are ignored; an empty table gives none.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(partitions(conversations.sparkSession), *keys).sortWithinPartitions(*keys)
    rows = rows.select("conv_id", (F.col("role") == "assistant").alias("trained"), F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(f"{END}\n")).alias("formatted"))
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, tail = TaskContext.get().partitionId(), len(f"{START}assistant\n"), len(f"{END}\n")
        now, place, at = object(), 0, 0
        for batch in batches:
            out = []
            for conv, trained, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.utf8_length(batch.column(2)).to_pylist(), strict=True):
                if conv != now:
                    now, place, at = conv, 0, 0
                end = at + size
                out.append((part, place, at, end, at + head if trained else None, end - tail if trained else None))
                place, at = place + 1, end
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["conv_id", *schema.names, "formatted"])

    bounded_batches(conversations.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    return rows.mapInArrow(number, f"conv_id {kind}, part int, place long, start long, end long, loss_start long, loss_end long, formatted string")


def write_chat(conversations: DataFrame, target: str, **columns) -> None:
    """Write ``turns``, ``offsets`` and ``examples`` under target. Every assistant turn is exploded into an example; ``columns`` go to ``formatted_turns``."""
    spark = conversations.sparkSession
    formatted_turns(conversations, **columns).write.mode("overwrite").parquet(f"{target}/turns")
    held = spark.read.parquet(f"{target}/turns").groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.max("end").alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A part goes on with one conversation at most, so this has no more rows than there are parts.
    held.select("conv_id", "part", F.sum("turns").over(before).alias("turns"), F.sum("chars").over(before).alias("chars")).filter("turns > 0").write.mode("overwrite").parquet(f"{target}/offsets")
    replies = read_turns(spark, target).filter("loss_start is not null")
    replies.select("conv_id", F.col("place").alias("example"), "end", "loss_start", "loss_end").write.mode("overwrite").parquet(f"{target}/examples")


def read_turns(spark, target: str) -> DataFrame:
    """conv_id, place (from 0), start, end, loss_start, loss_end, formatted, counted from the conversation's start."""
    turns, offsets = spark.read.parquet(f"{target}/turns").alias("t"), spark.read.parquet(f"{target}/offsets").alias("o")
    rows = turns.join(F.broadcast(offsets), (F.col("t.part") == F.col("o.part")) & F.col("t.conv_id").eqNullSafe(F.col("o.conv_id")), "left")
    moved = lambda c, by: (F.col(f"t.{c}") + F.coalesce(F.col(f"o.{by}"), F.lit(0))).alias(c)
    return rows.select("t.conv_id", moved("place", "turns"), *(moved(c, "chars") for c in ("start", "end", "loss_start", "loss_end")), "t.formatted")


def expanded(spark, target: str, wanted: DataFrame | None = None) -> DataFrame:
    """The examples written out: conv_id, example, text, loss_start, loss_end; of the conversations in ``wanted`` (conv_id) if given. Its size is that of all contexts together."""
    turns, held = read_turns(spark, target), spark.read.parquet(f"{target}/examples")
    if wanted is not None:
        turns, held = (df.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi") for df in (turns, held))
    held = held.alias("e").join(turns.alias("t"), (F.col("e.conv_id").eqNullSafe(F.col("t.conv_id"))) & (F.col("t.end") <= F.col("e.end")))
    pieces = held.groupBy("e.conv_id", "e.example", "e.loss_start", "e.loss_end").agg(F.array_sort(F.collect_list(F.struct("t.place", "t.formatted"))).alias("p"))
    return pieces.select("conv_id", "example", F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("text"), "loss_start", "loss_end")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over turns (conv_id, start, end, text) and loss spans (the same without a text) sorted by conversation and start. Holds one turn and one conversation's hash states at a time."""
    none = object()
    now, state, turn, out = none, None, (0, 0, ""), []
    put = lambda h, text: h.update(text.encode(errors="surrogatepass"))

    def done() -> None:
        if state is not None:
            out.append({"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]})

    for batch in batches:
        for conv, start, end, formatted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if now is none or conv != now:
                done()
                now, state, turn = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], (0, 0, "")
            if formatted is None:  # a loss span: what stands there in the conversation's formatted text
                if not turn[0] <= start <= end <= turn[1]:
                    raise ValueError(f"conversation {conv}: the loss span {start} to {end} is in no turn")
                text = unescape(turn[2][start - turn[0] : end - turn[0]])
                state[2] += len(text)
                put(state[3], text)
                continue
            if start != turn[1] or end - start != len(formatted):
                raise ValueError(f"conversation {conv}: the turn at {start} doesn't follow the one before, or not to {end}")
            turn = (start, end, formatted)
            role, _, text = formatted[len(START) :].partition("\n")
            state[0] += 1
            put(state[1], f"{plain_role(role)}\n{unescape(text[: -len(END) - 1])}\n")
            state[4] += len(formatted)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
            out.clear()
    done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)


def digest(spark, target: str) -> DataFrame:
    """Each conversation as read back from the files: conv_id, n_turns, turns_sha256 (of role, \\n, text, \\n of each turn), loss_chars and loss_sha256 (of the text under the examples' loss masks, cut out by loss_start and loss_end), formatted_chars.

    A hash over a conversation asks for its turns in order, so each streams
    through one task, which holds a turn and the hash states only. Files whose
    turns leave gaps, or whose loss spans lie in no turn, are an error.
    """
    turns = read_turns(spark, target).select(F.col("conv_id").cast("long").alias("conv_id"), "start", "end", "formatted")
    spans = spark.read.parquet(f"{target}/examples").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("loss_start").alias("start"), F.col("loss_end").alias("end"), F.lit(None).cast("string").alias("formatted"))
    rows = turns.unionByName(spans).repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digest(conversations: DataFrame, target: str | None = None) -> DataFrame:
    """Format conversations into files (by default in a new scratch folder) and digest what is read back."""
    target = target or f"{scratch(conversations.sparkSession)}/chat"
    write_chat(conversations, target)
    return digest(conversations.sparkSession, target)
