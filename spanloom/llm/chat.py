"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example's text is the formatted conversation up to and with that turn; all turns before are context and only the
reply is trainable.  ``prefix_examples`` formats the turns and places the examples, one row a turn; ``expanded``
writes each example out with its whole text, and ``read_expanded`` reads those texts back.  Written out, a conversation
of n turns takes n^2 / 2 turns of text, as streams of whole examples.  Where that is too much, ``prefix_examples`` is a
form in which examples share their context, linear in the input at any length, and ``read_back`` reads it.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside roles and texts are escaped: ``<|`` gets a
backslash in between, and ``<\\|`` one more, so that nothing a speaker writes can be read as a mark, and unescaping
takes one away again.  A new line inside a role is the mark ``<|nl|>``.

Turns are ordered by (turn, role, text), nulls first.  Null roles and texts are empty ones; rows without conv_id are
one conversation; repeated rows are turns each; other columns are ignored.  A conversation without an assistant turn
has context rows and no example; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
ASSISTANT = "assistant"
#: Characters of text that ``expanded`` hands over at once.
BATCH_CHARS = 4_000_000


def escaped(column: Column) -> Column:
    """``column`` without a ``<|``: one backslash more between ``<`` and ``|``."""
    return F.regexp_replace(column, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    """The text that ``escaped`` was given."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<\\" in text else text


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to formatted turns and the examples that end in them.

    conv_id, pos (from 0), text (the formatted turn), start (code points of the conversation before it), and for
    assistant turns example (from 0), loss_start and loss_end: the reply's place in the example's text, which is
    ``text`` of this row and all before it.  Built-in functions only; a conversation is sorted and summed as a stream
    that spills, never held as one row.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    head = F.concat(F.lit(START), F.regexp_replace(escaped(F.col("role")), "\n", LINE), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escaped(F.col("said"))).withColumn("text", F.concat("head", "body", F.lit(END + "\n")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reply = F.col("role") == ASSISTANT
    none = F.lit(0).cast("long")
    rows = rows.select(
        "conv_id", (F.row_number().over(w).cast("long") - 1).alias("pos"), "text", F.coalesce(F.sum(F.length("text").cast("long")).over(before), none).alias("start"),
        F.when(reply, F.coalesce(F.sum(F.when(reply, 1).otherwise(0).cast("long")).over(before), none)).alias("example"),
        F.length("head").alias("_h"), F.length("body").alias("_b"),
    )
    begin = F.when(F.col("example").isNotNull(), F.col("start") + F.col("_h"))
    return rows.select("conv_id", "pos", "text", "start", "example", begin.alias("loss_start"), (begin + F.col("_b")).alias("loss_end"))


def _in_order(examples: DataFrame) -> DataFrame:
    """Whole conversations in a task each, rows by place: the order in which the readers below take them."""
    return examples.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def expanded(examples: DataFrame, *, rest: bool = False) -> DataFrame:
    """The examples of ``prefix_examples`` with their whole texts: conv_id, example, text, loss_start, loss_end.

    With rest=True a conversation that does not end in a reply has one row more, its last, with its whole text and
    no example, so that what comes out holds every turn.  A conversation's rows follow one another in order.  A task
    holds one conversation's text at a time.  What comes out grows with the square of a conversation's length.
    """

    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, so_far, out, held, open_ = (), "", [], 0, False

        def end() -> None:
            nonlocal held
            if rest and open_:
                out.append({"conv_id": conv, "text": so_far})
                held += len(so_far)

        for b in batches:
            for r in b.to_pylist():
                if r["conv_id"] != conv:
                    end()
                    conv, so_far = r["conv_id"], ""
                so_far += r["text"]
                open_ = r["example"] is None
                if not open_:
                    out.append({**{k: r[k] for k in ("conv_id", "example", "loss_start", "loss_end")}, "text": so_far})
                    held += len(so_far)
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = examples.select(F.col("conv_id").cast("long").alias("conv_id"), "pos", "text", "example", "loss_start", "loss_end")
    return _in_order(names).mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


def read_turn(text: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not (text.startswith(START) and text.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, said = text[len(START) : -len(END) - 1].partition("\n")
    return unescape(role.replace(LINE, "\n")), unescape(said)


class _Reader:
    """Running digests of one conversation: constant memory at any number of turns."""

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "n_turns": 0, "n_examples": 0, "loss_chars": 0, "formatted_chars": 0, "expanded_chars": 0}
        self.turns, self.loss, self.prefix, self.examples = (hashlib.sha256() for _ in range(4))

    def add(self, text: str, start: int, example: int | None, loss_start: int | None, loss_end: int | None) -> None:
        role, said = read_turn(text)
        row = self.row
        row["n_turns"] += 1
        self.turns.update(f"{role}\n{said}\n".encode())
        self.prefix.update(text.encode())
        row["formatted_chars"] += len(text)
        if example is not None:
            reply = unescape(text[loss_start - start : loss_end - start])
            self.loss.update(reply.encode())
            row["loss_chars"] += len(reply)
            row["n_examples"] += 1
            row["expanded_chars"] += start + len(text)
            self.examples.update(self.prefix.digest())  # of the whole example: context, reply and its mark

    def done(self) -> dict:
        return self.row | {"turns_sha256": self.turns.hexdigest(), "loss_sha256": self.loss.hexdigest(), "examples_sha256": self.examples.hexdigest()}


class _WholeReader:
    """Digests of one conversation from its examples' whole texts; holds the last of them."""

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "n_turns": 0, "n_examples": 0, "loss_chars": 0, "formatted_chars": 0, "expanded_chars": 0}
        self.loss, self.examples = hashlib.sha256(), hashlib.sha256()
        self.text = ""

    def add(self, example: int | None, text: str, loss_start: int | None, loss_end: int | None) -> None:
        if not text.startswith(self.text):
            raise ValueError("an example's context is not the conversation before it")
        self.text = text
        if example is not None:
            reply = unescape(text[loss_start:loss_end])
            self.loss.update(reply.encode())
            self.row["loss_chars"] += len(reply)
            self.row["n_examples"] += 1
            self.row["expanded_chars"] += len(text)
            self.examples.update(hashlib.sha256(text.encode()).digest())

    def done(self) -> dict:
        turns, n = hashlib.sha256(), 0
        for turn in self.text.split(END + "\n")[:-1]:
            role, said = read_turn(turn + END + "\n")
            turns.update(f"{role}\n{said}\n".encode())
            n += 1
        return self.row | {"n_turns": n, "formatted_chars": len(self.text), "turns_sha256": turns.hexdigest(), "loss_sha256": self.loss.hexdigest(), "examples_sha256": self.examples.hexdigest()}


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long, examples_sha256 string"


def read_back(examples: DataFrame) -> DataFrame:
    """What ``prefix_examples`` wrote, read again: a row of counts and digests for each conversation.

    turns_sha256: role, new line, text, new line of every turn; loss_chars, loss_sha256: all trainable text, unescaped;
    formatted_chars: the conversation formatted once; expanded_chars, examples_sha256: the examples' whole texts, the
    latter over their sha256 digests in order, from one running hash.  A digest is sequential, so a conversation is read
    by one task, as a stream.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in DIGESTS.split(", "))])
    names = ("conv_id", "text", "start", "example", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        for b in batches:
            for conv, *fields in zip(*(b.column(n).to_pylist() for n in names)):
                if reader is None or reader.row["conv_id"] != conv:
                    if reader is not None:
                        out.append(reader.done())
                    reader = _Reader(conv)
                reader.add(*fields)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if reader is not None:
            out.append(reader.done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = examples.select(F.col("conv_id").cast("long").alias("conv_id"), "pos", "text", "start", "example", "loss_start", "loss_end")
    return _in_order(rows).mapInArrow(run, DIGESTS)


def read_expanded(texts: DataFrame) -> DataFrame:
    """What ``expanded`` wrote with rest=True, read again: the row of counts and digests that ``read_back`` gives.

    Every example is read whole and by itself, its reply from its own text; the turns come from the conversation's
    last row.  Rows are taken in the order in which ``expanded`` hands them on, without another exchange.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in DIGESTS.split(", "))])
    names = ("conv_id", "example", "text", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        for b in batches:
            for conv, *fields in zip(*(b.column(n) for n in names)):
                conv = conv.as_py()
                if reader is None or reader.row["conv_id"] != conv:
                    if reader is not None:
                        out.append(reader.done())
                    reader = _WholeReader(conv)
                reader.add(*(f.as_py() for f in fields))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if reader is not None:
            out.append(reader.done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return texts.select(*names).mapInArrow(run, DIGESTS)
