"""Chat formatting by incremental black-box rendering."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, table

Turn = tuple[str, str]
HEAD, END = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): (.*)</turn>\n\Z", re.S)


def escape(text: str) -> str:
    """Control strings get a backslash before them; unescape takes it away."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class TurnByTurn:
    """A template that joins what it makes of each turn, by its turn's role and text alone.

    So its output for a prefix is that for the prefix before and one turn's: history can't change, and nothing before a turn need be held. A subclass may do
    otherwise, so it is a black box like any other template.
    """

    turn: Callable[[str, str], str]

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(self.turn(*t) for t in turns)


#: `### role: text</turn>` for each turn, control strings inside roles and texts escaped.
turn_template = TurnByTurn(lambda role, text: f"{HEAD}{escape(role)}: {escape(text)}{END}")


def whole_template(turns: list[Turn]) -> str:
    """turn_template as a black box: a renderer gives it whole prefixes and compares what it makes of them."""
    return turn_template(turns)


def read_turn(piece: str) -> Turn:
    """Role and text of one formatted turn."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


class IncrementalRenderer:
    """Locates each turn's span by rendering one turn more at a time and comparing consecutive outputs.

    The template is a black box from turns to text, given whole prefixes. A turn's piece is what its output adds to the one before. If the
    output before isn't a prefix of the new one, the template rewrote history: `rewrote` is set, and the piece starts
    where the two outputs part. The conversation is held and rendered as often as it has turns.

    What a TurnByTurn template adds doesn't depend on the turns before, so it is given the last turn and the new one alone, from the first turn to the last of a
    conversation of any length; no more is held.
    """

    def __init__(self, template: Callable[[list[Turn]], str]):
        self.template = template
        self.turns: list[Turn] = []
        self.last: list[Turn] = []
        self.before, self.length = "", 0

    def add(self, role: str, text: str) -> tuple[int, str, bool]:
        """(start, piece, rewrote) of the next turn; start counts from the conversation's begin."""
        if type(self.template) is TurnByTurn:
            before, turns = self.template(self.last), [*self.last, (role, text)]
            self.last = turns[-1:]
        else:
            self.turns.append((role, text))
            before, turns = self.before, self.turns
        output = self.template(turns)
        shared = len(before)
        rewrote = not output.startswith(before)
        if rewrote:
            shared = next((i for i, (x, y) in enumerate(zip(before, output, strict=False)) if x != y), min(len(before), len(output)))
        start = self.length - len(before) + shared
        self.length += len(output) - len(before)
        self.before = "" if turns is not self.turns else output
        return start, output[shared:], rewrote


def format_chats(turns: DataFrame, template: Callable[[list[Turn]], str] = turn_template, loss_role: str = "assistant") -> DataFrame:
    """Each turn's formatted piece: conv_id, turn, role, start, piece, in_loss, rewrote.

    Conversations are rows (conv_id, turn, role, text) in order of turn, ties by role and text; null turns come first,
    null roles and texts are empty, and rows without conv_id make one conversation. A conversation's rows come to one
    task in order and flow through it. The template is given each whole prefix, so a conversation is held at once and
    rendered as often as it has turns, unless the template is a TurnByTurn one. Texts are rendered whole. Repeated rows are turns of their own. Pieces of a conversation stay together and in order.
    """
    schema = T.StructType([field(turns, "conv_id"), field(turns, "turn"), T.StructField("role", T.StringType()), T.StructField("start", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("in_loss", T.BooleanType()), T.StructField("rewrote", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer, current = None, object()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                out: list[list] = [[] for _ in range(4)]
                roles = [r or "" for r in part.column(2).to_pylist()]
                for conv, role, text in zip(part.column(0).to_pylist(), roles, part.column(3).to_pylist(), strict=True):
                    if renderer is None or conv != current:
                        renderer, current = IncrementalRenderer(template), conv
                    start, piece, rewrote = renderer.add(role, text or "")
                    for column, value in zip(out, (start, piece, role == loss_role, rewrote), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(roles, pa.string()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.bool_())], names=schema.names)

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read from its formatted pieces, which must come together and in order, as format_chats gives them.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    schema = T.StructType([field(pieces, "conv_id"), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        out: list[tuple] = []

        def closed() -> tuple:
            conv, n, turns_hash, loss, loss_hash, chars = state
            return conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars

        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, start, piece, in_loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state[0]:
                    if state is not None:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if in_loss:
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] = max(state[5], start + len(piece))
            if len(out) >= 2000:
                yield batch_of(out, kind)
                out = []
        if state is not None:
            out.append(closed())
        if out:
            yield batch_of(out, kind)

    return pieces.select("conv_id", "start", "piece", "in_loss").mapInArrow(run, schema)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_chats(turns.unionByName(planted), whole_template))  # every prefix is rendered, none is taken on trust
