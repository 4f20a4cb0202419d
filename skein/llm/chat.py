"""Chat formatting: a finite-state machine over roles, a declarative template, and segments with loss flags.

Turns are sorted by conversation within each partition and stream through the formatter, one turn at a time, so a
conversation of any length takes the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written and which may follow which.

    ``head`` and ``tail`` enclose a turn's text; they are control text, never under the loss.  ``control`` begins every
    control string; inside texts and roles it is escaped, reversibly.  ``follows`` maps a role ("" before the first
    turn) to the roles that may come next, ``final`` has the roles that may end a conversation, ``loss`` those whose
    text is trained on.
    """

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    control: str = "<|"
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    loss: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        """Backslashes are doubled and one is put inside each control prefix, so that none is left."""
        return text.replace("\\", "\\\\").replace(self.control, self.control[0] + "\\" + self.control[1:])

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def escape_role(self, role: str) -> str:
        """A role may not end the line that it stands in."""
        return self.escape(role).replace("\n", "\\n")

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.head.replace("{role}", self.escape_role(role)), False), (self.escape(text), role in self.loss), (self.tail, False)]

    def turn_pattern(self) -> re.Pattern:
        """Matches a formatted turn: the role and the text, both still escaped."""
        before, after = map(re.escape, self.head.split("{role}"))
        return re.compile(f"{before}([^\n]*?){after}(.*?){re.escape(self.tail)}", re.DOTALL)


SEGMENTS = "conversation string, conv_id long, turn_no long, segment int, text string, loss boolean, in_order boolean, may_end boolean"


def segments(conversations: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted segments: conversation, conv_id, turn_no, segment, text, loss, in_order, may_end.

    Turns go by ``turn``, ties by role and text; repeated rows are turns of their own.  Null roles and texts are
    empty; a row without conv_id is a conversation of its own, as nothing joins such rows; ``conversation`` names each.
    Turns out of order are formatted all the same, with in_order false: the state machine goes on from the role it met.  All
    segments of a conversation are consecutive rows of one partition; a text of any length is one segment; an empty table
    gives no rows; other columns may have any names.
    """
    shape = template or Template()
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = rows.withColumn("apart", apart).repartition("conv_id", "apart").sortWithinPartitions("conv_id", "apart", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        part, lone = TaskContext.get().partitionId(), 0
        conv, name, state, turn = object(), "", "", 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                out = []
                some = batch.slice(begin, 1000)
                for c, role, text in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    if c is None or c != conv:
                        conv, state, turn, lone = c, "", 0, lone + (c is None)
                        name = f"-{part}-{lone}" if c is None else str(c)
                    fine = role in shape.follows.get(state, ())
                    out += [(name, c, turn, k, t, loss, fine, role in shape.final) for k, (t, loss) in enumerate(shape.segments(role, text))]
                    state, turn = role, turn + 1
                yield batch_of(out)

    return rows.mapInArrow(run, SEGMENTS)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    names = ("conversation", "conv_id", "turn_no", "segment", "text", "loss", "in_order", "may_end")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse formatted segments and sum each conversation up: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.

    Segments may lie anywhere, as in a stored table that is read in splits: they are dealt and sorted by conversation first.
    Only the formatted text and the loss flags are read; ``valid`` comes from the state machine's flags.  Text that the template
    didn't make raises.
    """
    shape = template or Template()
    formatted = formatted.repartition("conversation").sortWithinPartitions("conversation", "turn_no", "segment")

    def run(batches: Iterator[pa.RecordBatch]):
        pattern, rows = shape.turn_pattern(), []
        name, conv, now = None, None, None

        def start():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "held": "", "may_end": False}

        def row():
            if now["held"]:
                raise ValueError(f"formatted text of conversation {conv} doesn't parse")
            return (conv, now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["valid"] and now["may_end"])

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in DIGESTS.split(", ")])

        for batch in batches:
            for this, c, text, loss, fine, may_end in zip(*(batch.column(n).to_pylist() for n in ("conversation", "conv_id", "text", "loss", "in_order", "may_end")), strict=True):
                if now is None or this != name:
                    if now is not None:
                        rows.append(row())
                    name, conv, now = this, c, start()
                now["chars"] += len(text)
                now["valid"] &= fine
                now["may_end"] = may_end
                if loss:
                    plain = shape.unescape(text)
                    now["loss_chars"] += len(plain)
                    now["loss"].update(plain.encode())
                now["held"] += text
                if text.endswith(shape.tail) and (found := pattern.fullmatch(now["held"])):
                    role, said = shape.unescape_role(found[1]), shape.unescape(found[2])
                    now["turns"].update(f"{role}\n{said}\n".encode())
                    now["n"] += 1
                    now["held"] = ""
            if len(rows) >= 1000:
                yield flush()
                rows.clear()
        if now is not None:
            rows.append(row())
        yield flush()

    return formatted.mapInArrow(run, DIGESTS)
