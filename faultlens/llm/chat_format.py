"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_chats`` turns turns into text segments, each with a loss flag; ``read_back`` parses segments
into turns again. Control strings inside texts and roles are escaped reversibly, so that a text can
never end its own turn or open another.

Defined results: a null text or role counts as empty; rows of one conversation are ordered by turn,
then role, then text (nulls first), so repeated rows and ties give the same output on each run;
repeated rows are separate turns; an empty table gives no rows; other columns of the input are
ignored. A conversation whose roles break the turn order is formatted too, with ``valid`` false.
Memory per task is one turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, which roles' text is trained on, and which role may follow which."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> roles that may come next; "" is the start.
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
SEGMENTS_DDL = "conv_id long, seg long, kind string, text string, loss boolean, valid boolean"
READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def escape(text: str) -> str:
    r"""``<``, k backslashes, ``|`` becomes the same with k+1, so that no ``<|`` is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _segments(template: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seg, valid = object(), "", 0, True
        for batch in batches:
            rows: list[tuple] = []
            for cid, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                role, text = role or "", text or ""
                if cid != conv:
                    conv, state, seg, valid = cid, "", 0, True
                valid = valid and role in template.follows.get(state, ())
                state = role
                rows.append((cid, seg, "open", f"{template.open}{escape_role(role)}\n", False, valid))
                rows.append((cid, seg + 1, "text", escape(text), role in template.loss_roles, valid))
                rows.append((cid, seg + 2, "close", f"{template.close}\n", False, valid))
                seg += 3
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(SEGMENTS, zip(*rows, strict=True), strict=True)], schema=SEGMENTS)

    return run


def _digests(template: ChatTemplate):
    """Reads the formatted text itself: turns are found by the template's marks, not by the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = None
        cur: dict | None = None
        done: list[tuple] = []

        def finish() -> None:
            if cur:
                done.append((conv, cur["n"], cur["turns"].hexdigest(), cur["loss_chars"], cur["loss"].hexdigest(), cur["chars"], cur["valid"]))

        def turns(buffer: str) -> str:
            while buffer.startswith(template.open) and (end := buffer.find(f"{template.close}\n")) >= 0:
                role, _, text = buffer[len(template.open) : end].partition("\n")
                cur["n"] += 1
                cur["turns"].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                buffer = buffer[end + len(template.close) + 1 :]
            return buffer

        for batch in batches:
            for cid, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if cur is None or cid != conv:
                    finish()
                    conv, cur = cid, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "rest": ""}
                cur["chars"] += len(text)
                cur["valid"] &= valid
                if loss:
                    plain = unescape(text)
                    cur["loss"].update(plain.encode())
                    cur["loss_chars"] += len(plain)
                cur["rest"] += text
                if text.endswith(f"{template.close}\n"):
                    cur["rest"] = turns(cur["rest"])
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(READ, zip(*done, strict=True), strict=True)], schema=READ)
                done = []
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(READ, zip(*done, strict=True), strict=True)], schema=READ)

    return run


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, turn, role, text) -> segments (conv_id, seg, kind, text, loss, valid), in order.

    One shuffle by conversation; rows then stream through the state machine in turn order.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_segments(template), SEGMENTS_DDL)


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation, what the formatted text says. ``segments``: in format_chats' order and partitions."""
    return segments.mapInArrow(_digests(template), READ_DDL)
