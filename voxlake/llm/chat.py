"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names each role's opening marker, the closing marker, the roles under loss, and the order of turns as
transitions of a state machine. Formatting yields text segments with a loss flag each. Control strings inside texts are escaped,
so the output can be read back to the same turns. Turns of a conversation are streamed in order: a task
holds one turn at a time, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

START = "start"
WRONG = "wrong"


@dataclass(frozen=True)
class Template:
    """``labels`` by role, the strings around them, and ``moves``: state -> role -> next state; ``accepting`` states end well."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    mark: str = "###"
    after_mark: str = " "
    after_label: str = ": "
    close: str = "</turn>"
    between: str = "\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {START: {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    accepting: tuple[str, ...] = ("user", "assistant")

    def step(self, state: str, role: str) -> str:
        return self.moves.get(state, {}).get(role, WRONG)

    def label(self, role: str) -> str:
        """A role's label; a role that the template doesn't name is written percent-encoded after an equals sign."""
        return self.labels.get(role) or "=" + quote(role, safe="")

    def role(self, label: str) -> str:
        return unquote(label[1:]) if label.startswith("=") else {v: k for k, v in self.labels.items()}[label]

    def _controls(self) -> str:
        return "|".join(map(re.escape, (self.escape, self.mark, self.close)))

    def protect(self, text: str) -> str:
        return re.sub(self._controls(), lambda m: self.escape + m[0], text)

    def restore(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}({self._controls()})", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments and whether each is under loss."""
        return [(f"{self.mark}{self.after_mark}{self.label(role)}{self.after_label}", False), (self.protect(text), role in self.loss_roles), (f"{self.close}{self.between}", False)]


class Reader:
    """Reads turns back from formatted text that comes in parts; holds no more than the turn it is in."""

    def __init__(self, template: Template):
        t = self.template = template
        self.text, self.mask = "", []
        self.head = re.compile(re.escape(t.mark + t.after_mark) + "(.*?)" + re.escape(t.after_label), re.S)
        self.control = re.compile(f"{re.escape(t.escape)}(?:{t._controls()})|{re.escape(t.close)}|{re.escape(t.mark)}")
        self.end = t.close + t.between

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """Completed turns as (role, text, text under loss)."""
        if loss:
            self.mask.append((len(self.text), len(self.text) + len(text)))
        self.text += text
        while head := self.head.match(self.text):
            close = next((m for m in self.control.finditer(self.text, head.end()) if not m[0].startswith(self.template.escape)), None)
            if close is None or not self.text.startswith(self.end, close.start()):
                if close is not None and close[0] == self.template.mark:
                    raise ValueError("a turn opens inside another")
                return
            a, b = head.end(), close.start()
            learnt = "".join(self.template.restore(self.text[max(a, x) : min(b, y)]) for x, y in self.mask if x < b and y > a)
            yield self.template.role(head[1]), self.template.restore(self.text[a:b]), learnt
            done = b + len(self.end)
            self.text, self.mask = self.text[done:], [(x - done, y - done) for x, y in self.mask if y > done]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, each conversation in one partition and in the order of turns."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(conversations: DataFrame, template: Template) -> DataFrame:
    """conv_id, turn_no, part, text, loss, state: three segments a turn (opening, text, closing), in order within partitions.

    ``state`` is the state machine's after the turn; ``wrong`` once the order of turns is broken, to the conversation's end.
    Null texts and roles count as empty. Turns with equal or null numbers go by role and text (null first), repeated rows are turns each.
    Other columns are ignored.
    """

    small_batches(conversations.sparkSession)

    def form(batches):
        conv, state, turn_no = object(), START, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, state, turn_no = c, START, 0
                state = template.step(state, role)
                out += [(c, turn_no, part, s, loss, state) for part, (s, loss) in enumerate(template.segments(role, text))]
                turn_no += 1
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn_no", "part", "text", "loss", "state"])

    return ordered(conversations).mapInArrow(form, "conv_id long, turn_no long, part int, text string, loss boolean, state string")


def digests(formatted: DataFrame, template: Template) -> DataFrame:
    """What is read back from segments in order: a row per conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (text under loss, without
    escapes), formatted_chars, valid (the order of turns is the template's).
    """

    def read(batches):
        conv, own = object(), None
        rows = []

        def close():
            if own:
                if own["reader"].text:
                    raise ValueError("the formatted text ends inside a turn")
                rows.append((conv, own["n"], own["turns"].hexdigest(), own["loss_chars"], own["loss"].hexdigest(), own["chars"], own["state"] in template.accepting))

        def flush():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for c, text, loss, state in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss", "state")), strict=True):
                if own is None or c != conv:
                    close()
                    conv, own = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "state": START, "reader": Reader(template)}
                own["chars"] += len(text)
                own["state"] = state
                for role, said, learnt in own["reader"].feed(text, loss):
                    own["n"] += 1
                    own["turns"].update(f"{role}\n{said}\n".encode())
                    own["loss"].update(learnt.encode())
                    own["loss_chars"] += len(learnt)
            if rows:
                yield flush()
                rows.clear()
        close()
        if rows:
            yield flush()

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
