"""Chat formatting with a grammar round trip.

Each turn becomes one fragment of a fixed grammar::

    turn := "<s>[INST]" role "[/INST]" text "</s>"

A fragment is rendered with its content as it is, reparsed by the deterministic
parser below and compared with the source; content that doesn't come back
identical (it holds control strings, or looks escaped already) is escaped and
the check repeats. Escaping puts a backslash after the first character of every
control string, also of those that hold backslashes there already, so it can
always be undone. A conversation's text is the concatenation of its fragments.

Formatting is row-wise. Reading back sorts the fragments of a conversation within
a partition and folds over them in a stream, so a conversation of any length
needs the memory of one batch; its digest is a running one.

Cases: null role or text counts as empty; rows are ordered by turn and fragment,
null turns first, so ties have one order and repeated rows stay; rows without a
conversation id form one conversation; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import record_batch, sliced, text_or_empty

BEGIN, ROLE, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
FRAGMENT = "conv_id bigint, turn bigint, fragment string, loss_start int, loss_end int, place bigint"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")


def escape(content: str) -> str:
    """Content without control strings, from which :func:`unescape` gets it back."""
    return _CONTROL.sub(r"\1\\\2\3", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"\1\2", content)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's fragment, and where its text begins and ends in it."""
    head = f"{BEGIN}{ROLE}{role}{BODY}"
    return f"{head}{text}{END}", len(head), len(head) + len(text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns (role, text, start, end) of formatted text; ValueError if it isn't of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN + ROLE, at):
            raise ValueError(f"no turn begins at character {at}")
        role_at = at + len(BEGIN + ROLE)
        body = formatted.find(BODY, role_at)
        text_at = body + len(BODY)
        end = formatted.find(END, text_at)
        if body < 0 or end < 0:
            raise ValueError(f"the turn at character {at} doesn't end")
        turns.append((unescape(formatted[role_at:body]), unescape(formatted[text_at:end]), text_at, end))
        at = end + len(END)
    return turns


def _survives(role: str, text: str, shown_role: str, shown_text: str) -> bool:
    try:
        turns = parse(render(shown_role, shown_text)[0])
    except ValueError:
        return False
    return len(turns) == 1 and turns[0][:2] == (role, text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A fragment that reads back as exactly this role and text, escaped no more than it needs."""
    for shown in ((role, text), (role, escape(text)), (escape(role), text), (escape(role), escape(text))):
        if _survives(role, text, *shown):
            return render(*shown)
    raise AssertionError("escaped content always survives")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One fragment for each row (conv_id, turn, role, text).

    ``loss_start`` and ``loss_end`` are the code points of the fragment that the
    loss covers (an assistant's text; both null for other roles), ``place`` orders
    rows of one turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                fragment, start, end = format_turn(role, text)
                rows.append((fragment, start, end) if role == LEARNED else (fragment, None, None))
            columns = [list(x) for x in zip(*rows, strict=True)] or [[], [], []]
            yield record_batch({"conv_id": batch.column(0), "turn": batch.column(1), "fragment": columns[0], "loss_start": columns[1], "loss_end": columns[2], "place": [0] * len(rows)}, FRAGMENT)

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, FRAGMENT).drop("place")


def read_back(fragments: DataFrame) -> DataFrame:
    """A row for each conversation, parsed from its fragments in order.

    Digests are those of the recovered turns and of the text under the loss mask,
    which the parser unescapes from the masked characters themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None

        def result() -> tuple:
            return (last, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"])

        for batch in sliced(batches):
            done = []
            for conv, fragment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != last:
                    if state is not None:
                        done.append(result())
                    last, state = conv, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, text, *_ in parse(fragment):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(fragment[start:end])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["formatted"] += len(fragment)
            if done:
                yield table(done)
        if state is not None:
            yield table([result()])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return record_batch({name.split()[0]: list(x) for name, x in zip(READ.split(","), zip(*rows, strict=True), strict=True)}, READ)

    return fragments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "fragment").select("conv_id", "fragment", "loss_start", "loss_end").mapInArrow(run, READ)
