r"""Chat formatting with a grammar round trip.

A turn is rendered as <|im_start|>ROLE newline TEXT <|im_end|> newline. `<|` opens a control string, whatever follows it,
and is the template's alone: no text or role may hold it as it is. The parser is deterministic: it reads the opening mark, the
role up to the newline, the text up to the first closing mark, refuses any other `<|`, and takes one backslash
out of every `<\|`, `<\\|`, ... A turn is rendered as it is first and parsed again; if that fails, or the turn recovered
differs from the source, its text and then its role are escaped (one backslash put into every `<|`, `<\|`, ...;
backslash and newline of a role become two characters) until the round trip is identical. So no rendering holds
a control string that the template didn't put there, and every text comes back unchanged.

Rendering is per turn, so a conversation of any length needs no more memory than one turn.
Digests of a conversation are taken by streaming its turns, sorted, through the parser.

Defined results: null role or text is the empty string; turns with equal numbers are ordered
by role, then text; a null turn number comes first; turns with a null conv_id form one
conversation with a null id; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, with_columns
from .runtime import partitions

OPEN, CLOSE, CONTROL = "<|im_start|>", "<|im_end|>", "<|"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n"}


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(re.sub(r"[\\\n]", lambda m: _ROLE_OUT[m[0]], role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn; GrammarError if it isn't a sequence of turns."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise GrammarError(f"no opening mark at {at}")
        line = rendered.find("\n", at)
        if line < 0:
            raise GrammarError("no end of role")
        role = rendered[at + len(OPEN) : line]
        if CONTROL in role:
            raise GrammarError("a control string inside a role")
        close = rendered.find(CLOSE, line + 1)
        if close < 0 or not rendered.startswith("\n", close + len(CLOSE)):
            raise GrammarError("no closing mark")
        if CONTROL in rendered[line + 1 : close]:
            raise GrammarError("a control string inside a text")
        turns.append((unescape_role(role), unescape(rendered[line + 1 : close]), line + 1, close))
        at = close + len(CLOSE) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering, and start and end of its text in it; escaped where the plain form isn't accepted or doesn't come back."""
    forms = ((role, text), (role, escape(text)), (escape_role(role), escape(text)))
    for r, x in forms:
        out = f"{OPEN}{r}\n{x}{CLOSE}\n"
        try:
            turns = parse(out)
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return out, turns[0][2], turns[0][3]
    raise GrammarError("no form of the turn comes back")


FORMATTED = [field("rendered", T.StringType()), field("mask_start", T.LongType()), field("mask_end", T.LongType())]


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Adds each turn's rendering and the span of it under the loss mask (null outside the loss role)."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out, start, end = [], [], []
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            for role, text in zip(get(role_col), get(text_col), strict=True):
                rendered, a, b = render(role or "", text or "")
                out.append(rendered)
                start.append(a if role == loss_role else None)
                end.append(b if role == loss_role else None)
            return [out, start, end]

        return work

    return with_columns(turns, FORMATTED, make)


DIGEST = T.StructType(
    [
        field("conv_id", T.LongType()),
        field("n_turns", T.LongType()),
        field("turns_sha256", T.StringType()),
        field("loss_chars", T.LongType()),
        field("loss_sha256", T.StringType()),
        field("formatted_chars", T.LongType()),
    ]
)


class _Running:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, rendered: str, start: int | None, end: int | None) -> None:
        self.chars += len(rendered)
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(rendered[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, from the renderings alone: role and text only settle the order of equal turn numbers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Running(conv)
                now.feed(*turn)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, r, strict=True)) for r in done], _arrow())
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, now.row(), strict=True))], _arrow())

    n = partitions(formatted.sparkSession)
    ordered = formatted.repartition(n, conv_col).sortWithinPartitions(conv_col, turn_col, F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit("")))
    return ordered.select(F.col(conv_col).cast("long").alias("conv_id"), "rendered", "mask_start", "mask_end").mapInArrow(digest, DIGEST)


def _arrow() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(DIGEST)
