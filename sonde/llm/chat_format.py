"""Chat formatting by a grammar whose output is parsed back.

    conversation = { turn }
    turn         = "<|im_start|>" role newline text "<|im_end|>" newline

A turn is rendered with its text as it is, parsed by the deterministic parser of that
grammar, and compared with its source; on any difference the next level of escaping is
tried, until both are identical. Level 1 puts a backslash into control strings and into what
reads like an escape already (``<|`` with backslashes inside), level 2 into every ``<|``; the
parser takes one backslash out of each. Roles escape backslashes, newlines and ``<|`` always.

Conversations stream: rows are shuffled by conversation and sorted by turn, and each turn
leaves as a segment with its place in the formatted text and its span of the loss mask, so
memory is that of one batch however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_READS_ESCAPED = re.compile(r"<(\\+)\|")
_CONTROL = re.compile(r"<(\\*)\|(?=im_start\|>|im_end\|>)|<(\\+)\|")
_ANY = re.compile(r"<(\\*)\|")

LEVELS: tuple[Callable[[str], str], ...] = (
    lambda text: text,
    lambda text: _CONTROL.sub(lambda m: f"<\\{m[1] or m[2] or ''}|", text),
    lambda text: _ANY.sub(lambda m: f"<\\{m[1]}|", text),
)


class GrammarError(ValueError):
    """The text is not a sentence of the grammar."""


def unescape(text: str) -> str:
    return _READS_ESCAPED.sub(lambda m: f"<{m[1][1:]}|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role, flags=re.S)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start of the raw text, its end) of each turn from ``at`` to the end; GrammarError where it does not fit."""
    while at < len(text):
        line = text.find("\n", at)
        if not text.startswith(START, at) or line < 0:
            raise GrammarError(f"no turn begins at {at}")
        end = text.find(END, line + 1)
        if end < 0 or not text.startswith("\n", end + len(END)):
            raise GrammarError(f"the turn at {at} has no end")
        raw = text[line + 1 : end]
        if START in raw:
            raise GrammarError(f"a turn begins inside the turn at {at}")
        yield unescape_role(text[at + len(START) : line]), unescape(raw), line + 1, end
        at = end + len(END) + 1


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the text in it), which parses back to exactly (role, text)."""
    for level in LEVELS:
        segment = f"{START}{escape_role(role)}\n{level(text)}{END}\n"
        try:
            turns = list(parse(segment))
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return segment, turns[0][2], turns[0][3]
    raise GrammarError("no level of escaping is reversible")  # level 2 always is


def _segments(key: str, learn: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, position, place = object(), 0, 0
        for pdf in batches:
            out = []
            for conv, role, text in zip(pdf[key].astype(object), pdf["role"], pdf["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current:
                    current, position, place = conv, 0, 0
                segment, lo, hi = render_turn(role, text)
                mine = role == learn
                out.append((conv, position, segment, place, place + lo if mine else None, place + hi if mine else None))
                position, place = position + 1, place + len(segment)
            frame = pd.DataFrame(out, columns=[key, "position", "segment", "seg_start", "loss_start", "loss_end"])
            yield frame.astype({key: "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return run


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per turn, conversations together and in order: conv_id, position (from 0),
    segment, seg_start, and for turns of the role ``learn`` the span [loss_start, loss_end) of
    the loss mask. A conversation's formatted text is its segments joined; places count
    code points of it.

    Null roles and texts are empty. Turns go by ``turn``, nulls first; ties by role and text;
    repeated rows are turns of their own. Rows of a null conv_id are one conversation.
    Other columns are ignored; an empty table gives no rows.
    """
    clean = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    together = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, position long, segment string, seg_start long, loss_start long, loss_end long"
    return together.select("conv_id", "role", "text").mapInPandas(_segments("conv_id", learn), schema)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What the output of ``format_conversations`` says, read back by the parser: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Rows must still be in
    the order that function gives; hashes are fed turn by turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def result() -> tuple:
            return conv, state["turns"], state["all"].hexdigest(), state["loss"], state["mask"].hexdigest(), state["chars"]

        for pdf in batches:
            out = []
            for key, position, segment, place, lo, hi in pdf.itertuples(index=False, name=None):
                if position == 0:
                    if state:
                        out.append(result())
                    conv = None if pd.isna(key) else int(key)
                    state = {"turns": 0, "loss": 0, "chars": 0, "all": hashlib.sha256(), "mask": hashlib.sha256()}
                for role, text, _, _ in parse(segment):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                if not pd.isna(lo):
                    learnt = unescape(segment[int(lo) - place : int(hi) - place])
                    state["loss"] += len(learnt)
                    state["mask"].update(learnt.encode())
                state["chars"] += len(segment)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state:
            yield pd.DataFrame([result()], columns=names).astype({"conv_id": "Int64"})

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
