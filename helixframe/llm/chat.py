"""Chat formatting: a visitor flattens typed content parts into one string with ordered placeholders.

A turn becomes ``### role: content</turn>`` and a line feed. Inside roles and texts the characters that start a control
string (backslash, # and <) carry a backslash, in roles the colon too, so the format reads back exactly. Parts that are
not text become ``<kind:n>`` with n counting the turn's attachments; their references and expanded token counts are
kept beside the text. Null roles and texts count as empty. Turns of one conversation with equal numbers are ordered by role, then text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TURN = re.compile(r"### ((?:\\.|[^\\:])*+): ((?:\\.|[^\\<]|<(?:image|audio|document):\d+>)*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACE = re.compile(r"(?s)\\.|<(image|audio|document):(\d+)>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("#", "\\#")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Visitor:
    """Visits the typed parts of one turn in order. tokens_per gives the expanded tokens of a part that states none."""

    tokens_per: dict[str, int] = field(default_factory=lambda: {"image": 576, "audio": 750, "document": 1024})
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        handler = getattr(self, f"visit_{kind}", None) if kind in ("text", "image", "audio", "document") else None
        if handler is None:
            raise ValueError(f"unknown content part {kind!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"<{kind}:{len(self.attachments)}>")
        self.attachments.append((kind, part.get("ref") or "", tokens))

    def visit_image(self, part: dict) -> None:
        tiles = part.get("tiles")
        self.attach("image", part, self.tokens_per["image"] * (tiles if tiles else 1))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self.attach("audio", part, self.tokens_per["audio"] if seconds is None else -(-int(seconds * 25) // 1))

    def visit_document(self, part: dict) -> None:
        pages = part.get("pages")
        self.attach("document", part, self.tokens_per["document"] * (pages if pages else 1))


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[tuple[str, str, int]]]:
    """(formatted turn, start and end of its loss mask in code points, attachments); only assistants bear loss."""
    visitor = Visitor()
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.pieces)
    head = f"### {escape(role or '').replace(':', chr(92) + ':')}: "
    start = len(head) if role == "assistant" else 0
    return f"{head}{body}</turn>\n", start, start + len(body) if role == "assistant" else 0, visitor.attachments


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text with placeholders) of each turn."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per turn: conversation, turn, formatted, loss_start, loss_end, attachments. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [format_turn(r, [{"type": "text", "text": t}]) for r, t in zip(batch["role"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["formatted", "loss_start", "loss_end", "attachments"])
            out["attachments"] = [[{"kind": a, "ref": b, "tokens": c} for a, b, c in x] for x in out["attachments"]]
            out.insert(0, "turn", batch["turn"].array)
            out.insert(0, "conv_id", batch["conv_id"].array)
            yield out

    picked = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), "role", "text")
    return picked.mapInPandas(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<kind string, ref string, tokens long>>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back, in order, one at a time: however long a conversation is, only its running digests are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, have, done = None, False, []
        n = chars = loss = 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for conv, text, a, b in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if not have or conv != now:
                    if have:
                        done.append((now, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    now, have, n, chars, loss = conv, True, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                for role, said in read_back(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                under = unescape(text[int(a) : int(b)])
                loss += len(under)
                masked.update(under.encode())
                chars += len(text)
            if done:
                yield frame(done)
                done = []
        if have:
            yield frame([(now, n, turns.hexdigest(), loss, masked.hexdigest(), chars)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out["conv_id"] = pd.array(out["conv_id"].tolist(), dtype="Int64")
        return out

    ordered = formatted.drop("attachments").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
