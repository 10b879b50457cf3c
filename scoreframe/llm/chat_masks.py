"""Conversations as token ids with a loss mask that covers the assistant's texts and nothing else.

A conversation is rendered whole, turn after turn between the markers of its role, and encoded once. The
tokens' byte offsets are the running sums of their lengths, and the sorted spans of the turns meet them by binary
search. Markers are ids of their own behind the vocabulary, so no token lies across the edge of a turn. Where a text
itself holds a marker, a backslash goes behind the marker's first character (one more if some stand there
already), which reading back removes.

At scale: one shuffle by conversation and ``TURNS`` numbers of turns, so a conversation of any length is dealt over
tasks; a task streams through its rows and hands on a row per ``CHUNK`` characters, cut between turns, where
markers make the ids the same as those of the whole. Reading back shuffles the rows once more; it holds one row and a running
digest per conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import stored
from scoreframe.llm.tokens import TextTokenizer, default_tokenizer, tokenizer

# What opens and closes the text of a turn, by role. Any other role is written out.
TURN = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, ROLE_END, TURN_END = "[ROLE]", "[/ROLE]", "[/TURN]"
MARKERS = (*(m for pair in TURN.values() for m in pair), ROLE, ROLE_END, TURN_END)
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|/TURN\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|/TURN\])")
LOSS = ("assistant",)
#: Turn numbers that go to one task, and characters of a row.
TURNS, CHUNK = 1024, 1 << 18


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the byte span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        opening, closing = TURN.get(role) or (ROLE + escape(role) + ROLE_END, TURN_END)
        text = escape(text)
        start = at + len(opening.encode())
        spans.append((start, start + len(text.encode())))
        parts += [opening, text, closing]
        at = spans[-1][1] + len(closing)
    return "".join(parts), spans


def token_spans(tok: TextTokenizer, ids: np.ndarray) -> np.ndarray:
    """Byte offsets of the tokens' edges: token k spans ``out[k]`` to ``out[k + 1]``."""
    return np.concatenate([[0], np.cumsum([len(tok.bytes_of[k]) for k in ids.tolist()], dtype=np.int64)])


def intersect(edges: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """First token and end token of each span: those that share a byte with it."""
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(edges[1:], bounds[:, 0], "right")
    end = np.searchsorted(edges[:-1], bounds[:, 1], "left")
    return np.stack([first, np.maximum(first, end)], axis=1)


def encode(tok: TextTokenizer, turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = LOSS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Ids, mask bit per token, and the tokens of each turn's text."""
    text, spans = render(turns)
    data = tok.encode(text)
    edges = token_spans(tok, np.frombuffer(data, "<u4"))
    tokens = intersect(edges, spans)
    change = np.zeros(len(edges), np.int64)
    for (a, b), (role, _) in zip(tokens.tolist(), turns, strict=True):
        if role in loss_roles:
            change[a] += 1
            change[b] -= 1
    return data, np.cumsum(change)[:-1] > 0, tokens


def format_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    tokenizer_path: str | None = None, loss_roles: tuple[str, ...] = LOSS,
) -> DataFrame:
    """``conv_id, block, part, ids, loss, turns``: rows in the order of ``block`` (null first) and ``part`` make a conversation.

    ``ids`` are unsigned 32-bit, ``loss`` has a bit per token (most significant first), ``turns`` the role and the tokens of each
    turn's text. Turns are ordered by number, null first, then role and text; repeated rows are turns of their own. Null roles
    and texts are empty, null ids are one conversation. Empty texts have no tokens and no loss. An empty table gives an
    empty result. Other columns are not read.
    """
    path = tokenizer_path or default_tokenizer()
    rows = conversations.select(
        conversations[conv_col].alias("conv_id"), conversations[turn_col].cast("long").alias("turn"),
        *[F.coalesce(conversations[c].cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    ).withColumn("block", F.floor(F.col("turn") / TURNS))
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, MARKERS)
        now, part, turns, size = None, 0, [], 0

        def row() -> dict:
            data, loss, tokens = encode(tok, turns, loss_roles)
            spans = [{"role": r, "first": a, "end": b} for (r, _), (a, b) in zip(turns, tokens.tolist(), strict=True)]
            return {"conv_id": now[0], "block": now[1], "part": part, "ids": data, "loss": np.packbits(loss).tobytes(), "turns": spans}

        for batch in batches:
            out = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text")), strict=True):
                if turns and (key[:2] != now or size >= CHUNK):
                    out.append(row())
                    part = part + 1 if key[:2] == now else 0
                    turns, size = [], 0
                now = key[:2]
                turns.append(key[2:])
                size += len(key[3])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema(batch))
        if turns:
            yield pa.RecordBatch.from_pylist([row()], schema(batch))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        span = pa.struct([("role", pa.string()), ("first", pa.int32()), ("end", pa.int32())])
        head = [(c, batch.schema.field(c).type) for c in ("conv_id", "block")]
        return pa.schema([*head, ("part", pa.int32()), ("ids", pa.binary()), ("loss", pa.binary()), ("turns", pa.list_(span))])

    spans = "turns array<struct<role string, first int, end int>>"
    found = dealt.select("conv_id", "block", "role", "text").mapInArrow(run, f"conv_id {kind}, block long, part int, ids binary, loss binary, {spans}")
    return stored(found, "formatted")


def parse(tok: TextTokenizer, ids: np.ndarray) -> list[tuple[str, str]]:
    """The turns that ids were made from. Ids that no rendering gives raise."""
    data = b"".join([tok.bytes_of[k] for k in ids.tolist()])
    edges, at = token_spans(tok, ids), np.flatnonzero(ids >= tok.first_marker)
    names = [MARKERS[k - tok.first_marker] for k in ids[at].tolist()]
    texts = [unescape(data[a:b].decode()) for a, b in zip(edges[at + 1], edges[np.append(at, len(ids))[1:]], strict=True)]
    opens, turns, k = {o: (role, c) for role, (o, c) in TURN.items()}, [], 0
    while k < len(names):
        if names[k] in opens:
            role, closing = opens[names[k]]
        elif names[k : k + 2] == [ROLE, ROLE_END]:
            role, closing, k = texts[k], TURN_END, k + 1
        else:
            raise ValueError(f"{names[k]} opens no turn")
        if names[k + 1 : k + 2] != [closing] or texts[k + 1]:
            raise ValueError(f"a turn of {role!r} isn't closed")
        turns.append((role, texts[k]))
        k += 2
    if len(at) and at[0] or not len(at) and len(ids):
        raise ValueError("text in front of the first turn")
    return turns


def masked_texts(tok: TextTokenizer, ids: np.ndarray, loss: np.ndarray) -> list[str]:
    """The text under each run of the mask."""
    edges = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
    return [unescape(b"".join([tok.bytes_of[k] for k in ids[a:b].tolist()]).decode()) for a, b in edges.reshape(-1, 2).tolist()]


def read_back(formatted: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Per conversation, from the ids and masks alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    path = tokenizer_path or default_tokenizer()
    kind = formatted.schema["conv_id"].dataType.simpleString()
    dealt = formatted.select("conv_id", "block", "part", "ids", "loss")
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, now, started = tokenizer(path, MARKERS), None, False
        n = chars = formatted_chars = 0
        turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()

        def row() -> tuple:
            return now, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted_chars

        def batch_of(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [like.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for conv, data, bits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "loss")), strict=True):
                if started and conv != now:
                    out.append(row())
                    n = chars = formatted_chars = 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                now, started = conv, True
                ids = np.frombuffer(data, "<u4")
                for role, text in parse(tok, ids):
                    turns_hash.update(f"{role}\n{text}\n".encode())
                    n += 1
                loss = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids))
                for text in masked_texts(tok, ids, loss):
                    loss_hash.update(text.encode())
                    chars += len(text)
                formatted_chars += len(b"".join([tok.bytes_of[k] for k in ids.tolist()]).decode())
            if out:
                yield batch_of(out, batch)
        if started:
            yield batch_of([row()], batch)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "ids", "loss").mapInArrow(run, schema)
