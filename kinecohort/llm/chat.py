"""Chat formatting with loss masks that follow from character offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import held, pick
from kinecohort.llm.tokens import BYTE_BPE

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A turn is OPEN role TEXT text CLOSE, and a line end. The marks are tokens of their own, so no token crosses them.
OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
_CONTROLS = r"turn>|text>|/turn>|\|endoftext\|>"
_PLAIN = re.compile(rf"<(\\*)({_CONTROLS})")
_ESCAPED = re.compile(rf"<\\(\\*)({_CONTROLS})")
#: Characters after which a conversation goes on in another segment, at the next turn.
SEGMENT = 1 << 20
#: Characters that are encoded at once.
BATCH = 1 << 20

ROWS = (
    "conv_id {kind}, segment int, n_turns int, formatted string, input_ids array<int>, token_starts array<int>, "
    "token_ends array<int>, loss_mask array<boolean>"
)


def escape(text: str) -> str:
    """Control strings, and those escaped before, get one more backslash after their first character."""
    return _PLAIN.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2", text)


def render(turns: list[tuple[str, str]], role: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the characters from and to which the texts of a role stand."""
    parts, spans, at = [], [], 0
    for who, text in turns:
        head, body = f"{OPEN}{escape(who)}{TEXT}", escape(text)
        if who == role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{CLOSE}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def intersect(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens share characters with a span; both in order, found by binary search."""
    mask = np.zeros(len(starts) + 1, np.int64)
    if spans:
        a, b = np.array(spans).T
        full = a < b
        np.add.at(mask, np.searchsorted(ends, a[full], side="right"), 1)
        np.add.at(mask, np.searchsorted(starts, b[full], side="left"), -1)
    return np.cumsum(mask)[:-1] > 0


def _tokenizer(path: str):
    def build():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([OPEN, TEXT, CLOSE])
        return tokenizer

    return held(("chat", path), build)


def format_conversations(conversations: DataFrame, role: str = "assistant", path: str = BYTE_BPE) -> DataFrame:
    """Each conversation formatted and encoded: a row per segment with the text, the token ids, where each token
    starts and ends in the text, and whether it counts for the loss, i.e. lies in a text of `role`.

    Turns go by number, then role, then text (null first); repeated rows are turns of their own. A null role or text
    counts as empty. Rows of null conv_id are one conversation. An empty table gives an empty one. Roles and texts are
    escaped, so that marks stand for turns only and everything can be read back.

    A conversation is one segment up to about SEGMENT characters; a longer one goes on in the next, cut between turns.
    Marks part tokens, so the tokens are those of the whole conversation, and a task holds a segment and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        ready: list[tuple[object, int, list[tuple[str, str]]]] = []
        waiting = 0

        def encoded() -> pa.RecordBatch:
            rendered = [render(turns, role) for _, _, turns in ready]
            found = tokenizer.encode_batch([text for text, _ in rendered], add_special_tokens=False)
            columns: list[list] = [[] for _ in range(8)]
            for (conv, segment, turns), (text, spans), e in zip(ready, rendered, found):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                mask = intersect(spans, offsets[:, 0], offsets[:, 1])
                row = (conv, segment, len(turns), text, np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1], mask)
                for c, v in zip(columns, row):
                    c.append(v)
            kinds = (None, pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
            arrays = [pa.array(c, k or ids) for c, k in zip(columns, kinds)]
            names = "conv_id segment n_turns formatted input_ids token_starts token_ends loss_mask".split()
            return pa.record_batch(arrays, names)

        current, turns, size, segment, open_ = None, [], 0, 0, False
        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, who, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ and (conv != current or size >= SEGMENT):
                    ready.append((current, segment, turns))
                    waiting += size
                    turns, size, segment = [], 0, segment + 1
                    if waiting >= BATCH:
                        yield encoded()
                        ready, waiting = [], 0
                if not open_ or conv != current:
                    current, segment, open_ = conv, 0, True
                turns.append((who or "", text or ""))
                size += len(who or "") + len(text or "")
        if open_:
            ready.append((current, segment, turns))
            yield encoded()

    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = pick(conversations, "conv_id", "turn", "role", "text").repartition("conv_id")
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, ROWS.format(kind=kind))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back."""
    turns, at = [], 0
    while at < len(formatted):
        middle = formatted.index(TEXT, at)
        end = formatted.index(CLOSE, middle)
        turns.append((unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(TEXT) : end])))
        at = end + len(CLOSE) + 1
    return turns


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under each run of masked tokens, as it was before escaping."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in runs]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from the output of format_conversations, as it comes (not reordered).

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (the text
    under the loss mask), formatted_chars and n_tokens.
    """
    names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_tokens n_loss_tokens".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None
        ids = None

        def finished(s: dict) -> tuple:
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["tokens"], s["under"])

        def out() -> pa.RecordBatch:
            kinds = (ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                conv = row["conv_id"].as_py()
                if row["segment"].as_py() == 0:
                    if state:
                        done.append(finished(state))
                    if len(done) >= 1000:
                        yield out()
                        done = []
                    empty = dict(n=0, chars=0, all=0, tokens=0, under=0)
                    state = dict(conv=conv, turns=hashlib.sha256(), loss=hashlib.sha256(), **empty)
                text = row["formatted"].as_py()
                starts, ends = (row[c].values.to_numpy() for c in ("token_starts", "token_ends"))
                mask = row["loss_mask"].values.to_numpy(zero_copy_only=False)
                for who, said in parse(text):
                    state["turns"].update(f"{who}\n{said}\n".encode())
                    state["n"] += 1
                for under in masked_texts(text, starts, ends, mask):
                    state["loss"].update(under.encode())
                    state["chars"] += len(under)
                state["all"] += len(text)
                state["tokens"] += len(starts)
                state["under"] += int(mask.sum())
        if state:
            done.append(finished(state))
            yield out()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    longs = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return formatted.mapInArrow(run, f"conv_id {kind}, {longs}")
