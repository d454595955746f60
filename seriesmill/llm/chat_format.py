"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of
its turns are intersected with the token spans by binary search. Marks are control
tokens of their own, so a turn's text starts and ends with a token.

    <|turn|>role<|text|>text<|end|>

Inside roles and texts every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) gets a backslash after its first character, and one that has backslashes
there already gets one more; taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokenizing import load

VOCABULARY = "byte_bpe_50k.json"
TURN, TEXT, END = CONTROLS = ("<|turn|>", "<|text|>", "<|end|>")
_TAIL = r"(\||/?s>|/?INST\])"
_PLAIN = re.compile(r"([<\[])(\\*)" + _TAIL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _TAIL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns) -> tuple[str, np.ndarray]:
    """The conversation's string, and the (start, end) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        role, text = escape(role), escape(text)
        at += len(TURN) + len(role) + len(TEXT)
        spans.append((at, at + len(text)))
        at += len(text) + len(END)
        parts += [TURN, role, TEXT, text, END]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def token_spans(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """[first, end) of the tokens that meet each span; both sides are sorted."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    end = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    return np.stack([first, np.maximum(first, end)], axis=1)


def _byte_values() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 characters stand
    for themselves, the other bytes for code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


_bytes: dict = {}


def _token_bytes(name: str) -> list[bytes]:
    if name not in _bytes:
        value = _byte_values()
        vocabulary = load(name, CONTROLS).get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            table[k] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        _bytes[name] = table
    return _bytes[name]


FORMATTED = "conv_id long, input_ids array<int>, loss_first array<int>, loss_end array<int>, formatted_chars long"


def _format(name: str, learn: frozenset[str]):
    def run(batches):
        tokenizer = load(name, CONTROLS)
        for pdf in batches:
            for k in range(0, len(pdf), 64):
                rows = []
                part = pdf.iloc[k : k + 64]
                turns = [[(t["role"], t["text"]) for t in ts] for ts in part["turns"]]
                drawn = [render(t) for t in turns]
                encoded = tokenizer.encode_batch([d[0] for d in drawn], add_special_tokens=False)
                for conv_id, ts, (text, spans), e in zip(part["conv_id"], turns, drawn, encoded):
                    at = token_spans(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
                    loss = at[[r in learn for r, _ in ts]] if ts else at
                    rows.append((conv_id, e.ids, loss[:, 0].tolist(), loss[:, 1].tolist(), len(text)))
                out = pd.DataFrame(rows, columns=["conv_id", "input_ids", "loss_first", "loss_end", "formatted_chars"])
                yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    return run


def format_conversations(turns: DataFrame, vocabulary: str = VOCABULARY, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, input_ids, loss_first, loss_end, formatted_chars): one row for each
    conversation in ``turns`` (conv_id, turn, role, text).

    The loss mask is the tokens [loss_first[k], loss_end[k]) of each turn whose role is
    in ``learn``, in order. Rows go by turn, null turns first; ties by role, then text,
    so that repeated rows and ties have one order. Null roles and texts are empty. Rows
    without a conv_id make one conversation whose id is null. A conversation is a value
    of one row, so it is the unit of work.
    """
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return whole.mapInPandas(_format(vocabulary, frozenset(learn)), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(name: str):
    def run(batches):
        table = _token_bytes(name)
        for pdf in batches:
            rows = []
            for conv_id, ids, first, end in zip(pdf["conv_id"], pdf["input_ids"], pdf["loss_first"], pdf["loss_end"]):
                parts = [table[i] for i in ids]
                text = b"".join(parts).decode()
                turns = [t.split(TEXT) for t in text.split(TURN)[1:]]
                turns = [(unescape(role), unescape(body[: -len(END)])) for role, body in turns]
                loss = "".join(unescape(b"".join(parts[a:b]).decode()) for a, b in zip(first, end))
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    return run


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the token ids and masks alone say: the turns, and the text under the mask."""
    return formatted.mapInPandas(_read(vocabulary), DIGEST)


def stored_conversations(turns: DataFrame, **options) -> DataFrame:
    return stored(format_conversations(turns, **options), "conversations")
