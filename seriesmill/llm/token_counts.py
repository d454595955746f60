"""Edit-aware token counts.

A document is cut into segments at places that no word of the tokenizer spans: before a
single space between two letters or digits of any script, and behind a full-width mark
that a letter or digit follows, where scripts do without spaces. A segment tree holds the characters and tokens
below each node. An edit finds its segments by going down the tree, re-encodes them with
as many neighbours as the cuts need to stay such places, and updates the sums above.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenizing import vocabulary_path

VOCABULARY, SEGMENT = "byte_bpe_50k.tiktoken", 512
# Marks of scripts without spaces.
MARKS = "、。，．・：；？！…（）「」『』《》【】"
_CUT = re.compile(rf"(?<=[^\W_]) (?=[^\W_])|(?<=[{MARKS}])(?=[^\W_])")
_JOINT = re.compile(rf"[^\W_] [^\W_]|[{MARKS}][^\W_]")
_encodings: dict = {}


def encoding(name: str = VOCABULARY):
    """This process's tiktoken encoding; control strings are ordinary text."""
    if name not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(name if "/" in name else vocabulary_path(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[name] = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text in pieces of about ``size`` characters; longer where no cut is allowed."""
    out, at = [], 0
    while True:
        cut = _CUT.search(text, at + size) if len(text) - at > size else None
        if cut is None:
            out.append(text[at:])
            return out
        out.append(text[at : cut.start()])
        at = cut.start()


def parted(left: str, right: str) -> bool:
    """Whether a cut is allowed between two texts that aren't empty."""
    return _JOINT.match(left[-1] + right[:2]) is not None


class TokenTree:
    """Token counts of one text under edits. ``count(texts)`` gives a list of counts."""

    def __init__(self, text: str, count, size: int = SEGMENT):
        self.count, self.size, self.recoded = count, size, 0
        self._build(segments(text, size))

    @classmethod
    def restored(cls, text: str, chars, tokens, count, size: int = SEGMENT) -> "TokenTree":
        """The tree of ``text`` from its leaves' characters and tokens, encoding nothing."""
        tree = cls.__new__(cls)
        tree.count, tree.size, tree.recoded = count, size, 0
        ends = [0]
        for n in chars:
            ends.append(ends[-1] + int(n))
        if ends[-1] != len(text) or len(chars) != len(tokens):
            raise ValueError("the segments are not of this text")
        tree._build([text[a:b] for a, b in zip(ends, ends[1:])] or [""], [int(t) for t in tokens] or [0])
        return tree

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the segments, for ``restored``."""
        n = self.base + len(self.pieces)
        return self.chars[self.base : n], self.tokens[self.base : n]

    def _build(self, pieces: list[str], tokens: list[int] | None = None) -> None:
        self.pieces = pieces
        self.base = 1 << max(0, (len(pieces) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base : self.base + len(pieces)] = map(len, pieces)
        self.tokens[self.base : self.base + len(pieces)] = tokens if tokens is not None else self.count(pieces)
        for k in range(self.base - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.pieces)

    def _find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at`` (the last one at the end), and where
        it starts."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.base, start

    def _set(self, leaf: int, piece: str, tokens: int) -> None:
        self.pieces[leaf] = piece
        k = leaf + self.base
        self.chars[k], self.tokens[k] = len(piece), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next segment that isn't empty, to the left (-1) or right (1)."""
        leaf += step
        while 0 <= leaf < len(self.pieces):
            if self.pieces[leaf]:
                return leaf
            leaf += step
        return None

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` for the characters [start, end), both cut to the text's ends.
        Returns the number of characters that were encoded again."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, at = self._find(start)
        last, last_at = self._find(max(end - 1, start)) if end > start else (first, at)
        local = "".join(self.pieces[first : last + 1])
        local = local[: start - at] + new + local[end - at :]
        while (left := self._beside(first, -1)) is not None and not (local and parted(self.pieces[left], local)):
            local, first = self.pieces[left] + local, left
        while (right := self._beside(last, 1)) is not None and not (local and parted(local, self.pieces[right])):
            local, last = local + self.pieces[right], right
        self.recoded += len(local)
        pieces = segments(local, self.size)
        counts = self.count(pieces)
        if len(pieces) <= last - first + 1:
            for k in range(last - first + 1):
                has = k < len(pieces)
                self._set(first + k, pieces[k] if has else "", counts[k] if has else 0)
        else:  # more segments than there were: the tree is laid out anew, without encoding
            tokens = self.tokens[self.base : self.base + len(self.pieces)]
            self._build(self.pieces[:first] + pieces + self.pieces[last + 1 :], tokens[:first] + counts + tokens[last + 1 :])
        return len(local)


_lengths: dict = {}


def _counter(name: str):
    """Counts of the pieces of one text, encoded in one go: their ends are ends of tokens."""
    encode = encoding(name).encode_ordinary
    if name not in _lengths:
        _lengths[name] = np.array([len(t) for t in _token_values(name)], np.int64)
    lengths = _lengths[name]

    def count(pieces: list[str]) -> list[int]:
        if len(pieces) == 1:
            return [len(encode(pieces[0]))]
        ends = np.cumsum(lengths[encode("".join(pieces))])
        bounds = np.cumsum([len(p.encode()) for p in pieces])
        return np.diff(np.searchsorted(ends, bounds, "right"), prepend=0).tolist()

    return count


def _token_values(name: str) -> list[bytes]:
    known = encoding(name)
    return [known.decode_single_token_bytes(k) for k in range(known.n_vocab)]


EDIT = "array<struct<start:long,end:long,new:string>>"
COUNTS = "doc_id long, n_chars long, n_segments long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, recoded_chars long, segment_tokens array<int>"


def _count(name: str):
    def run(batches):
        count = _counter(name)
        for pdf in batches:
            rows = []
            for doc_id, text, edits in zip(pdf["doc_id"], pdf["text"], pdf["edits"]):
                tree = TokenTree(text or "", count)
                before = (doc_id, tree.length, len(tree.pieces), tree.total)
                edits = [] if edits is None else edits
                for e in edits:
                    tree.replace(int(e["start"]), int(e["end"]), e["new"] or "")
                rows.append((*before, len(edits), tree.length, tree.total, tree.recoded, tree.leaves()[1]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def count_tokens(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of every row of ``docs`` (doc_id, text), before and after ``edits``.

    ``edits`` is a column of (start, end, new): characters [start, end) of the text as
    the earlier edits left it become ``new``; places beyond the text are its end. Null
    texts are empty, null edits none, a null ``new`` deletes. Repeated rows are counted
    each. segment_tokens are the counts of the tree's leaves after the edits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.cast(EDIT).alias("edits"))
    return rows.mapInPandas(_count(vocabulary), COUNTS)


TREES = "doc_id long, text string, segment_chars array<int>, segment_tokens array<int>, n_tokens long, recoded_chars long"


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, segment_chars, segment_tokens, n_tokens, recoded_chars: the tree of
    every row of ``docs`` (doc_id, text), to be stored and kept up to date."""
    none = F.lit(None).cast("array<int>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.alias("segment_chars"), none.alias("segment_tokens"), F.lit(None).cast(EDIT).alias("edits"))
    return rows.mapInPandas(_trees(vocabulary), TREES)


def recount(trees: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """``trees`` after ``edits`` (a column as for ``count_tokens``): new texts and counts,
    with ``recoded_chars`` the characters that had to be encoded."""
    rows = trees.select("doc_id", "text", "segment_chars", "segment_tokens", edits.cast(EDIT).alias("edits"))
    return rows.mapInPandas(_trees(vocabulary), TREES)


def _trees(name: str):
    def run(batches):
        count = _counter(name)
        for pdf in batches:
            rows = []
            for doc_id, text, chars, tokens, edits in pdf.itertuples(index=False):
                tree = TokenTree(text or "", count) if chars is None else TokenTree.restored(text or "", chars, tokens, count)
                recoded = tree.length if chars is None else 0
                for e in [] if edits is None else edits:
                    tree.replace(int(e["start"]), int(e["end"]), e["new"] or "")
                rows.append((doc_id, tree.text(), *tree.leaves(), tree.total, recoded + tree.recoded))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in TREES.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def standard_edits(text: Column) -> Column:
    """Three edits whose places follow from the text's length: a redaction at a quarter,
    an insertion at the middle, a deletion at three quarters."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")

    def edit(part: float, size: int, new: str) -> Column:
        start = F.floor(n * part).cast("long")
        return F.struct(start.alias("start"), (start + size).alias("end"), F.lit(new).alias("new"))

    return F.array(edit(0.25, 10, "[redacted]"), edit(0.5, 0, " (see note) "), edit(0.75, 20, ""))
