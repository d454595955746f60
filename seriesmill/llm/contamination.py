"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole texts. Its words become symbols of the benchmark's
vocabulary (0: any other word). Only runs of symbols at least as long as the shortest
window can hold one, so only they are indexed; each ends in a separator. The index is
the Burrows-Wheeler transform of the symbols in a wavelet matrix; all windows of the
benchmark search backwards together, occurrences are located by sampled suffix
positions, and the words that they cover merge into removal spans.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, U64, WordScanner, stored, text_chunks, tidy

SHARD_BYTES = 1 << 20
SAMPLE = 8


# --- the index -----------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling of ranked prefixes. Each 0 is a symbol of its
    own, lower the earlier it stands, so no comparison runs past a separator."""
    n = len(s)
    zeros = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class WaveletMatrix:
    """Rank of any symbol at any place, in one step a bit."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (s >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at`` (arrays)."""
        start = np.zeros_like(at)
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            one, ones, zeros = (symbol >> k) & 1 == 1, self.ones[level], self.zeros[level]
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start


class FMIndex:
    def __init__(self, s: np.ndarray, symbols: int):
        n = len(s)
        order = suffix_array(s)
        self.last = s[order - 1].astype(np.int64)
        self.tree = WaveletMatrix(self.last, max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        # a step back must not pass a separator: what follows one is sampled too
        kept = (order % SAMPLE == 0) | (self.last == 0)
        self.place = np.where(kept, order, -1)
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray):
        """[lo, hi) in suffix order of the suffixes that start with each pattern; rows
        of ``patterns`` are aligned to the right."""
        width = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(width - 1, -1, -1):
            on = np.flatnonzero((width - k <= lengths) & (lo < hi))
            if len(on) == 0:
                break
            c = patterns[on, k].astype(np.int64)
            ranks = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]]))
            lo[on] = self.first[c] + ranks[: len(on)]
            hi[on] = self.first[c] + ranks[len(on) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of rows in suffix order: steps back, symbol by symbol,
        to a sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        rows = rows.copy()
        on = np.arange(len(rows))
        while len(on):
            found = self.place[rows[on]] >= 0
            done = on[found]
            out[done] = self.place[rows[done]] + steps[done]
            on = on[~found]
            c = self.last[rows[on]]
            rows[on] = self.first[c] + self.tree.rank(c, rows[on])
            steps[on] += 1
        return out


# --- windows ---------------------------------------------------------------------------


@dataclass
class Windows:
    """The benchmark: its vocabulary and every distinct window with its items."""

    words: np.ndarray  # sorted hashes; a word's symbol is its place + 1
    patterns: np.ndarray  # (windows, width), aligned to the right
    lengths: np.ndarray
    start: np.ndarray  # window k has the items members[start[k] : start[k + 1]]
    members: np.ndarray  # indexes into names
    names: list[str]


def windows_of(items: list[tuple], width: int) -> Windows:
    scan = WordScanner(ALNUM)
    hashes = []
    for _, data, offsets in text_chunks(pa.array([t for _, t in items], pa.string())):
        row, _, _, h = scan(data, offsets)
        ends = np.searchsorted(row, np.arange(len(offsets)))
        hashes += [h[ends[k] : ends[k + 1]] for k in range(len(offsets) - 1)]
    words = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
    held: dict[bytes, set[int]] = {}
    names = sorted({str(i) for i, _ in items if i is not None})
    place = {x: k for k, x in enumerate(names)}
    for (item, _), h in zip(items, hashes):
        symbols = (np.searchsorted(words, h) + 1).astype(np.int64)
        size = min(width, len(symbols))
        for k in range(len(symbols) - size + 1 if size else 0):
            held.setdefault(symbols[k : k + size].tobytes(), set()).update(() if item is None else (place[str(item)],))
    patterns = np.zeros((len(held), width), np.int32)
    lengths = np.zeros(len(held), np.int64)
    for k, w in enumerate(held):
        symbols = np.frombuffer(w, np.int64)
        lengths[k] = len(symbols)
        patterns[k, width - len(symbols) :] = symbols
    start = np.concatenate([[0], np.cumsum([len(v) for v in held.values()])]).astype(np.int64)
    members = np.fromiter((i for v in held.values() for i in sorted(v)), np.int32, int(start[-1]))
    return Windows(words, patterns, lengths, start, members, names)


def _runs(symbols: np.ndarray, rows: np.ndarray, least: int):
    """Places of the words in runs of ``least`` benchmark words or more of one text, and
    where a run ends among them."""
    n = len(symbols)
    inside = symbols > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (rows[1:] != rows[:-1])
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (rows[1:] != rows[:-1])
    end = np.flatnonzero(last) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, end, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0), np.cumsum(end - start)


HITS = "uid long, doc_id long, n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def _search(found: Windows):
    """Hits of batches (uid, doc_id, text); columns after these are passed on."""

    def run(batches):
        scan = WordScanner(ALNUM)
        least = int(found.lengths.min()) if len(found.lengths) else 0
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column(2), SHARD_BYTES):
                rows, _, _, h = scan(data, offsets)
                count = np.bincount(rows, minlength=len(offsets) - 1)
                begin = np.concatenate([[0], np.cumsum(count)])
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                if least and len(h):
                    at = np.searchsorted(found.words, h)
                    at[at == len(found.words)] = 0
                    symbols = np.where(found.words[at] == h, at + 1, 0)
                    places, ends = _runs(symbols, rows, least)
                    if len(places):
                        _mark(found, symbols, places, ends, rows, begin, spans, items)
                n = len(count)
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": batch.column(0).slice(lo, n),
                        "doc_id": batch.column(1).slice(lo, n),
                        "n_words": pa.array(count, pa.int64()),
                        "spans": pa.array([spans.get(k, []) for k in range(n)], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                        "items": pa.array([sorted(found.names[i] for i in items.get(k, ())) for k in range(n)], pa.list_(pa.string())),
                        **{name: batch.column(k).slice(lo, n) for k, name in enumerate(batch.schema.names) if k > 2},
                    }
                )

    return run


def _mark(found, symbols, places, ends, rows, begin, spans, items) -> None:
    sequence = np.insert(symbols[places], ends, 0)
    origin = np.insert(places, ends, -1)
    index = FMIndex(sequence, len(found.words))
    lo, hi = index.search(found.patterns, found.lengths)
    hits = np.flatnonzero(hi > lo)
    if len(hits) == 0:
        return
    counts = hi[hits] - lo[hits]
    window = np.repeat(hits, counts)
    suffix = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[hits], counts)
    word = origin[index.locate(suffix)]
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + found.lengths[window], -1)
    covered = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    edge = np.concatenate([[-1], rows, [-1]])
    first = np.flatnonzero(covered[1:-1] & (~covered[:-2] | (edge[1:-1] != edge[:-2])))
    end = np.flatnonzero(covered[1:-1] & (~covered[2:] | (edge[1:-1] != edge[2:]))) + 1
    for a, b in zip(first.tolist(), end.tolist()):
        r = int(rows[a])
        spans.setdefault(r, []).append({"first": a - int(begin[r]), "end": b - int(begin[r])})
    for r, w in np.unique(np.stack([rows[word], window], axis=1), axis=0).tolist():
        items.setdefault(r, set()).update(found.members[found.start[w] : found.start[w + 1]].tolist())


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:int,end:int>>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, slice_chars: int = 1 << 22, unnamed: bool = False) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text), against ``benchmark`` (item_id,
    text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    spans are the merged removal spans, [first, end) in words of the text; items has the
    ids of the items with a window in the text, sorted as strings. A text is contaminated
    if its hit words are at least ``percent`` in a hundred of its words, and not none.
    Null and empty texts have no words and no hits; items with a null, empty or
    wordless text have no windows; items with a null item_id are left out, or with
    ``unnamed`` count in n_hit, spans and contaminated but not in items; repeated items and rows count each once. The benchmark is taken in slices
    of about ``slice_chars`` characters, one after the other, so what the driver and a task
    hold of it is bounded; a benchmark of several slices costs as many passes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = _sliced(benchmark, width, slice_chars, unnamed)
    if len(slices) > 1:
        docs = stored(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "numbered")
    else:
        docs = docs.select(F.lit(0).cast("long").alias("uid"), "doc_id", "text")
    out = _hits(docs, slices)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(percent).alias("contaminated"), "spans", "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, slice_chars: int = 1 << 22) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, with all their columns whatever
    their names: these travel in one column past the search. Ids play no part,
    neither of texts nor of items."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    none, text = F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    slices = _sliced(benchmark, width, slice_chars, True)
    if len(slices) == 1:
        rows = docs.select(F.lit(0).cast("long").alias("uid"), none, text, row)
        return _hits(rows, slices).where(~_contaminated(percent)).select("row.*")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("uid"), row), "numbered")
    found = _hits(rows.select("uid", none, F.col("row.text").cast("string").alias("text")), slices)
    bad = stored(found.where(_contaminated(percent)).select("uid"), "contaminated")
    return rows.join(bad, "uid", "left_anti").select("row.*")


def _contaminated(percent: int):
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def _sliced(benchmark: DataFrame, width: int, slice_chars: int, unnamed: bool) -> list:
    """Functions that give the windows of each slice, one slice at a time."""
    items = benchmark.where(F.col("text").isNotNull() & (F.lit(unnamed) | F.col("item_id").isNotNull())).select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / slice_chars))

    place = F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id"))

    def windows(k):
        own = items.where(F.pmod(place, F.lit(n)) == k).collect()  # at most about slice_chars
        return windows_of([(r.item_id, r.text) for r in own], width)

    return [functools.partial(windows, k) for k in range(n)]


def _hits(docs: DataFrame, slices: list) -> DataFrame:
    """``docs`` (uid, doc_id, text; with one slice, further columns are passed on) ->
    HITS and n_hit, one row a uid if there are several slices."""
    schema = T.StructType([*T.StructType.fromDDL(HITS).fields, *docs.schema.fields[3:]])
    parts = None
    for windows in slices:
        part = docs.mapInArrow(tidy(_search(windows())), schema)
        if len(slices) > 1:  # written now, so that the plan holds the windows of one slice alone
            part = stored(part, "hits")
        parts = part if parts is None else parts.union(part)
    if len(slices) > 1:
        parts = parts.groupBy("uid", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        parts = parts.withColumns({"spans": _merged(F.col("spans")), "items": F.array_sort(F.array_distinct("items"))})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]).cast("long"))
    return parts.withColumn("n_hit", hit)


def _merged(spans):
    """Spans of several slices as one list without overlap."""
    empty = F.expr("cast(array() as array<struct<first:int,end:int>>)")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] >= s["first"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def digest(contamination: DataFrame) -> DataFrame:
    """With the spans as text: ``first-end`` of each, comma-joined."""
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",")
    return contamination.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", told.alias("spans"))


def _cut(batches):
    scan = WordScanner(ALNUM)
    for batch in batches:
        texts, out = batch.column(0), []
        spans = batch.column(1).to_pylist()
        for lo, data, offsets in text_chunks(texts):
            row, start, end, _ = scan(data, offsets)
            begin = np.searchsorted(row, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                keep, at = [], int(offsets[r])
                for s in spans[lo + r] or []:
                    keep.append(data[at : start[begin[r] + s["first"]]].tobytes())
                    at = int(end[begin[r] + s["end"] - 1])
                keep.append(data[at : offsets[r + 1]].tobytes())
                out.append(b"".join(keep).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def remove_spans(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``rows`` with the words of ``spans`` (as ``find_contamination`` gives them for the
    same text) cut out of ``text``, from a span's first letter to its last. A null text
    becomes empty; null spans cut nothing."""
    others = [c for c in rows.columns if c not in (text, spans)]
    kept = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    packed = rows.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{spans}`").alias("spans"), *([kept] if others else []))
    schema = T.StructType([packed.schema["text"], *([packed.schema["row"]] if others else [])])
    cut = packed.mapInArrow(_cut, schema)
    return cut.select(F.col("text").alias(text), *[F.col(f"row.`{c}`").alias(c) for c in others])
