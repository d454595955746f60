"""N-gram Jaccard join with signature trees, and the classes it links.

Each text becomes its set of distinct five-word shingles (64-bit hashes). Texts with
equal sets collapse into one representative first, so exact copies never meet in a
join. Representatives are routed to blocks, and inside every block a signature tree
does the join: nodes hold OR-combined token bitmaps and size ranges, a dual traversal
drops each pair of nodes whose maximum possible overlap is too small, and what is left
is verified on the exact sets.

Routing: 72 keys a text, each of 6 minimum hashes. A pair of Jaccard similarity 0.8
shares none of its keys with a probability below 3e-10 (2e-13 at 0.85).

Memory: a family of candidates above ``chunk_docs`` texts is routed once more, by
prefixes: two linked texts share one of the rarest fifth of their shingles (rare within
the family), so texts that share a template alone, or candidates of candidates, part
before their texts travel. What is still large is dealt into chunks by size and hash.
Links inside a chunk come first. Then a few leaders of each class meet, chunk by chunk
again, which joins the classes of a huge group of near copies in time proportional to
its size. A text still apart from its family's largest class then meets every chunk
whose sizes and shared shingles allow a link, so that none is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, U64, WordScanner, mix, stored, text_chunks, tidy

BANDS, ROWS = 72, 6
#: Bits of a bitmap for routing, and at least and at most for verification.
ROUTE_BITS, EXACT_BITS, MOST_BITS = 1024, 4096, 1 << 16


# --- sets --------------------------------------------------------------------------


def shingle_sets(column, width: int):
    """Yields (row, sorted distinct shingle hashes) for every row, in order."""
    scan = WordScanner(NOT_BLANK)
    factors = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    for lo, data, offsets in text_chunks(column):
        row, _, _, h = scan(data, offsets)
        ends = np.searchsorted(row, np.arange(len(offsets)))
        wide = len(h) - width + 1
        if wide > 0:
            combined = np.zeros(wide, U64)
            for k in range(width):
                combined += h[k : k + wide] * factors[k]
            combined = mix(combined)
        for r in range(len(offsets) - 1):
            a, b = ends[r], ends[r + 1]
            if b - a >= width:
                found = np.sort(combined[a : b - width + 1])
                keep = np.ones(len(found), bool)
                keep[1:] = found[1:] != found[:-1]
                yield lo + r, found[keep]
            elif b > a:
                whole = (h[a:b] * factors[: b - a]).sum(dtype=U64) + U64(b - a)
                yield lo + r, mix(mix(np.array([whole], U64)))
            else:
                yield lo + r, np.zeros(0, U64)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each token, as 64-bit words."""
    flags = np.zeros(bits, np.uint8)
    flags[(tokens >> U64(8)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags).view(U64)


class MinHasher:
    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(20240229))
        n = BANDS * ROWS
        self.a = (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.f = (rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64) | U64(1)).reshape(BANDS, ROWS)
        self.band = mix(np.arange(BANDS, dtype=U64) + U64(77))

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        x = (tokens >> U64(32)).astype(np.uint32)
        low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 1024):
            np.minimum(low, (self.a * x[None, k : k + 1024] + self.b).min(axis=1), out=low)
        return mix((low.astype(U64).reshape(BANDS, ROWS) * self.f).sum(axis=1, dtype=U64) + self.band).view(np.int64)


SKETCH = "doc_id long, n long, d1 long, d2 long, bands binary, bits binary"


def _sketches(width: int):
    def run(batches):
        hasher = MinHasher()
        for batch in batches:
            ids = batch.column(0)
            n, d1, d2, bands, bits = [], [], [], [], []
            for _, tokens in shingle_sets(batch.column(1), width):
                n.append(len(tokens))
                d1.append(int(mix(tokens).sum(dtype=U64).view(np.int64)))
                d2.append(int(mix(tokens ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)))
                bands.append(hasher.keys(tokens).tobytes() if len(tokens) else None)
                bits.append(bitmap(tokens, ROUTE_BITS).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.binary()), pa.array(bits, pa.binary())],
                ["doc_id", "n", "d1", "d2", "bands", "bits"],
            )

    return run


# --- the tree ------------------------------------------------------------------------


class Classes:
    """Union-find whose root is the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        up = np.array(self.up)
        while not np.array_equal(up, up[up]):
            up = up[up]
        return up


class SignatureTree:
    """Levels of nodes over sets, the first level being the sets themselves.

    Each node has the OR of its bitmaps, its least and largest set size and its
    largest slack (tokens of a set that share a bit with another of its tokens). Two
    sets share at most popcount(x AND y) + slack tokens and at most as many as the
    smaller has, and the bound of a pair of nodes holds for all pairs below.
    """

    FANOUT = 8

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > self.FANOUT:
            bits, least, most, slack = self.levels[-1]
            cut = np.arange(0, len(bits), self.FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(slack, cut)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        bits, least, most, slack = self.levels[level]
        p = self.percent
        ok = (100 * most[i] >= p * least[j]) & (100 * most[j] >= p * least[i])
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 8192):
            a, b = i[at[k : k + 8192]], j[at[k : k + 8192]]
            shared = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            overlap = np.minimum(shared + np.minimum(slack[a], slack[b]), np.minimum(most[a], most[b]))
            # overlap / (|x| + |y| - overlap) >= p / 100 for the smallest sizes below
            ok[at[k : k + 8192]] = (100 + p) * overlap >= p * (least[a] + least[b])
        return ok

    def _uniform(self, labels: np.ndarray):
        """For each level, the class of a node whose sets are all of one class, else -1."""
        out = [labels]
        for _ in self.levels[1:]:
            cut = np.arange(0, len(out[-1]), self.FANOUT)
            low, high = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(low == high, low, -1))
        return out

    def link(self, classes: Classes, verify, apart: np.ndarray | None = None) -> None:
        """Joins in ``classes`` whatever ``verify(i, j)`` confirms. ``apart``: only
        pairs of which one is marked are of interest."""
        n = len(self.levels[0][0])
        for i in range(n - 1):  # neighbours in the tree's order are the likeliest links
            if classes.find(i) != classes.find(i + 1) and self._possible(0, np.array([i]), np.array([i + 1]))[0] and verify(i, i + 1):
                classes.join(i, i + 1)
        uniform = self._uniform(classes.labels())
        marked = [np.ones(n, bool) if apart is None else apart]
        for _ in self.levels[1:]:
            marked.append(np.logical_or.reduceat(marked[-1], np.arange(0, len(marked[-1]), self.FANOUT)))
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 8192:
                stack += [(level, i[k : k + 8192].copy(), j[k : k + 8192].copy()) for k in range(0, len(i), 8192)]
                continue
            keep = ((uniform[level][i] != uniform[level][j]) | (uniform[level][i] < 0)) & (marked[level][i] | marked[level][j])
            keep &= (i != j) if level == 0 else True
            i, j = i[keep], j[keep]
            keep = self._possible(level, i, j)
            i, j = i[keep], j[keep]
            if level:
                step = np.arange(self.FANOUT)
                ci = (i[:, None, None] * self.FANOUT + step[None, :, None] + np.zeros_like(step)[None, None, :]).ravel()
                cj = (j[:, None, None] * self.FANOUT + step[None, None, :] + np.zeros_like(step)[None, :, None]).ravel()
                size = len(self.levels[level - 1][0])
                keep = (ci < size) & (cj < size) & (ci <= cj)
                if keep.any():
                    stack.append((level - 1, ci[keep], cj[keep]))
                continue
            changed = False
            for a, b in zip(i.tolist(), j.tolist()):
                if classes.find(a) != classes.find(b) and verify(a, b):
                    classes.join(a, b)
                    changed = True
            if changed:
                uniform = self._uniform(classes.labels())


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


# --- blocks ----------------------------------------------------------------------------


def _groups(batches, keys: int):
    """Yields pyarrow tables of the rows of one key (the first ``keys`` columns), from
    batches sorted by key."""
    held, last = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cut], [*cut, len(key)]):
            now = tuple(key[a])
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)


def _blocks(batches):
    """Sorted (key, doc_id) -> the rows of keys with two texts or more, under a name
    of the block that is the same for equal members."""
    tail_key, tail = None, []

    def close(members, out):
        ids = np.unique(np.concatenate(members))
        if len(ids) > 1:
            u = mix(ids.view(U64))
            out[0].append(np.full(len(ids), int((mix(u).sum(dtype=U64) ^ U64(len(ids))).view(np.int64))))
            out[1].append(ids)

    for batch in batches:
        key, ids = (batch.column(k).to_numpy() for k in (0, 1))
        if len(key) == 0:
            continue
        out = ([], [])
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        start = np.concatenate([[0], cut])
        end = np.concatenate([cut, [len(key)]])
        open_ = len(start) - 1
        for g in sorted({0, open_, *np.flatnonzero(end - start > 1).tolist()}):
            part = ids[start[g] : end[g]]
            if g == 0 and tail_key == key[0]:
                tail.append(part)
            else:
                if tail:
                    close(tail, out)
                tail_key, tail = key[start[g]], [part]
            if g != open_ and tail:
                close(tail, out)
                tail_key, tail = None, []
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["block", "doc_id"])
    out = ([], [])
    if tail:
        close(tail, out)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["block", "doc_id"])


def _edges(ids: np.ndarray, classes: Classes):
    root = classes.labels()
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[at], ids[root[at]]


def _batch(pairs):
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _route(percent: int):
    """Blocks with bitmaps -> a spanning set of the pairs that the bitmaps allow."""

    def run(batches):
        done = []
        for _, t in _groups(batches, 2):
            ids, sizes = t.column(2).to_numpy(), t.column(3).to_numpy()
            bits = np.frombuffer(b"".join(t.column(4).to_pylist()), U64).reshape(len(ids), -1)
            order = np.lexsort((ids, sizes))
            classes = Classes(len(ids))
            SignatureTree(bits[order], sizes[order], percent).link(classes, lambda i, j: True)
            done.append(_edges(ids[order], classes))
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        yield _batch(done)

    return run


def _verify(width: int, percent: int):
    """Families of texts -> links between exact sets, as edges to class roots. A third
    key column of 0 or 1 marks the side of each text in a meeting of two chunks."""

    def run(batches):
        done = []
        for _, t in _groups(batches, 2):
            ids, side = t.column(2).to_numpy(), t.column(3).to_numpy()
            sets = [s for _, s in shingle_sets(t.column(4), width)]
            first = np.array([int(s[0] >> U64(1)) for s in sets])
            order = np.lexsort((ids, first))
            sets, ids, side = [sets[k] for k in order], ids[order], side[order]
            sizes = np.array([len(s) for s in sets])
            classes = Classes(len(ids))

            def verify(i, j, sets=sets):
                both = _shared(sets[i], sets[j])
                return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

            bits = min(MOST_BITS, max(EXACT_BITS, 2 << int(sizes.max()).bit_length()))
            tree = SignatureTree(np.stack([bitmap(s, bits) for s in sets]), sizes, percent)
            tree.link(classes, verify, side == 1 if side.any() else None)
            done.append(_edges(ids, classes))
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        yield _batch(done)

    return run


def connected(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label): the least id reachable from each id that has an edge (a, b).

    Hooking to the least neighbour label and pointer jumping, one stored table a
    round; the number of rounds grows with the logarithm of the longest path. Texts of
    a group meet under many keys, so edges come repeatedly: once each, and only then
    in both directions.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    both = stored(both, f"{name}-edges")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("label")), name)
    while True:
        heard = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, "id").select("id", F.least("label", "heard").alias("now"), F.col("label").alias("was"))
        at = labels.select(F.col("id").alias("now"), F.col("label").alias("jump"))
        new = stored(hooked.join(at, "now").select("id", F.least("now", "jump").alias("label"), (F.least("now", "jump") != F.col("was")).alias("moved")), name)
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, chunk_docs: int = 256, chunk_tokens: int = 1 << 22, block_docs: int = 2048) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_class) for every row of ``docs``.

    Two texts are linked when 100 * shared >= percent * union of their distinct
    ``width``-word shingles. Null and empty texts, and texts of blanks alone, have no
    shingles and are linked with nothing, not even with each other. Repeated rows of
    one id count as copies. Rows whose id is null keep a null class. Columns beside
    the two named are ignored. ``n_class`` is the number of rows with an equal set.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketch = stored(docs.mapInArrow(tidy(_sketches(width)), SKETCH), "sketch")
    full = sketch.where("n > 0 and doc_id is not null")
    copies = stored(full.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_class")), "copies")
    # one row a set; an id that comes with several texts stands for each of them
    reps = copies.select(F.col("rep").alias("doc_id"), "n", "d1", "d2").join(full, ["doc_id", "n", "d1", "d2"]).dropDuplicates(["doc_id", "d1"]).select("doc_id", "n", "bands", "bits")

    # routing: keys held by two representatives or more; equal blocks once
    keyed = reps.mapInArrow(_exploded, "key long, doc_id long")
    blocks = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_blocks), "block long, doc_id long")
    blocks = stored(blocks.dropDuplicates(["block", "doc_id"]), "blocks")
    members = blocks.groupBy("block").agg(F.count("*").alias("held"))
    large = members.where(F.col("held") > block_docs)
    # a block beyond block_docs is taken whole, without looking at bitmaps: more
    # candidates, never fewer, and no task holds it
    stars = blocks.join(large, "block").groupBy("block").agg(F.min("doc_id").alias("a")).join(blocks, "block").select("a", F.col("doc_id").alias("b")).where("a <> b")
    small = blocks.join(large, "block", "left_anti").join(reps.select("doc_id", "n", "bits"), "doc_id")
    routed = small.select("block", F.lit(0).cast("long").alias("part"), "doc_id", "n", "bits").repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_route(percent)), "a long, b long")
    family = connected(routed.union(stars), "family")
    # sizes by strata that a link can't reach past the next of; an id with several texts is in the stratum of each
    stratum = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) + 0.001)).alias("stratum")
    sized = reps.groupBy(F.col("doc_id").alias("id"), stratum).agg(F.max("n").alias("n"), F.min("n").alias("least"))
    family = stored(family.join(sized, "id").select("id", "label", "stratum", "n", "least", F.col("n").alias("shared")), "families")
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # an id may have wordless texts too

    # large families once more, by what their texts share
    large = stored(family.join(_chunks(family, ["label"], chunk_docs, chunk_tokens).where("chunks > 1").select("label"), "label"), "large")
    if not large.isEmpty():
        members = large.select(F.col("id").alias("doc_id"), "label").distinct()
        smaller = _rerouted(worded.join(members, "doc_id").select("label", "doc_id", "text"), width, percent)
        rerouted = smaller.join(large.drop("label", "shared"), "id").select("id", "label", "stratum", "n", "least", "shared")
        family = stored(family.join(members, family["id"] == members["doc_id"], "left_anti").union(rerouted), "rerouted")

    # verification: whole families of texts; large ones dealt into chunks by size and hash
    family = family.join(_chunks(family, ["label"], chunk_docs, chunk_tokens), "label").withColumn("stratum", F.when(F.col("chunks") > 1, F.col("stratum")).otherwise(0))
    parts = _chunks(family, ["label", "stratum"], chunk_docs, chunk_tokens).withColumnRenamed("chunks", "parts")
    chunk = F.col("stratum") * (1 << 40) + F.pmod(F.xxhash64("id"), "parts")
    family = stored(family.join(parts, ["label", "stratum"]).select("label", F.col("id").alias("doc_id"), "n", "least", "shared", "chunks", "stratum", chunk.alias("chunk")), "chunks")
    texts = worded.join(family, "doc_id").select("label", "chunk", "chunks", "doc_id", "text").dropDuplicates(["doc_id", "chunk", "text"])
    texts = stored(texts, "family-texts")
    dealt = texts.select("label", "chunk", "doc_id", F.lit(0).alias("side"), "text").repartition("label", "chunk").sortWithinPartitions("label", "chunk")
    edges = stored(dealt.mapInArrow(tidy(_verify(width, percent)), "a long, b long"), "links")
    labels = connected(edges, "component")
    if not family.where("chunks > 1").isEmpty():
        labels = _joined_chunks(texts.where("chunks > 1"), family.where("chunks > 1"), edges, labels, width, percent, chunk_docs)

    classed = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "d1", "d2", "n_class", F.coalesce("label", "rep").alias("class"))
    out = sketch.select("doc_id", "n", "d1", "d2").join(classed, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def _exploded(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            if part.num_rows:
                keys = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
                ids = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "doc_id"])


def _chunks(family: DataFrame, by: list[str], chunk_docs: int, chunk_tokens: int) -> DataFrame:
    """Into how many chunks each group of texts of ``n`` shingles has to be dealt."""
    return family.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / chunk_docs), F.ceil(F.sum("n") / chunk_tokens)).alias("chunks"))


# --- large families ----------------------------------------------------------------------


def _shingles(width: int, percent: int):
    """Texts -> their shingles, with how many of them a prefix has."""

    def run(batches):
        for batch in batches:
            label, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, sets, held = [], [], 0
            for r, tokens in shingle_sets(batch.column(2), width):
                if len(tokens):
                    rows.append(r)
                    sets.append(tokens)
                    held += len(tokens)
                if held >= 100_000:
                    yield _listed(label, ids, rows, sets, percent)
                    rows, sets, held = [], [], 0
            if sets:
                yield _listed(label, ids, rows, sets, percent)

    return run


SHINGLES = "label long, doc_id long, d1 long, n int, token long"


def _listed(label, ids, rows, sets, percent):
    size = np.array([len(s) for s in sets])
    at = np.repeat(np.array(rows), size)
    d1 = np.array([mix(s).sum(dtype=U64) for s in sets], U64).view(np.int64)
    columns = [label[at], ids[at], np.repeat(d1, size), np.repeat(size, size).astype(np.int32), np.concatenate(sets).view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["label", "doc_id", "d1", "n", "token"])


def _rerouted(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, label, shared) of the texts of families (label, doc_id, text) that have a
    candidate left, under the labels of smaller families; ``shared`` is the largest number
    of a text's shingles that any other text of its old family has.

    In one order of all shingles (rarer ones within the family first), two linked texts
    share a shingle among the first n - ceil(n * percent / 100) + 1 of each. Shingles of
    one text alone come first and can meet nobody; texts that share one of the others in
    these prefixes make a family.
    """
    tokens = stored(texts.mapInArrow(tidy(_shingles(width, percent)), SHINGLES), "shingles")
    common = tokens.groupBy("label", "token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(common, ["label", "token"]).groupBy("label", "doc_id", "d1", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("held"))
    # of the prefix, the shingles of this text alone have the first places
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("held"))
    held = stored(held.select("label", "doc_id", F.size("held").cast("long").alias("shared"), F.slice("held.token", 1, F.greatest(reach, F.lit(0)).cast("int")).alias("prefix")), "prefixes")
    keys = held.select("label", "doc_id", F.explode("prefix").alias("token"))
    hubs = keys.groupBy("label", "token").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a <> last").select("label", "token", "a")
    stars = keys.join(hubs, ["label", "token"]).select("a", F.col("doc_id").alias("b")).where("a <> b")
    shared = held.groupBy(F.col("doc_id").alias("id")).agg(F.max("shared").alias("shared"))
    return connected(stars, "smaller").join(shared, "id")


LEADERS = 4


def _classes(texts: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("class"))
    return texts.join(labels, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))


def _joined_chunks(texts: DataFrame, family: DataFrame, edges: DataFrame, labels: DataFrame, width: int, percent: int, chunk_docs: int) -> DataFrame:
    """Labels with the links across chunks. Leaders of classes meet in rounds: each deals
    a family's leaders into chunks, until they are one chunk or a round joins less than a
    tenth of the classes that are left; ``_across`` does the rest."""
    k, before = 0, None
    while True:
        classed = _classes(texts.select("label", "doc_id"), labels)
        picks = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(salt))) for salt in range(LEADERS)]
        led = classed.groupBy("label", "class").agg(F.array_distinct(F.array(*picks)).alias("ids"))
        sizes = led.groupBy("label").agg(F.count("*").alias("classes"), F.ceil(F.sum(F.size("ids")) / chunk_docs).alias("parts")).where("classes > 1")
        led = stored(led.join(sizes, "label").select("label", "class", "parts", F.explode("ids").alias("doc_id")), "leaders")
        left, most = led.agg(F.count_distinct("class"), F.max("parts")).first()
        if left == 0 or (before is not None and left > 0.9 * before):
            break
        part = F.pmod(F.xxhash64("doc_id", F.lit(100 + k)), F.col("parts"))
        dealt = texts.select("label", "doc_id", "text").join(led, ["label", "doc_id"]).select("label", part.alias("part"), "doc_id", F.lit(0).alias("side"), "text")
        met = dealt.repartition("label", "part").sortWithinPartitions("label", "part").mapInArrow(tidy(_verify(width, percent)), "a long, b long")
        edges = stored(edges.union(met), "led-links")
        labels = connected(edges, "leading")
        if most == 1:
            break
        k, before = k + 1, left
    meetings = _meetings(texts, family, labels, percent, chunk_docs)
    return labels if meetings is None else connected(edges.union(_across(texts, *meetings, width, percent)), "joined")


def _meetings(texts: DataFrame, family: DataFrame, labels: DataFrame, percent: int, chunk_docs: int) -> tuple[DataFrame, DataFrame] | None:
    """Which texts travel to which meetings, (label, part, doc_id) of texts outside their
    family's largest class and (label, part, chunk) of the chunks that these may have links
    with; None if there is no such text.

    Such texts are dealt into groups of one stratum of sizes. A group meets a chunk of its
    or a neighbouring stratum (others are too large or too small) if the shingles that
    either side shares with anyone suffice for a link.
    """
    ids = _classes(family, labels)
    counts = ids.groupBy("label", "class").agg(F.count("*").alias("held"))
    core = counts.groupBy("label").agg(F.max_by("class", F.struct("held", F.col("class"))).alias("core"))
    outer = stored(ids.join(core, "label").where(F.col("class") != F.col("core")).select("label", "stratum", "least", "shared", "doc_id"), "outer")
    if outer.isEmpty():
        return None
    groups = outer.groupBy("label", "stratum").agg(F.ceil(F.count("*") / chunk_docs).alias("groups"))
    outer = outer.join(groups, ["label", "stratum"]).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), "groups"))
    chunks = family.groupBy("label", "stratum", "chunk").agg(F.min("least").alias("there"), F.max("shared").alias("most"))
    near = F.explode(F.array(F.col("stratum") - 1, F.col("stratum"), F.col("stratum") + 1))
    met = outer.select("label", F.col("stratum").alias("from"), "own", "doc_id", "least", "shared", near.alias("stratum")).join(chunks, ["label", "stratum"])
    met = met.where((100 + percent) * F.least("shared", "most") >= percent * (F.col("least") + F.col("there")))
    part = F.xxhash64("from", "own", "chunk").alias("part")
    moved = stored(met.select("label", part, "chunk", "doc_id"), "meetings")
    return moved.select("label", "part", "doc_id"), moved.select("label", "part", "chunk").distinct()


def _across(texts: DataFrame, moved: DataFrame, asked: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of the texts that travel with the chunks that they meet."""
    met = texts.select("label", "doc_id", "text").join(moved, ["label", "doc_id"]).select("label", "part", "doc_id", F.lit(1).alias("side"), "text")
    there = texts.select("label", "chunk", "doc_id", "text").join(asked, ["label", "chunk"]).select("label", "part", "doc_id", F.lit(0).alias("side"), "text")
    both = met.union(there).repartition("label", "part").sortWithinPartitions("label", "part")
    return stored(both.mapInArrow(tidy(_verify(width, percent)), "a long, b long"), "across")
