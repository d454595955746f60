"""Mixing sources to target weights by the cube method.

Each source has a target of words; a document's expected number of copies is its
source's target over its source's size. The whole part is certain; the fraction is an
inclusion probability, and the cube method turns probabilities into 0 or 1 while it
keeps the totals of documents and of words: probabilities move through the null space
of the two constraints until one is settled, over and over. Blocks of bounded size fly
in parallel; the two or so documents that each leaves open meet in the next round, and
when a source has one block left, what is open there is the landing problem.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
CELLS = "doc_id long, size long, source string, source_size long, target double, base long, p double, rows long, place long, bin long"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) of rows (source, size).

    Sources by code point, null last, have the weights in turn. The targets fill up
    ``share`` of all sizes by weight, with ``most`` times a source's size as its limit;
    the excess goes to the others by weight. One row a source from here on.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources").select("source", "source_size", "n", w.alias("w"))
    s = s.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    s = s.withColumns({
        "rank": F.row_number().over(fill),
        "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.sum("source_size").over(whole) * share,
    })
    s = s.withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    s = s.withColumn("first", F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("rank", "level"))).over(whole))
    return s.select("source", "source_size", "n", F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("cap")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities until two or fewer stay open (three sizes span the null space
    of the sums of p and of p * size); settled ones are exactly 0 or 1."""
    p, size = p.tolist(), size.tolist()
    open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    draw = np.random.Generator(np.random.PCG64(seed)).random(len(open_) + 1).tolist()
    hand, rest = open_[:3], iter(open_[3:])
    for u in draw:
        if len(hand) < 2:
            break
        s = [size[i] for i in hand]
        if len(hand) == 3:
            v = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
            if not any(v):
                v = [1, -1, 0]
        elif s[0] == s[1]:
            v = [1, -1]
        else:
            break
        scale = max(map(abs, v))
        v = [x / scale for x in v]
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(hand, v) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(hand, v) if x)
        step = up if u * (up + down) < down else -down
        at = []
        for i, x in zip(hand, v):
            p[i] += step * x
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
            else:
                at.append(i)
        hand = at
        for i in itertools.islice(rest, 3 - len(hand)):
            hand.append(i)
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the few open ones: of all their outcomes, that with words nearest to the
    expected number, then documents nearest, then the first."""
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        outcomes = np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1
        words = np.abs(outcomes @ size[at] - (p[at] * size[at]).sum())
        docs = np.abs(outcomes.sum(axis=1) - p[at].sum())
        p[at] = outcomes[np.lexsort((docs, words))[0]]
    return p


#: Documents, spread over the sizes, that the last flight of a source leaves for landing.
RESERVED = 10


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "place"], ascending=[False, True, True], na_position="first", kind="stable")
        p, size = pdf["p"].to_numpy(copy=True), pdf["size"].to_numpy()
        seed = int(np.uint64((int(pdf["bin"].iloc[0]) * 2654435761 + len(pdf) * 40503 + int(size.sum())) & (2**63 - 1)))
        if last:
            kept = np.unique(np.linspace(0, len(p) - 1, min(RESERVED, len(p))).round().astype(int))
            flying = np.setdiff1d(np.arange(len(p)), kept)
            p[flying] = flight(p[flying], size[flying], seed)
            p = land(p, size)
        else:
            p = flight(p, size, seed)
        return pdf.assign(p=p)

    return run


def _placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, doc_id, size, ...) with ``place``, which numbers from 0 the rows
    that are equal in these. It counts within each partition of the table first, so that
    rows of which a third are equal meet in no one task."""
    keys = ["source", "doc_id", "size"]
    parts = stored(sizes.withColumn("part", F.spark_partition_id()), "sizes-by-part")
    inner = Window.partitionBy("part", *keys).orderBy(F.lit(1))
    numbered = parts.withColumn("inner", F.row_number().over(inner).cast("long") - 1)
    held = parts.groupBy("part", *keys).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = held.withColumn("before", before).where("before > 0").drop("held")
    on = (F.col("n.part") == F.col("l.part")) & (F.col("n.size") == F.col("l.size"))
    for k in ("source", "doc_id"):
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}"))
    placed = numbered.alias("n").join(later.alias("l"), on, "left")
    return placed.select(*[f"n.`{c}`" for c in sizes.columns], (F.col("inner") + F.coalesce("before", F.lit(0).cast("long"))).alias("place"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024, row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id,
    text, source), and its long column ``row_col`` if one is named.

    size is the number of words between blanks; null texts have 0 and take 0. Repeated
    rows are documents of their own. Null is a source like another. Reruns agree: bins
    and draws derive from ids, sizes and, among rows equal in both, their number, not from
    the order of rows; no bin is much larger than ``block`` however many rows are equal.
    """
    own = [row_col] if row_col else []
    schema = ", ".join([CELLS, *[f"`{c}` long" for c in own]])
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("size"), F.col("source").cast("string").alias("source"), *own))
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, weights, share, most)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cells = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.size", "d.source", "source_size", "target", factor.alias("f"), F.col("n").alias("rows"), "place", *own)
    base = F.floor(F.least(F.col("f"), F.lit(most)) + 1e-12)
    cells = cells.withColumn("base", base.cast("long")).withColumn("p", F.greatest(F.col("f") - F.col("base"), F.lit(0.0)))
    cells = cells.withColumn("p", F.when((F.col("p") < 1e-9) | (F.col("size") == 0), 0.0).otherwise(F.col("p"))).drop("f")
    settled = cells.where("p = 0").select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size")).alias("taken"), *own)
    parts = [settled]
    open_ = cells.where("p > 0")
    rounds = 0
    while True:
        # 0 is the source's only bin: the last round lands
        bins = F.ceil(F.col("rows") / block)
        salt = F.xxhash64("doc_id", "size", "place", F.lit(rounds))
        dealt = open_.withColumn("bin", F.when(bins > 1, F.pmod(salt, bins) + 1).otherwise(F.lit(0)).cast("long"))
        landing = dealt.where("bin = 0").groupBy("source", "bin").applyInPandas(_fly(True), schema)
        flying = dealt.where("bin > 0").groupBy("source", "bin").applyInPandas(_fly(False), schema)
        done = stored(landing.union(flying), f"mix-{rounds}")
        parts.append(done.where("p = 0 or p = 1").select("doc_id", "size", "source_size", "target", ((F.col("base") + F.col("p").cast("long")) * F.col("size")).alias("taken"), *own))
        open_ = done.where("p > 0 and p < 1").drop("bin")
        counts = open_.groupBy("source").agg(F.count("*").alias("rows"))
        if counts.isEmpty():
            break
        open_ = stored(open_.drop("rows").alias("o").join(counts.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source"))).select("o.*", "rows"), f"mix-open-{rounds}")
        rounds += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
