import math
import random

import numpy as np
import pytest

from seriesmill.llm import common, mixing
from seriesmill.llm.mixing import flight, land, mix_sources

from .helpers import awkward, documents, jaccard_words


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By the words of the contract: share out, cut at the limit, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s] + 1e-12}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(spark, rows, **options):
    got = mix_sources(documents(spark, [(i, t, None, s) for i, t, s in rows]), **options).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(jaccard_words(t))
    want = targets(size)
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    again = mix_sources(documents(spark, [(i, t, None, s) for i, t, s in reversed(rows)]), **options).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    return taken, want


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(k, "w " * rng.randint(1, 200), rng.choice(["a", "a", "a", "b", "B", "é", None])) for k in range(n)]


def test_targets_and_totals(spark):
    taken, want = check(spark, corpus(400))
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.01 * max(want[s], 300)


def test_several_rounds_of_blocks(spark):
    taken, want = check(spark, corpus(600, 2), block=16)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * max(want[s], 300)


def test_awkward_rows(spark):
    rows = [(i, t, s) for (i, t), s in zip([r for r in awkward() if r[0] not in (None, 12)], ["x", None, "", "y", "x", "x"] * 5)]
    check(spark, rows)
    got = mix_sources(documents(spark, [(i, t, None, "s") for i, t in awkward()])).collect()
    assert len(got) == len(awkward())


def test_empty_and_wordless_tables(spark):
    assert mix_sources(documents(spark, [])).collect() == []
    got = mix_sources(documents(spark, [(1, None, None, "a"), (2, " ", None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    p, size = rng.random(300), rng.integers(1, 500, 300)
    out = flight(p, size, seed)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2
    assert math.isclose(out.sum(), p.sum(), rel_tol=1e-6) and math.isclose((out * size).sum(), (p * size).sum(), rel_tol=1e-6)


def test_flight_keeps_inclusion_probabilities():
    p, size = np.full(40, 0.3), np.arange(1, 41)
    share = np.mean([flight(p, size, s) for s in range(2000)], axis=0)
    assert np.abs(share - 0.3).max() < 0.05


def test_landing_takes_the_nearest_outcome():
    assert land(np.array([1.0, 0.5, 0.5, 0.0]), np.array([9, 10, 4, 7]))[[0, 3]].tolist() == [1, 0]
    out = land(np.array([0.5, 0.5]), np.array([10, 10]))
    assert sorted(out.tolist()) == [0, 1]


def test_rows_equal_in_everything_fill_no_bin_beyond_its_size(spark, monkeypatch):
    """A third of the rows have no id and one size."""
    seen = []

    def fly(last, make=mixing._fly):
        run = make(last)

        def counted(pdf):
            return run(pdf).assign(rows=len(pdf))

        return counted

    monkeypatch.setattr(mixing, "_fly", fly)
    monkeypatch.setattr(mixing, "stored", lambda df, name, **o: (seen.append((name, common.stored(df, name, **o))), seen[-1][1])[1])
    rows = [(None if k % 3 == 0 else k, "w " * (10 if k % 3 == 0 else k % 50 + 1), None, "a") for k in range(3000)]
    taken = []
    for order, parts in ((rows, 1), (rows[::-1], 7)):
        got = mix_sources(documents(spark, order).repartition(parts), block=64).collect()
        assert len(got) == len(rows)
        taken.append(sorted(map(tuple, got), key=str))
    assert taken[0] == taken[1]
    assert abs(sum(r[4] for r in taken[0]) - taken[0][0][3]) <= 0.01 * taken[0][0][3]
    bins = [df for name, df in seen if name == "mix-0"]
    assert bins and all(df.agg({"rows": "max"}).first()[0] < 2 * 64 for df in bins)
