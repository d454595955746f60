import random

import numpy as np
import pytest

from seriesmill.llm import common, ngram_join
from seriesmill.llm.ngram_join import Classes, SignatureTree, bitmap, connected, jaccard_components

from .helpers import awkward, components, documents, prose


def family(seed, size, edits, words=90):
    rng = random.Random(seed)
    base = prose(seed, words)
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def check(spark, rows, **options):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(spark, rows), **options).collect()}
    assert got == components(rows)


def test_matches_brute_force(spark):
    texts = [t for s in range(6) for t in family(s, 8, 6)] + [" ".join(prose(100 + k, 50)) for k in range(20)]
    check(spark, list(enumerate(texts)))


def test_chunks_of_a_large_family_lose_no_link(spark):
    texts = [t for s in range(2) for t in family(s, 40, 5)] + family(7, 3, 2)
    check(spark, list(enumerate(texts)), chunk_docs=6)
    check(spark, list(enumerate(texts)), chunk_docs=9, block_docs=3)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = jaccard_components(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    want = components(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_empty_table(spark):
    assert jaccard_components(documents(spark, [])).collect() == []


def test_only_texts_without_words(spark):
    got = jaccard_components(documents(spark, [(1, None), (2, " ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)]
    got = {r.id: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert set(got.values()) == {1, 100} and got[140] == 100 and got[59] == 1


@pytest.mark.parametrize("percent", [50, 80])
def test_tree_finds_every_linked_pair(percent):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (5, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k % 5][rng.random(60) < 0.85], rng.integers(0, 1 << 63, rng.integers(0, 8)).astype(np.uint64)])) for k in range(60)]
    sizes = np.array([len(s) for s in sets])

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= percent * (sizes[i] + sizes[j] - both)

    classes, brute = Classes(60), Classes(60)
    SignatureTree(np.stack([bitmap(s, 256) for s in sets]), sizes, percent).link(classes, linked)
    for i in range(60):
        for j in range(i):
            if linked(i, j):
                brute.join(i, j)
    assert [classes.find(i) for i in range(60)] == [brute.find(i) for i in range(60)]


def test_an_id_with_a_linked_and_a_wordless_text(spark):
    text = " ".join(prose(90, 60))
    rows = [(1, text), (1, ""), (1, None), (1, " \t"), (2, text + " more"), (3, None)]
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in jaccard_components(documents(spark, rows)).collect())
    assert got == [(1, False, 1)] * 3 + [(1, True, 1), (2, True, 1), (3, False, 3)]


def template(k, shared=90, own=30):
    """A page of a site: three quarters are the site's words."""
    return " ".join(prose(500, shared) + prose(1000 + k, own, 3000))


def counted(spark, monkeypatch, rows, **options):
    """Components of rows, and how many rows each scratch table had."""
    held = {}

    def stored(df, name, **more):
        out = common.stored(df, name, **more)
        held[name] = held.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(spark, rows), **options).collect()}
    return got, held


@pytest.mark.parametrize("paired", [False, True])
def test_an_unlinked_template_family_ships_few_texts(spark, monkeypatch, paired):
    shipped = []
    for n in (48, 96):
        rows = [(k, template(k // 2 if paired else k) + (f" end{k}" if paired else "")) for k in range(n)]
        got, held = counted(spark, monkeypatch, rows, chunk_docs=8, block_docs=2)
        assert got == components(rows)
        assert held["large"] == n  # the candidates were one family
        shipped.append(held["family-texts"] + held.get("leaders", 0) + held.get("meetings", 0))
    assert shipped == ([48, 96] if paired else [0, 0])


def test_a_chain_of_links_through_chunks_and_strata(spark, monkeypatch):
    words = prose(77, 900, 5000)
    rows = [(500 - k, " ".join(words[4 * k : 4 * k + 60 + k // 3])) for k in range(60)]  # each linked with its neighbours alone
    rows += [(900 + k, " ".join(words[:60] + prose(2000 + k, 9 + k, 3000))) for k in range(12)]
    got, held = counted(spark, monkeypatch, rows, chunk_docs=6)
    assert got == components(rows) and held["leaders"] > 0
    got, held = counted(spark, monkeypatch, [(i, t) for i, t in rows if i < 900 and i % 2], chunk_docs=4)
    assert got == components([(i, t) for i, t in rows if i < 900 and i % 2])


def test_texts_of_one_id_of_different_sizes(spark):
    a, b = prose(21, 60, 3000), prose(22, 200, 3000)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:58])), (3, " ".join(b[4:])), *[(10 + k, " ".join(a[: 45 - k] + prose(90 + k, 15, 3000))) for k in range(12)]]
    got = jaccard_components(documents(spark, rows), chunk_docs=2).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id < 4} == {1: 1, 2: 1, 3: 1}


def both_ways(spark, run):
    """How many rows Spark's own counts give the step that turns edges both ways, while
    ``run`` runs."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    since = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    found, total = store.executionsList(), 0
    for e in (found.apply(k).executionId() for k in range(since, found.size())):
        counts, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "Generate" and "struct(u" in node.desc():
                metrics = node.metrics()
                ids = [metrics.apply(k).accumulatorId() for k in range(metrics.size()) if metrics.apply(k).name() == "number of output rows"]
                total += sum(int(counts.get(i).get().replace(",", "")) for i in ids if counts.get(i).isDefined())
    return total


def test_an_edge_that_comes_often_is_turned_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 4)] * 500, "a long, b long")
    assert both_ways(spark, lambda: connected(edges).count()) == 4


def test_edges_of_a_group_of_near_copies_grow_with_its_texts(spark):
    texts, made = family(31, 240, 6, 200), []
    for n in (60, 120, 240):
        rows = list(enumerate(texts[:n]))
        made.append(both_ways(spark, lambda: check(spark, rows)))
    assert made[0] > 0 and all(m <= 30 * n for m, n in zip(made, (60, 120, 240)))
