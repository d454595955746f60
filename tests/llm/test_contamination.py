import hashlib
import re

import numpy as np
import pytest

from seriesmill.llm.contamination import FMIndex, drop_contaminated, find_contamination, remove_spans, suffix_array
from seriesmill.llm.queries import QUERIES

from .helpers import awkward, documents, prose


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(rows, items, width=13):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case():
    item = prose(50, 40, 60)
    clean = prose(51, 300, 60)
    rows = [
        *awkward(), (30, " ".join(clean)), (31, " ".join(clean[:100] + item[5:30] + clean[100:])), (32, "!".join(w.upper() for w in item[:13])),
        (33, " ".join(item[:12] + ["gap"] + item[12:24])), (34, " ".join((item[:13] + ["x"]) * 50)), (34, " ".join(item)), (35, " ".join(item[20:] + item[:20])),
    ]
    items = [(7, " ".join(item)), (8, "one two"), (9, None), (10, ""), (11, "... !!"), (12, " ".join(item[:20])), (12, " ".join(item[:20])), (None, " ".join(clean[:20]))]
    return rows, items


@pytest.mark.parametrize("slice_chars", [1 << 24, 60])
def test_matches_brute_force(spark, slice_chars):
    rows, items = case()
    bench = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")
    got = find_contamination(documents(spark, rows), bench, slice_chars=slice_chars).collect()
    mine = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
    assert sorted(mine, key=str) == sorted(brute(rows, [i for i in items if i[0] is not None]), key=str)
    for r in got:
        spans = [(s.first, s.end) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_hit and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_spans_are_cut_out_of_texts(spark):
    item = prose(50, 20, 60)
    rows = [(1, "é before, " + " ".join(item[:15]) + "! after"), (2, "clean"), (3, None), (4, "-".join(item).upper())]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = documents(spark, rows)
    found = find_contamination(docs, bench).select("doc_id", "spans")
    cut = remove_spans(docs.join(found, "doc_id"))
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {1: "é before, ! after", 2: "clean", 3: "", 4: ""}
    assert set(cut.columns) == set(docs.columns)
    assert not [r for r in find_contamination(cut, bench).collect() if r.n_hit]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = find_contamination(documents(spark, awkward()), bench).collect()
    assert len(got) == len(awkward()) and not any(r.n_hit for r in got)
    full = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert find_contamination(documents(spark, []), full).collect() == []


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    s = rng.integers(1, 4, 500)
    s[rng.random(500) < 0.05] = 0
    s = np.append(s, 0)
    index = FMIndex(s, 3)
    for n in (1, 2, 5):
        for _ in range(40):
            at = int(rng.integers(0, 500 - n))
            p = s[at : at + n]
            if (p == 0).any():
                continue
            lo, hi = index.search(p[None, :], np.array([n]))
            want = [k for k in range(len(s) - n + 1) if (s[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_suffixes_are_sorted():
    s = np.array([2, 1, 2, 1, 0, 2, 1, 0])
    order = suffix_array(s)
    key = lambda k: [(-100 + j) if s[j] == 0 else int(s[j]) for j in range(k, len(s))]
    assert order.tolist() == sorted(range(len(s)), key=key)


def test_items_without_an_id_count_as_hits(spark, tmp_path):
    item, named = prose(52, 20, 60), prose(53, 20, 60)
    documents(spark, [(1, " ".join(item)), (2, " ".join(named)), (3, "clean")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, " ".join(item)), (5, " ".join(named))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op6_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {1: (20, 0, True), 2: (20, 1, True), 3: (0, 0, False)}
    docs, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    for slice_chars in (1 << 22, 60):
        assert [r.doc_id for r in drop_contaminated(docs, items, slice_chars=slice_chars).collect()] == [3]
