import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from seriesmill.llm import chat_format, url_trust

SCHEMA = "conv_id long, turn long, role string, text string, loss string, turns string"


def test_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "hi\n"), (1, 1, "assistant", "<|end|> é \U0001f600 <\\|turn|>"), (1, 2, "assistant", None), (1, 3, None, "x"),
        (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, None, "user", "first"), (None, 0, "assistant", "no id"),
        (3, 0, "<|text|>\nrole", "<|endoftext|></s>[INST]"), (4, 1, "assistant", "b"), (4, 0, "assistant", "a" * 50000),
    ]
    frame = spark.createDataFrame([(*r, "l", "t") for r in rows], SCHEMA)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.stored_conversations(frame)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_conversations(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert chat_format.read_back(chat_format.stored_conversations(frame)).collect() == []


@given(st.text(alphabet="<|\\>[]/INSTsend turx\n", max_size=40))
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(c in hidden for c in (*chat_format.CONTROLS, "</s>", "<s>", "[INST]", "[/INST]", "<|"))


def test_token_spans_by_binary_search():
    offsets = np.array([[0, 3], [3, 5], [5, 5], [5, 9]])
    assert chat_format.token_spans(offsets, np.array([[3, 5], [5, 5], [4, 6]])).tolist()[0] == [1, 2]
    assert chat_format.token_spans(offsets, np.array([[4, 6]])).tolist() == [[1, 4]]


def solved(seeds, edges, damping=0.85):
    """The fixed point by linear algebra: score = (1 - damping) seed + damping (inflow + what
    hosts without out-edges have, shared by seed)."""
    names = sorted({*seeds, *(e[0] for e in edges), *(e[1] for e in edges)})
    at = {h: k for k, h in enumerate(names)}
    move = np.zeros((len(names), len(names)))
    for s, d, w in edges:
        move[at[d], at[s]] += w / sum(e[2] for e in edges if e[0] == s)
    seed = np.array([seeds.get(h, 0.0) for h in names])
    for h in names:
        if not any(e[0] == h for e in edges):
            move[:, at[h]] = seed / seed.sum()
    score = np.linalg.solve(np.eye(len(names)) - damping * move, (1 - damping) * seed)
    return dict(zip(names, score))


def test_propagation_meets_its_fixed_point_on_cycles_and_dead_ends(spark):
    rng = np.random.default_rng(3)
    names = [f"h{k}" for k in range(30)]
    pairs = {(names[rng.integers(25)], names[rng.integers(30)]) for _ in range(70)} | {("h0", "h1"), ("h1", "h0"), ("h2", "h29")}
    edges = [(s, d, float(rng.integers(1, 9))) for s, d in sorted(pairs) if s != d]
    seeds = {"h0": 1.0, "h2": 0.5, "h7": 0.25}
    total = {}
    for s, _, w in edges:
        total[s] = total.get(s, 0) + w
    frame = spark.createDataFrame([(k, s, d, w / total[s]) for k in ("a", "b") for s, d, w in edges], "kind string, src string, dst string, share double")
    given = spark.createDataFrame([("a", h, x) for h, x in seeds.items()] + [("b", "h3", 2.0), ("b", "h4", 0.0)], "kind string, host string, seed double")
    got = {(r.kind, r.host): r.score for r in url_trust.propagate(given, frame, tolerance=1e-7).collect()}
    for kind, own in (("a", seeds), ("b", {"h3": 2.0})):
        want = solved(own, edges)
        assert all(abs(got.get((kind, h), 0.0) - x) < 1e-6 for h, x in want.items())
        assert abs(sum(x for (k, _), x in got.items() if k == kind) - sum(own.values())) < 1e-9


def test_trust_reaches_over_many_links(spark):
    """A chain that ends in a blocked host: twenty rounds would not do."""
    rows = [(k, f"http://h{k:02d}.info/", f"<A HREF=http://h{k + 1:02d}.info/>x</A>", "v", "h") for k in range(40)]
    rows.append((40, "http://h40.info/", "<a href = 'http://bad.net/'>", "v", "h"))
    rows.append((41, "http://bad.net/", "", "v", "h"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")
    edges = [(r.src, r.dst) for r in url_trust.host_edges(frame.drop("host").withColumn("host", url_trust.host_of(frame["url"]))).collect()]
    assert len(edges) == 41
    got = {r.page_id: r.verdict for r in url_trust.judge_urls(frame, threshold=0.85**30).collect()}
    assert [k for k in range(42) if got[k] == "block"] == list(range(11, 42))


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    def page(k, url, *links):
        return (k, url, "".join(f"<a href='{x}'>" for x in links), "v", "h")

    rows = [
        page(1, "http://bad.net/x", "/own", "http://other.example.info/"),
        page(2, "https://farm.info/a", "http://bad.net/1", "//bad.net/2", "HTTP://BAD.net/3"),
        page(3, "https://farm.info/b", "http://bad.net/1"),
        page(4, "http://good.org/fr/x", "http://friend.info/", "http://good.org/y"),
        page(5, "http://friend.info/q", "http://good.org/fr/x"),
        page(6, "http://other.example.info/"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge_urls(frame).collect()}
    assert got[1] == ("bad.net", "/x", "net/", "block")
    assert got[2] == ("farm.info", "/a", None, "block") and got[3][3] == "block"
    assert got[4] == ("good.org", "/fr/x", "org/fr/", "allow") and got[5][3] == got[6][3] == "allow"
    edges = [(r.src, r.dst, r.weight) for r in url_trust.host_edges(frame.drop("host").withColumn("host", url_trust.host_of(frame["url"]))).collect()]
    assert ("farm.info", "bad.net", 4.0) in edges and not [e for e in edges if e[0] == e[1]]
    back = [(d, s, w) for s, d, w in edges]
    brute = solved({"bad.net": 1.0}, back)
    assert brute["farm.info"] >= 0.5 * brute["bad.net"]


def test_awkward_urls(spark):
    urls = [None, "", "nothing", "http://", "http://A.B.NET?x", "x://h.org/fr/#y", "http://example.com/de/", "http://notexample.com/de/", "http://a.example.net/en/", "http://a.example.net/EN/", "a://b://c/d", "http://Ünet/", "http://net/"]
    rows = [(k, u, None, "block", "z") for k, u in enumerate(urls)] + [(0, None, "<a href=>", "", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_trust.judge_urls(frame).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[0] == by[1] == by[2] == ("", "", None, "allow") and by[3][:2] == ("", "")
    assert by[4] == ("a.b.net", "", None, "allow")
    assert by[5] == ("h.org", "/fr/", "org/fr/", "allow") and by[6][2:] == ("example.com/de/", "block")
    assert by[7][2] is None and by[8][2:] == ("example.net/en/", "allow") and by[9][2:] == ("net/", "block")
    assert by[10][:2] == ("b:", "//c/d") and by[12][2] == "net/"
    assert url_trust.judge_urls(frame.limit(0)).collect() == []
