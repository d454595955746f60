import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmill.llm import token_counts, token_orc, tokenizing
from seriesmill.llm.common import scratch_path, stored

from .helpers import awkward, documents

HARD = ["İstanbul ÉCOLE<|endoftext|>x it's don't\t'\x85 á Å  ñ%%%… 12ab !'s ' ſ ŉ K", "", "  \n", "a'LL.b", "ΑΣ. ΟΔΟΣ's ǅ,", "x.' y'. z'' .'s", "a.,b ..,, c"]


def plain(texts):
    return [e.ids for e in tokenizing.load("word_bpe_49k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    ids, n = encoder(pa.array(texts, pa.string()))
    return [list(x) for x in np.split(ids, np.cumsum(n)[:-1])]


def test_word_encoder_equals_the_tokenizer():
    encoder = tokenizing.WordEncoder(tokenizing.load("word_bpe_49k.json"), limit=10)
    for _ in range(3):  # across generations of what is remembered
        assert encoded(encoder, HARD) == plain(HARD)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_word_encoder_on_any_text(texts):
    assert encoded(tokenizing.word_encoder("word_bpe_49k.json"), texts) == plain(texts)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for (doc_id, _), ids in zip(rows, plain([t for _, t in rows])):
        data = np.array([*ids, 2], "<u4")
        out.append((doc_id, at, len(data), zlib.crc32(data.tobytes())))
        at += len(data)
    return out


def test_round_trip_of_awkward_rows(spark):
    rows = [*awkward(), *[(100 + k, t) for k, t in enumerate(HARD)]]
    got = [tuple(r) for r in token_orc.tokens_digest(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_no_documents(spark):
    assert token_orc.tokens_digest(documents(spark, [])).collect() == []


def test_files_have_stripes_in_order_and_indexes(spark):
    path = scratch_path(spark, "orc-test")
    token_orc.write_tokens(documents(spark, [(k, f"word{k} a b c") for k in range(3000)]), path)
    rows = token_orc.read_tokens(spark, path)
    assert [r.doc_id for r in rows.orderBy("start").select("doc_id").collect()] == list(range(3000))
    plan = rows.where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(spark.read.orc(path).inputFiles()[0])
    reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {str(footer.getStreams(k).getKind()) for k in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    codes = {str(footer.getColumns(k).getKind()) for k in range(footer.getColumnsCount())}
    assert "DIRECT_V2" in codes  # run-length encoded integers
    ids = rows.where("doc_id = 7").first().ids
    assert ids[-1] == 2 and ids[:-1] == plain(["word7 a b c"])[0]


COUNT = token_counts._counter(token_counts.VOCABULARY)
ALPHABET = "ab cd'é1.\n жα漢。、２ "


def whole(text):
    return COUNT([text])[0]


@settings(deadline=None, max_examples=150)
@given(st.text(ALPHABET, max_size=200), st.lists(st.tuples(st.integers(0, 220), st.integers(0, 60), st.text(ALPHABET, max_size=60)), max_size=6))
def test_tree_equals_a_full_recount(text, edits):
    tree = token_counts.TokenTree(text, COUNT, size=8)
    assert tree.total == whole(text)
    for start, size, new in edits:
        tree.replace(start, start + size, new)
        text = text[:start] + new + text[start + size :] if start <= len(text) else text + new
        assert tree.text() == text and tree.length == len(text)
        assert tree.total == whole(text)


def test_an_edit_reads_a_small_part():
    text = "some ordinary words in a row " * 2000
    tree = token_counts.TokenTree(text, COUNT)
    assert tree.replace(30_000, 30_010, "other") < 3000
    assert tree.total == whole(tree.text())


@pytest.mark.parametrize("words", ["одни простые слова подряд и ещё ", "μερικές απλές λέξεις στη σειρά ", "كلمات عادية في صف واحد ", "いくつかの普通の言葉。続く、", "कुछ साधारण शब्द एक पंक्ति में "])
def test_an_edit_reads_a_small_part_in_other_scripts(words):
    text = words * 2000
    tree = token_counts.TokenTree(text, COUNT)
    assert len(tree.pieces) > len(text) // 600
    assert tree.replace(len(text) // 2, len(text) // 2 + 10, words[:5]) < 3000
    assert tree.total == whole(tree.text())


def test_pieces_are_counted_as_if_encoded_alone():
    encode = token_counts.encoding().encode_ordinary
    for _, text in awkward():
        pieces = token_counts.segments(text or "", 40)
        assert COUNT(pieces) == [len(encode(p)) for p in pieces]


def test_counts_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    got = token_counts.count_tokens(docs, token_counts.standard_edits(docs["text"])).collect()
    assert len(got) == len(awkward())
    texts = dict(awkward())
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == whole(text) and r.n_chars == len(text)
        n = len(text)
        for share, size, new in ((0.25, 10, "[redacted]"), (0.5, 0, " (see note) "), (0.75, 20, "")):
            at = min(int(n * share), len(text))
            text = text[:at] + new + text[at + size :]
        assert r.n_tokens_after == whole(text) and sum(r.segment_tokens) == r.n_tokens_after
    none = documents(spark, [])
    assert token_counts.count_tokens(none, token_counts.standard_edits(none["text"])).collect() == []


def test_stored_trees_take_edits_without_a_full_recount(spark):
    text = "some ordinary words in a row " * 400
    trees = stored(token_counts.token_trees(documents(spark, [(1, text), (2, None), (None, "a b")])), "trees")
    assert {r.doc_id: r.recoded_chars for r in trees.collect()} == {1: len(text), 2: 0, None: 3}
    edit = F.array(F.struct(F.lit(300).cast("long").alias("start"), F.lit(310).cast("long").alias("end"), F.lit("new text").alias("new")))
    got = {r.doc_id: r for r in token_counts.recount(token_counts.recount(trees, edit), edit).collect()}
    for i, before in ((1, text), (2, ""), (None, "a b")):
        for _ in range(2):
            before = before[:300] + "new text" + before[310:]
        assert got[i].text == before and got[i].n_tokens == whole(before) == sum(got[i].segment_tokens)
    assert got[1].recoded_chars < 3000
    with pytest.raises(ValueError):
        token_counts.TokenTree.restored("abc", [2], [1], COUNT)


def test_unmarked_word_ends_are_refused():
    with pytest.raises(ValueError):
        encoded(tokenizing.WordEncoder(tokenizing.load("byte_bpe_50k.json")), ["some words here"])
