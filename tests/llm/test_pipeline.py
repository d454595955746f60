import corpus_pipeline as pipeline
import pytest

from seriesmill.llm.common import stored
from seriesmill.llm.queries import ORACLES, QUERIES

from .helpers import components, documents, prose
from .test_contamination import brute as contaminated
from .test_tokens import brute as encoded


def test_stages_on_their_own_inputs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stored(stage(spark, docs, small), name)
        after = [tuple(r) for r in docs.collect()]
        if name != "token_ids":
            assert docs.columns == columns and set(after) <= set(before) and after
        pairs = [(r[0], r[1]) for r in before]
        if name == "near_duplicates":
            want = {i for i, (n, c) in components(pairs).items() if i == c}
            assert sorted(r[0] for r in after) == sorted(want)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            want = {r[0] for r in contaminated(pairs, items) if not r[-1]}
            assert sorted(r[0] for r in after) == sorted(want)
        elif name == "token_ids":
            assert sorted(after) == sorted(encoded(pairs))
        seen.append((name, len(before), len(after)))
    assert [s[0] for s in seen] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_run_is_the_stages_in_turn(spark, small):
    got = pipeline.run(spark, small)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0


def test_repeated_ids_nulls_and_wordless_rows(spark, small):
    text = " ".join(prose(3, 30))
    rows = [(1, text), (1, text), (2, text + " more"), (3, None), (3, None), (None, text), (4, ""), (5, " ".join(prose(4, 30)))]
    kept = pipeline.near_duplicates(spark, documents(spark, rows), small).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 1, 3, 3, 4, 5]
    assert kept[0].asDict().keys() == documents(spark, []).first().asDict().keys() if documents(spark, []).first() else True
    none = documents(spark, [])
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, small).collect() == [], name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_their_columns(spark, small, name):
    want = {
        "op1": "doc_id n_shingles component_id", "op2": "doc_id held_out score predicted", "op3": "doc_id held_out lang_pred score",
        "op4": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5": "page_id host path rule verdict",
        "op6": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7": "doc_id n_tokens n_tokens_after", "op8": "doc_id start n_tokens ids_crc32",
        "op9": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op10": "doc_id size source_size target taken",
    }[name.split("_")[0]].split()
    got = QUERIES[name](spark, small)
    assert set(want) <= set(got.columns) and got.count() > 0
    assert name in ORACLES or name.split("_")[0] in ("op2", "op3", "op6", "op7", "op8", "op9", "op10")


def test_rows_without_an_id_pass_every_filter(spark, small, tmp_path):
    item = " ".join(prose(70, 40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = " ".join(prose(71, 60))
    rows = [(None, item), (None, clean), (7, item), (7, clean)]
    kept = pipeline.decontamination(spark, documents(spark, rows), str(tmp_path))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(7, clean)]
    assert [r.text for r in kept.collect() if r.doc_id is None] == [clean]

    rows = [(None, clean), (None, clean), (None, clean + " more"), (None, item), (None, ""), (None, ""), (1, clean)]
    kept = pipeline.near_duplicates(spark, documents(spark, rows), small).collect()
    assert [r.text for r in kept if r.doc_id == 1] == [clean]
    unnamed = [r.text for r in kept if r.doc_id is None]
    assert len(unnamed) == 4 and unnamed.count("") == 2 and item in unnamed


def test_copies_without_an_id_are_mixed_each_on_its_own(spark, small):
    rows = [(None, "a b c", None, "s") for _ in range(200)] + [(None, "d e f", None, "t") for _ in range(200)]
    got = [r.source for r in pipeline.mixing(spark, documents(spark, rows), small).collect()]
    # 5 to 2 of 1.5 times 400 rows, at most twice as many as there are
    assert abs(got.count("s") - 400) <= 2 and abs(got.count("t") - 200) <= 2
    rows = [(None, "a b c", None, "s") for _ in range(100)] + [(None, "d e f", None, "t") for _ in range(300)]
    got = [r.source for r in pipeline.mixing(spark, documents(spark, rows), small).collect()]
    assert abs(got.count("s") - 200) <= 2 and abs(got.count("t") - 400) <= 2


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, small):
    a, b, c = sorted(" ".join(prose(k, 40)) for k in (80, 81, 82))
    rows = [(5, a), (5, b), (9, b), (11, c), (11, c), (12, c + " more"), (13, None), (13, a + " end")]
    kept = pipeline.near_duplicates(spark, documents(spark, rows), small).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, a), (5, b), (11, c), (13, None)], key=str)
