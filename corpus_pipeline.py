"""The corpus pipeline: its stages, in order, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir), with docs the rows that the stage before wrote,
and all but the last return the columns of documents. As a stage starts on written rows,
it deletes the scratch tables of the stage that was called before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.common import columns, drop_scratch, scratch_made, stored
from seriesmill.llm.contamination import drop_contaminated
from seriesmill.llm.mixing import mix_sources
from seriesmill.llm.ngram_join import jaccard_components
from seriesmill.llm.token_orc import tokens_digest
from seriesmill.llm.toxicity import drop_toxic, fit_toxicity, labelled_rows


_of_last_stage: list[str] = []


def _stage(function):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, _of_last_stage)
        before = len(scratch_made())
        out = function(spark, docs, sf_dir)
        _of_last_stage[:] = scratch_made(before)
        return out

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text scores 0.3 or more, by a model of the labels' rows."""
    labels = columns(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic")
    model = fit_toxicity(labelled_rows(columns(docs, "doc_id", "text"), labels))
    return drop_toxic(docs, model)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row_id, row) of every row: a unique number, stored so that it stays with its row,
    and the row's own columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    return stored(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*own).alias("row")), name)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked texts, keeps the row of the least id (of several, that with
    the least hash of its text) and drops the others, row by row. Rows without an id are
    each other's copies, and one of a class stays, beside the one that has an id. Rows
    without words are no one's copies."""
    rows = _numbered(docs, "numbered")
    found = jaccard_components(rows.select("row_id", F.col("row.text").alias("text")), "row_id").where("n_shingles > 0")
    named = rows.select("row_id", F.col("row.doc_id").alias("named"), F.xxhash64("row.text").alias("hash"))
    classed = stored(found.select(F.col("doc_id").alias("row_id"), "component_id").join(named, "row_id"), "classed-rows")
    first = classed.groupBy("component_id", F.col("named").isNull()).agg(F.min(F.struct("named", "hash", "row_id")).alias("first")).select("first.row_id")
    dropped = stored(classed.join(first, "row_id", "left_anti").select("row_id"), "dropped")
    return rows.join(dropped, "row_id", "left_anti").select("row.*")


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows, each by its own text."""
    benchmark = columns(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return drop_contaminated(docs, benchmark)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix does: not at all, once or twice. Draws go by a
    hash of id and text, so that they don't depend on the order of rows."""
    rows = _numbered(docs, "to-mix")
    key = F.xxhash64("row.doc_id", "row.text")
    taken = mix_sources(rows.select(key.alias("doc_id"), "row.text", "row.source", "row_id"), row_col="row_id")
    copies = taken.where("size > 0 and taken > 0").select("row_id", (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    return rows.join(copies, "row_id").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids as ORC files and returns what these say of each row."""
    return tokens_digest(columns(docs, "doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: No SQL expresses trained trees or balanced sampling; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as written. A stage's rows are deleted once the next one's
    are written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(spark, written)
        written = scratch_made()[-1:]
    drop_scratch(spark, _of_last_stage)
    return docs
