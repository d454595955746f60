"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of 1 to 4 (presence, hashed to 16,384 places);
the kernel of two texts is the size of the shared set over the geometric mean of their
sizes. Nyström landmarks span the feature space, one-versus-rest kernel ridge regression
learns in it, and texts are scored by products of whole batches: presence times
landmarks, then times the solved weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, held_out, mix, text_chunks

SAMPLE_ROWS, LANDMARKS, PLACES, LONGEST = 4_000, 128, 1 << 14, 4
#: Rows of a language at least, as far as it has them, however many languages there are.
LEAST_ROWS = 4
#: Hashes of texts by which the sample is cut.
SPACE = 1 << 40
_FACTORS = mix(np.arange(1, LONGEST + 1, dtype=U64)) | U64(1)


def _fold_table() -> np.ndarray:
    """Bytes lower-cased, everything between words one blank."""
    table = np.full(256, 32)
    table[65:91] = np.arange(97, 123)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table.astype(np.uint8)


_FOLD = _fold_table()


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, PLACES), np.float32)
    if len(data) == 0:
        return out
    folded = _FOLD[data]
    # capitals of Latin-1 letters follow a byte of 0xC3
    after = np.flatnonzero((folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] < 0x9F)) + 1
    folded[after] += 0x20
    folded = folded.astype(np.uint32)
    base = np.repeat(np.arange(n, dtype=np.int64) * PLACES, np.diff(offsets))
    flat = out.reshape(-1)
    key = np.zeros(len(data), np.uint32)
    for size in range(1, LONGEST + 1):
        if len(data) < size:
            break
        key = (key[: len(data) - size + 1] if size == 1 else key[:-1]) + (folded[size - 1 :] << np.uint32(8 * (size - 1)))
        inside = base[size - 1 :] == base[: len(key)]
        place = ((key * np.uint32(int(_FACTORS[size - 1]) & 0xFFFFFFFF)) >> np.uint32(18)).astype(np.int64)
        flat[(base[: len(key)] + place)[inside]] = 1
    return out


class LanguageModel:
    def __init__(self, names: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.names, self.landmarks, self.weights = names, landmarks, weights

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = x.sum(axis=1)
        return (x @ self.landmarks.T) / np.sqrt(np.maximum(size, 1))[:, None]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One row a text, one score of 0 to 1 a language."""
        margin = np.exp(6 * np.clip(self.kernel(x) @ self.weights, -3, 3))
        return margin / margin.sum(axis=1, keepdims=True)


def fit_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> LanguageModel | None:
    """A model of distinct texts of ``docs`` (doc_id, text, lang): of each language the
    ``sample_rows // languages`` (``LEAST_ROWS`` at least) whose hashes are least, all if it
    has fewer, however often each is repeated. Rows that are held out or lack a text or
    lang are left out. It knows every language of the other rows: with many, landmarks
    grow to one a language. No more than that share of any language reaches the driver.
    None if there are no rows."""
    place = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SPACE)).alias("place")
    rows = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", place)
    counts = {r["lang"]: (r["texts"], r["least"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("texts"), F.min("place").alias("least")).collect()}
    if not counts:
        return None
    names = sorted(counts)
    each = max(LEAST_ROWS, sample_rows // len(names))
    # a cut that lets some four times as many pass as are wanted, and always the least
    shares = [(k, max(min(SPACE, 4 * each * SPACE // max(counts[k][0], 1)), counts[k][1] + 1)) for k in names]
    near = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long")), "lang").where("place < share")
    texts = near.groupBy("lang", "place").agg(F.min("text").alias("text"))
    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
    sample = ranked.where(F.col("rank") <= each).select("lang", "text", "place").orderBy("lang", "place").select("lang", "text")

    def features(batches):
        for batch in batches:
            parts = [np.packbits(presence(data, offsets).astype(np.uint8), axis=1) for _, data, offsets in text_chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for p in parts for r in p], pa.binary())], ["lang", "x"])

    found = sample.mapInArrow(features, "lang string, x binary").toPandas()  # bounded by sample_rows, 2 KB each
    x = np.unpackbits(np.frombuffer(b"".join(found["x"]), np.uint8).reshape(len(found), -1), axis=1).astype(np.float32)
    y = found["lang"].to_numpy()
    chosen = np.concatenate([np.flatnonzero(y == k)[: max(1, landmarks // len(names))] for k in names if (y == k).any()])
    marks = x[chosen] / np.sqrt(np.maximum(x[chosen].sum(axis=1), 1))[:, None]
    model = LanguageModel(names, marks, np.zeros((len(chosen), len(names))))
    inner = model.kernel(x[chosen]).astype(float)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # to Nyström coordinates
    z = model.kernel(x).astype(float) @ root
    target = np.where(y[:, None] == np.array(names)[None, :], 1.0, -1.0)
    balance = 1.0 / np.array([(y == k).sum() for k in y])[:, None]
    solved = np.linalg.solve(z.T @ (z * balance) + ridge * len(names) / z.shape[1] * np.eye(z.shape[1]), z.T @ (target * balance))
    model.weights = root @ solved
    return model


def _predict(model: LanguageModel):
    def run(batches):
        names = np.array(model.names)
        for batch in batches:
            best, score = [], []
            for _, data, offsets in text_chunks(batch.column(3)):
                for k in range(0, len(offsets) - 1, 256):
                    part = offsets[k : k + 257]
                    p = model.scores(presence(data[part[0] : part[-1]], part - part[0]))
                    at = p.argmax(axis=1)
                    best.append(names[at])
                    score.append(p[np.arange(len(p)), at])
            named = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            lang = np.where(named, np.concatenate(best), "und") if best else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(np.where(named, np.concatenate(score), 0.0) if score else [], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for every row of ``docs`` (doc_id,
    text). Null texts, and texts without a letter, are ``und`` with score 0, and so is
    all without a model. Repeated rows are predicted each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
