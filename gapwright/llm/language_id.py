"""Operator 7: language identification from averaged hashed subword embeddings.

A text's features are its 2- to 4-byte n-grams, case-folded in ASCII, hashed into buckets. Their
embeddings are averaged and a linear softmax gives the languages. Both are trained by stochastic
gradient descent in numpy on a bounded sample; a temperature fitted on rows kept out of the descent
calibrates the probability, and a threshold from the same rows marks what to reject.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null label is not
learned; without any label every text is ``und``; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import lowest_hashes
from .storage import table
from .textkernel import LOWER, buffers, slices

#: labelled texts from which the model is learned, at most; the lowest hashes of their ids
MAX_LABELLED = 3_000
BUCKETS_LOG2, DIMENSIONS, EPOCHS, RATE = 15, 12, 4, 0.5
ORDERS = (2, 3, 4)
#: share of right answers that the accepted rows of the calibration set must reach
TARGET_PRECISION = 0.99
FOLDS, HELD_OUT = 5, 0
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def subwords(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket numbers of the n-grams that start in each text, an array an order; and the text's n + 1 offsets into each.

    A text is followed by spaces, so its last n-grams don't reach into the next.
    """
    n, pad = len(off) - 1, max(ORDERS)
    at = off + np.arange(n + 1) * pad
    buffer = np.full(int(at[-1]) + pad, 0x20, np.uint8)
    if n:
        inner = np.repeat(np.arange(n) * pad, np.diff(off)) + np.arange(len(raw))
        buffer[inner] = LOWER[raw]
    b = buffer.astype(np.uint32)
    size = int(at[-1])
    grams, acc = [], b[: size + pad - 1]
    for order in range(2, pad + 1):
        acc = (acc[: size + pad - order] << np.uint32(8)) | b[order - 1 : size + pad - 1 + 1][: size + pad - order]
        if order in ORDERS:
            h = acc[:size] * np.uint32(_MULTIPLIERS[order])
            grams.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKETS_LOG2))
    return grams, at


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # logits of each bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        grams, at = subwords(raw, off)
        total = sum(np.add.reduceat(self.table[g], at[:-1], axis=0) for g in grams)
        return total / (np.diff(at)[:, None] * len(grams)) + self.bias

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its calibrated probability, of each text."""
        p = softmax(self.logits(raw, off) / self.temperature)
        best = p.argmax(axis=1)
        return best, np.clip(p[np.arange(len(best)), best], 0.0, 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct buckets of a text's subwords, and how often each occurs."""
    raw = np.frombuffer(text.encode(), np.uint8)
    grams, _ = subwords(raw, np.array([0, len(raw)]))
    return np.unique(np.concatenate(grams), return_counts=True)


def train(grams: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel | None:
    """Learns from rows of ``bucket_counts`` in order; every fifth is kept for the calibration."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    y = np.searchsorted(np.array(languages), np.array(labels))
    kept = np.arange(len(grams)) % 5 == 4
    emb = rng.normal(0, 0.1, (1 << BUCKETS_LOG2, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    rows = np.flatnonzero(~kept)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(rows):
            ids, count = grams[r]
            share = count / count.sum()
            mean = share @ emb[ids]
            p = softmax((mean @ weights + bias)[None])[0]
            p[y[r]] -= 1.0
            rate = RATE * (1 - step / steps)
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # the step of a bucket is scaled up: one text moves thousands of them a little
            emb[ids] -= (rate * 50.0) * share[:, None] * back
            step += 1
    flat = (emb @ weights).astype(np.float32)
    held = np.flatnonzero(kept) if kept.any() else rows
    z = np.stack([(grams[r][1] / grams[r][1].sum()) @ flat[grams[r][0]] + bias for r in held])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = softmax(z / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    order = np.argsort(-score)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= TARGET_PRECISION)
    threshold = float(score[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, flat, bias.astype(np.float32), float(temperature), threshold)


def learn(docs: DataFrame, most: int = MAX_LABELLED) -> LanguageModel | None:
    """The driver gets no texts but their counts of at most 2 ** BUCKETS_LOG2 buckets."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    # one that is null or has no letter teaches nothing
    chosen = lowest_hashes(usable.select("doc_id", "text", "lang"), most, "doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket_counts(t) for t in batch.column("text").to_pylist()]
            blobs = [pa.array([x.astype("<u4").tobytes() for x in side], pa.binary()) for side in (zip(*found, strict=True) if found else ((), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *blobs], ["lang", "ids", "counts"])

    rows = chosen.select("text", "lang").mapInArrow(count, "lang string, ids binary, counts binary").collect()
    return train([(np.frombuffer(r.ids, "<u4"), np.frombuffer(r.counts, "<u4")) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score and rejected (the score is below the model's threshold)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            for a, b in slices(off, 1 << 18):
                best[a:b], score[a:b] = m.predict(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            none = np.asarray(batch.column("text").is_null())
            best[none], score[none] = len(m.languages), 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array((score < m.threshold) | none)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs))
