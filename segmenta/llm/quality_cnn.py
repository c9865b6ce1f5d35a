"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; ``FILTERS`` learned filters of ``WIDTH`` bytes slide over the whole text.
Their responses are max-pooled over overlapping chunks of ``CHUNK`` bytes (one starts every
``CHUNK / 2``), and the chunks' maxima are combined into one vector, their mean and their maximum,
from which a logistic unit gives the probability of label 1.

Training takes a bounded sample: at most ``train_rows`` labelled rows of the documents at hand
(those with the smallest hash of the id) outside the held-out fold, each as a whole: every chunk of
its text enters every epoch.  So its cost grows with ``train_rows`` and their lengths, not with the
table.  Scoring runs over every byte of every text, block by block.  Only bytes of the text enter;
label, language, source and id never do.

Results for odd input: a null text counts as empty; a text shorter than a filter is filled with zero
bytes, so that empty texts have a score; a null id is not held out and never trained on; rows with
several labels train on the smallest; repeated rows get equal scores; without labels of both kinds
every score is the share of label 1 (0.5 without labels); an empty table gives no rows; other columns
pass through ``keep_good`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from segmenta.llm.common import drop_kept, slices, text_in, text_or_empty

FILTERS = 16
WIDTH = 5
EMBEDDED = 8
CHUNK = 256
HALF = CHUNK // 2
#: Half chunks that are scored at once.
BLOCK = 256
#: Chunks that are trained on at once.
TRAIN_BLOCK = 64
FOLDS = 5
TRAIN_ROWS = 1_500
EPOCHS = 20
BATCH = 16
RATE = 0.01
DECAY = 1e-4


def padded(text: bytes) -> np.ndarray:
    """Bytes filled up so that the filters' positions fall into whole half chunks: the last one
    ends with the text, and begins within the one before."""
    codes = np.frombuffer(text, np.uint8)
    if len(codes) < WIDTH:
        codes = np.concatenate([codes, np.zeros(WIDTH - len(codes), np.uint8)])
    return codes


def _responses(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The filters' responses at every position of ``codes``: (positions, FILTERS)."""
    n = len(codes) - WIDTH + 1
    out = tables[0].take(codes[:n], axis=0)
    for k in range(1, WIDTH):
        out += tables[k].take(codes[k : n + k], axis=0)
    return out


def _half_maxima(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Greatest response of each filter in every half chunk."""
    n = len(codes) - WIDTH + 1
    out = []
    for start in range(0, n, BLOCK * HALF):
        part = _responses(codes[start : min(n, start + BLOCK * HALF) + WIDTH - 1], tables)
        whole = len(part) // HALF * HALF
        if whole:
            out.append(part[:whole].reshape(-1, HALF, FILTERS).max(axis=1))
        if whole < len(part):
            out.append(part[whole:].max(axis=0, keepdims=True))
    return np.concatenate(out)


@dataclass(frozen=True)
class QualityModel:
    """``tables``: the response of each filter tap to each byte; ``prior`` is used alone where
    there was nothing to learn from."""

    tables: np.ndarray | None
    bias: np.ndarray | None
    weights: np.ndarray | None
    offset: float
    prior: float

    def score(self, text: bytes) -> float:
        if self.tables is None:
            return self.prior
        halves = _half_maxima(padded(text), self.tables)
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        active = np.maximum(chunks + self.bias, 0)
        pooled = np.concatenate([active.mean(axis=0), active.max(axis=0)])
        return float(1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.offset, -30, 30))))


# --- training -------------------------------------------------------------------------


class _Adam:
    def __init__(self, values: dict[str, np.ndarray]):
        self.values, self.step = values, 0
        self.first = {k: np.zeros_like(v) for k, v in values.items()}
        self.second = {k: np.zeros_like(v) for k, v in values.items()}

    def update(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            m, v = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.999**self.step)
            self.values[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(self.values[k].dtype)


def _tables(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.einsum("bd,wdf->wbf", p["embedding"], p["filters"]).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> QualityModel:
    """Learns from whole texts: every chunk of every text, in every epoch."""
    prior = float(np.mean(labels)) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return QualityModel(None, None, None, 0.0, prior)
    random = np.random.default_rng(seed)
    p = {
        "embedding": random.normal(0, 1, (256, EMBEDDED)),
        "filters": random.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH, EMBEDDED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weights": random.normal(0, 0.1, 2 * FILTERS),
        "offset": np.array([np.log(prior / (1 - prior))]),
    }
    adam, every = _Adam(p), np.arange(FILTERS)
    samples = [all_chunks(t) for t in texts]
    for epoch in range(EPOCHS):
        order = random.permutation(len(samples))
        for start in range(0, len(order), BATCH):
            batch, tables = order[start : start + BATCH], _tables(p)
            g = {k: np.zeros_like(v) for k, v in p.items()}
            slots, amounts = [], []
            for i in batch:
                chunks = samples[i]
                where, top = [], []
                for block in range(0, len(chunks), TRAIN_BLOCK):
                    z = _responses(chunks[block : block + TRAIN_BLOCK].T.copy(), tables)  # (positions, chunks, filters)
                    at = z.argmax(axis=0)
                    where.append(at)
                    top.append(np.take_along_axis(z, at[None], 0)[0])
                where, top = np.concatenate(where), np.concatenate(top) + p["bias"]
                active = np.maximum(top, 0)
                best = active.argmax(axis=0)
                pooled = np.concatenate([active.mean(axis=0), active[best, every]])
                error = 1 / (1 + np.exp(-np.clip(pooled @ p["weights"] + p["offset"][0], -30, 30))) - labels[i]
                error /= len(batch)
                g["weights"] += error * pooled
                g["offset"] += error
                back = np.repeat(error * p["weights"][None, :FILTERS] / len(chunks), len(chunks), axis=0)
                back[best, every] += error * p["weights"][FILTERS:]
                back *= top > 0
                g["bias"] += back.sum(axis=0)
                rows = np.arange(len(chunks))[:, None]
                for k in range(WIDTH):
                    slots.append(((k * 256 + chunks[rows, where + k].astype(np.int64)) * FILTERS + every).ravel())
                    amounts.append(back.ravel())
            size = WIDTH * 256 * FILTERS
            by_tap = np.bincount(np.concatenate(slots), np.concatenate(amounts), size).reshape(WIDTH, 256, FILTERS)
            g["embedding"] = np.einsum("wbf,wdf->bd", by_tap, p["filters"]) + DECAY * p["embedding"]
            g["filters"] = np.einsum("wbf,bd->wdf", by_tap, p["embedding"]) + DECAY * p["filters"]
            g["weights"] += DECAY * p["weights"]
            adam.update(g, RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)))
    return QualityModel(_tables(p), p["bias"].astype(np.float32), p["weights"], float(p["offset"][0]), prior)


def all_chunks(text: bytes) -> np.ndarray:
    """All chunks of the text, a half apart; the last one ends with the text.  A chunk is as wide
    as the text where that is shorter than a chunk."""
    codes = padded(text)
    width = min(len(codes), CHUNK + WIDTH - 1)
    chunks = np.lib.stride_tricks.sliding_window_view(codes, width)
    starts = np.arange(0, len(chunks), HALF)
    if starts[-1] + width < len(codes):
        starts = np.append(starts, len(codes) - width)
    return chunks[starts]


def held_out_fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learns from the whole texts of a sample of ``train_rows`` of those rows of ``docs`` that are
    labelled and outside the held-out fold."""
    known = labels.where(~held_out_fold() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # Drawn from ids alone; at most train_rows narrow rows are broadcast.
    drawn = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    labelled = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    # Repeated ids may bring more rows than were drawn.
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(train_rows).collect()
    return train([r.text.encode() for r in rows], np.array([r.quality for r in rows], np.float64))


def with_score(docs: DataFrame, model: QualityModel, column: str, row: str | None = None) -> DataFrame:
    """``docs`` with the score of ``text``, a column or a field of the struct ``row``, in ``column``."""
    names = docs.columns if row is None else docs.schema[row].dataType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in slices(batches):
            scores = [model.score((t.as_py() or "").encode()) for t in text_in(batch, row, names)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, train_rows), "score")
    return scored.select(
        "doc_id",
        F.coalesce(held_out_fold(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    scored = with_score(rows, fit(docs, labels, train_rows), "score", "doc")
    return scored.where(F.col("score") >= threshold).select("doc.*")
