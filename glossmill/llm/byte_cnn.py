"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become vectors; learned filters slide over overlapping chunks that together cover the whole text; the largest
answer of each filter anywhere in the text goes into one probability. Only the labels are sampled for fitting
(``per_class`` documents of each label, of at most ``longest`` bytes); every document is scored on all of its bytes.

Labels are learned only from documents whose crc32(doc_id as text) mod 3 is not 1. With labels of one kind only, all
scores are that label's share of 1; without labels they are 0.5. Null and empty texts are a single zero chunk.
Repeated rows get equal scores. Other columns of the documents pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossmill.llm.common import appended, column, stored, table

WIDTH, STRIDE, VECTOR, FILTERS = 16, 4, 8, 32
CHUNK = 1 << 13


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Network:
    vectors: np.ndarray  # 256 bytes and the filling behind the end
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Filter x window, for the overlapping windows of a chunk of byte numbers."""
        rows = self.vectors.take(data, axis=0)
        n = (data.size - WIDTH) // STRIDE + 1
        windows = np.lib.stride_tricks.as_strided(
            rows, (n, WIDTH * VECTOR), (STRIDE * VECTOR * rows.itemsize, rows.itemsize), writeable=False)
        return self.filters.T @ np.ascontiguousarray(windows).T

    def pooled(self, text: bytes) -> np.ndarray:
        """Largest answer of each filter over the whole text."""
        data, best = numbers(text), np.full(FILTERS, -np.inf, np.float32)
        for at in range(0, data.size - WIDTH + 1, CHUNK):
            best = np.maximum(best, self.answers(data[at : at + CHUNK + WIDTH - STRIDE]).max(axis=1))
        return np.maximum(best + self.bias, 0)

    def pooled_places(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the place of the window that gave it."""
        data = numbers(text)
        best, place = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for at in range(0, data.size - WIDTH + 1, CHUNK):
            answers = self.answers(data[at : at + CHUNK + WIDTH - STRIDE])
            where = answers.argmax(axis=1)
            top = answers[np.arange(FILTERS), where]
            place = np.where(top > best, at + where * STRIDE, place)
            best = np.maximum(best, top)
        return np.maximum(best + self.bias, 0), place

    def score(self, text: bytes) -> float:
        z = float(self.pooled(text) @ self.weights + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def numbers(text: bytes) -> np.ndarray:
    """Byte numbers, filled up with 256 so that whole windows cover the last byte."""
    size = max(WIDTH, WIDTH + -(-(len(text) - WIDTH) // STRIDE) * STRIDE)
    out = np.full(size, 256, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def fit(texts: list[bytes], labels: list[int], epochs: int = 5, batch: int = 16, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on the log loss, classes weighted equally. Only the window that answers most strongly passes a gradient."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32),
        rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, FILTERS ** -0.5, FILTERS).astype(np.float32), 0.0)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if y.size else 0.5
    if not y.size or not 0 < share < 1:
        net.weights[:] = 0
        net.offset = (share - 0.5) * 100
        return net
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    parts = ["vectors", "filters", "bias", "weights", "offset"]
    mean = {p: np.zeros_like(np.asarray(getattr(net, p), np.float32)) for p in parts}
    square = {p: np.zeros_like(mean[p]) for p in parts}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(y.size)
        for at in range(0, y.size, batch):
            step += 1
            grad = {p: np.zeros_like(mean[p]) for p in parts}
            chosen = order[at : at + batch]
            for i in chosen:
                top, place = net.pooled_places(texts[i])
                p = 1 / (1 + np.exp(-np.clip(float(top @ net.weights + net.offset), -50, 50)))
                d = np.float32((p - y[i]) * weight[i] / chosen.size)
                back = d * net.weights * (top > 0)
                seen = numbers(texts[i])[place[:, None] + np.arange(WIDTH)]  # filter, place in window
                grad["weights"] += d * top
                grad["offset"] += d
                grad["bias"] += back
                grad["filters"] += net.vectors[seen].reshape(FILTERS, -1).T * back
                np.add.at(grad["vectors"], seen, (net.filters.T * back[:, None]).reshape(FILTERS, WIDTH, VECTOR))
            for p in parts:
                mean[p] = 0.9 * mean[p] + 0.1 * grad[p]
                square[p] = 0.999 * square[p] + 0.001 * grad[p] ** 2
                move = rate * (mean[p] / (1 - 0.9**step)) / (np.sqrt(square[p] / (1 - 0.999**step)) + 1e-8)
                setattr(net, p, np.asarray(getattr(net, p) - move, np.float32) if p != "offset" else float(net.offset - move))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> DataFrame:
    """doc_id, text and quality of ``per_class`` labelled documents of each kind, or all there are; the same in every run.

    Drawn from the documents that can be learned from: those with a label, held in ``docs``, of at most ``longest`` bytes.
    A document counts once, however often its row or its label is there; of several texts the smallest is learned.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).select("doc_id", "quality").distinct()
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest)
    there = stored(marked.join(short.select("doc_id"), "doc_id", "left_semi"), "labelled")
    drawn = None
    for kind in (0, 1):
        some = there.filter(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    # Two limits bound the broadcast side.
    texts = short.join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fitted_in_task(sample: DataFrame, columns: list[str], fit_rows: Callable) -> object:
    """What ``fit_rows`` makes of the sorted rows of a bounded sample, worked out in one task."""

    def run(batches):
        rows = sorted(tuple(r[c] for c in columns) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(rows))], pa.binary())], ["model"])

    # Of a sample known to be empty, Spark runs no task.
    model = sample.select(*columns).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model[0]) if model else fit_rows([])


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 800, longest: int = 1 << 15) -> DataFrame:
    """docs with held_out, score and predicted.

    The network learns from equal numbers of both labels; its offset then follows their shares among all labels.
    """
    sample = labelled_sample(docs, labels, per_class, longest)
    net = fitted_in_task(sample, ["doc_id", "text", "quality"], lambda rows: fit([r[1].encode() for r in rows], [r[2] for r in rows]))
    sizes = {r["quality"]: r["count"] for r in labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy("quality").count().collect()}
    if len(sizes) == 2:
        net.offset += float(np.log(sizes[1] / sizes[0]))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(rows):
        net = shared.value
        for batch in rows:
            yield batch, {"score": [net.score(t.as_py() or b"") for t in column(batch, "text").cast(pa.binary())]}

    scored = appended(docs, {"score": ("double", pa.float64())}, run)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).drop("text")
