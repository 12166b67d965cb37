"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded; ``FILTERS`` learned filters run over chunks of ``2 * STRIDE``
bytes that overlap by half and cover the whole document; each filter's largest
answer is kept, and a logistic unit combines them into one probability.

The network is fitted on the driver on at most ``SAMPLE`` labelled documents of up
to ``SAMPLE_TEXT`` bytes, chosen by a hash of the id.  Only the text is an input.
Empty and null texts are one chunk of padding, and so have a score as well; equal
texts have equal scores.  Texts of any length are pooled ``SLICE`` half chunks at a
time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as V
from tessera.llm.common import mapped, texts_of

SAMPLE = 4000
SAMPLE_TEXT = 1 << 16
SLICE = 1 << 14
EPOCHS = 14
BATCH = 32
EMBEDDING = 8
FILTERS = 48
STRIDE = 16


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = EMBEDDING * STRIDE
        self.embed = r.normal(0, 1, (256, EMBEDDING)).astype(np.float32)
        self.filters = r.normal(0, (2 * d) ** -0.5, (2 * d, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    @staticmethod
    def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half chunks (one row each, texts padded and followed by one empty half), and each text's first."""
        n = np.diff(off)
        halves = np.maximum(-(-n // STRIDE), 1) + 1
        first = np.concatenate([[0], np.cumsum(halves)])
        flat = np.zeros(first[-1] * STRIDE, np.uint8)
        if len(n) == 1:
            flat[: len(data)] = data
        else:
            flat[np.arange(len(data)) + np.repeat(first[:-1] * STRIDE - off[:-1], n)] = data
        return flat.reshape(-1, STRIDE), first

    def answers(self, halves: np.ndarray) -> np.ndarray:
        d = EMBEDDING * STRIDE
        x = self.embed[halves].reshape(len(halves), d)
        return (x[:-1] @ self.filters[:d]) + (x[1:] @ self.filters[d:]) + self.bias

    def pooled(self, halves: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's largest answer of every filter (0 at least)."""
        out = np.zeros((len(first) - 1, FILTERS), np.float32)
        for lo in range(0, len(halves) - 1, SLICE):
            hi = min(lo + SLICE, len(halves) - 1)
            a = self.answers(halves[lo : hi + 1])
            d, e = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi)  # texts with chunks in this slice
            end = first[d + 1 : e + 1] - 1  # the chunk from a text's empty half into the next text
            a[end[end < hi] - lo] = -np.inf
            out[d:e] = np.maximum(out[d:e], np.maximum.reduceat(a, np.maximum(first[d:e], lo) - lo, axis=0))
        return out

    def score(self, block: V.Block) -> np.ndarray:
        p = self.pooled(*self.layout(block.data, block.off))
        return 1 / (1 + np.exp(-(p @ self.out + self.base).astype(float)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
        """Adam on the cross-entropy; a filter learns from the chunk that gave its largest answer."""
        if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
            self.out[:] = 0
            self.base[:] = 0 if not len(labels) else (3 if labels[0] else -3)
            return self
        r = np.random.default_rng(seed)
        d = EMBEDDING * STRIDE
        names = ("embed", "filters", "bias", "out", "base")
        mean = {k: np.zeros_like(getattr(self, k)) for k in names}
        square = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        self.base[:] = np.log(labels.mean() / (1 - labels.mean()))
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
                halves, first = self.layout(np.frombuffer(b"".join(texts[i] for i in pick), np.uint8), off)
                a = np.full((len(halves), FILTERS), -np.inf, np.float32)
                a[:-1] = self.answers(halves)
                a[first[1:] - 1] = -np.inf
                top = np.stack([first[j] + a[first[j] : first[j + 1]].argmax(axis=0) for j in range(len(pick))])
                best = a[top, np.arange(FILTERS)[None, :]]
                pool = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-(pool @ self.out + self.base)))
                g = ((p - labels[pick]) / len(pick)).astype(np.float32)
                back = g[:, None] * self.out[None, :] * (best > 0)
                seen = np.concatenate([halves[top], halves[top + 1]], axis=2)  # texts x filters x bytes of the chunk
                x = self.embed[seen].reshape(len(pick), FILTERS, 2 * d)
                grad = {"out": pool.T @ g, "base": g.sum(keepdims=True), "bias": back.sum(axis=0), "filters": np.einsum("nf,nfd->df", back, x)}
                dx = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBEDDING)
                flat = seen.reshape(-1)
                grad["embed"] = np.stack([np.bincount(flat, weights=dx[:, j], minlength=256) for j in range(EMBEDDING)], axis=1).astype(np.float32)
                grad["filters"] += 1e-4 * self.filters
                step += 1
                rate = 4e-3 * (1 - step / (total + 1))
                for k in names:
                    mean[k] += 0.1 * (grad[k] - mean[k])
                    square[k] += 0.01 * (grad[k] ** 2 - square[k])
                    m, s = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step)
                    getattr(self, k)[...] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Network:
    """Fit on labelled rows whose ``doc_id`` is ``learnable``.

    Rows without a label or text, and documents with labels of both kinds, are left out.
    """
    known = labels.filter(learnable & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.filter(F.octet_length("text") <= SAMPLE_TEXT).select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `known` has `sample` rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * sample).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return Network().fit([r.text.encode() for r in rows], np.array([r.quality for r in rows], np.float32))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size

    def run(batches):
        net = shared.value
        for batch in batches:
            s = [net.score(b) for b in V.blocks(batch.column(1), 1 << 18)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts_of(docs).mapInArrow(V.lean(run), "doc_id long, score double, predicted int")


def keep(docs: DataFrame, network: Network, least: float = 0.5) -> DataFrame:
    """The input's rows and columns whose ``text`` scores at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    place = docs.columns.index("text")

    def run(batches):
        net = shared.value
        for batch in batches:
            s = [net.score(b) for b in V.blocks(batch.column(place), 1 << 18)]
            yield batch.filter(pa.array(np.concatenate(s) >= least)) if s else batch

    return mapped(docs, run)
