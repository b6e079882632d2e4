"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks that overlap by one filter width less a byte, so that every
window of the whole text lies in exactly one chunk. Learned filters slide over the bytes; each
chunk keeps the largest response of each filter, and the mean and the maximum over the chunks are
combined into one probability. Training reads a sample bounded in rows (``per_class`` labelled
documents of each class); both training and scoring read whole texts.

Nulls and odd rows: a null or empty text is one chunk of padding and gets a score; a null label or a
null ``doc_id`` is not learned from; of several labels of one document the majority holds (a tie is
good); without labels of both classes the score is the share of good ones (0.5 without any);
repeated rows get equal scores; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 6
FILTERS = 16
CHUNK = 256
PAD = 256
THRESHOLD = 0.3
PER_CLASS = 1200
PIECE = 512
RESULTS = ["held_out", "score", "predicted"]


@dataclass
class Network:
    """Filters (place, byte, filter), their bias, and the weights of mean and maximum."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """The filters' responses to every window of ``data`` (bytes or PAD as numbers)."""
        n = len(data) - WIDTH + 1
        out = self.filters[0][data[:n]]
        for place in range(1, WIDTH):
            out += self.filters[place][data[place : place + n]]
        return out

    def probability(self, pooled_mean: np.ndarray, pooled_max: np.ndarray) -> np.ndarray:
        z = np.concatenate([pooled_mean, pooled_max], axis=1).astype(np.float64) @ self.weights + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def score(self, texts: list[str | None], block: int = 1 << 18) -> np.ndarray:
        """One probability per whole text; at most about ``block`` bytes are expanded at once."""
        sums = np.zeros((len(texts), FILTERS))
        tops = np.zeros((len(texts), FILTERS), dtype=np.float32)
        chunks = np.zeros(len(texts))
        step = CHUNK - WIDTH + 1
        pieces, owners, starts, at = [], [], [], 0

        def flush() -> None:
            nonlocal pieces, owners, starts, at
            if pieces:
                pooled = np.maximum.reduceat(self.responses(np.concatenate(pieces)), starts, axis=0)
                pooled = np.maximum(pooled + self.bias, 0)
                own = np.array(owners)
                pooled, own = pooled[own >= 0], own[own >= 0]
                np.add.at(sums, own, pooled)
                np.maximum.at(tops, own, pooled)
                chunks[:] += np.bincount(own, minlength=len(texts))
            pieces, owners, starts, at = [], [], [], 0

        gap = np.full(WIDTH - 1, PAD, dtype=np.int32)
        for i, text in enumerate(texts):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int32)
            if not len(data):
                data = np.full(1, PAD, dtype=np.int32)
            for begin in range(0, len(data), step * 1024):
                # the windows that start in this part, with the bytes they reach into
                part = data[begin : begin + step * 1024 + WIDTH - 1]
                windows = min(step * 1024, len(data) - begin)
                part = np.concatenate([part, gap[: max(0, windows + WIDTH - 1 - len(part))]])
                places = range(at, at + windows, step)
                starts.extend(places)
                owners.extend([i] * len(places))
                # windows that start in the tail belong to no chunk
                starts.append(at + windows)
                owners.append(-1)
                pieces.append(part)
                at += len(part)
                if at >= block:
                    pieces.append(gap)
                    flush()
        if pieces:
            pieces.append(gap)
        flush()
        return self.probability(sums / np.maximum(chunks, 1)[:, None], tops)


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    zeros = np.zeros((WIDTH, PAD + 1, FILTERS), dtype=np.float32)
    return Network(zeros, np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))


def train(samples: list[tuple[list[bytes], int]], good_share: float, epochs: int = 6, seed: int = 7) -> Network:
    """Fit on (chunks, label) of documents, in mini-batches by Adam; classes count as in the corpus."""
    rng = np.random.default_rng(seed)
    net = constant(0.5)
    net.filters[:, :PAD] = rng.normal(0, 0.3, (WIDTH, PAD, FILTERS))
    net.weights = rng.normal(0, 0.3, 2 * FILTERS)
    labels = np.array([y for _, y in samples], dtype=np.float64)
    prior = np.where(labels == 1, good_share / max(labels.mean(), 1e-9), (1 - good_share) / max(1 - labels.mean(), 1e-9))
    state = [[np.zeros_like(np.atleast_1d(x), dtype=np.float64) for _ in range(2)] for x in (net.filters, net.bias, net.weights, net.offset)]
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 32):
            docs = order[at : at + 32]
            chunks = [c for d in docs for c in samples[d][0]]
            counts = np.array([len(samples[d][0]) for d in docs])
            begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
            block = np.full((len(chunks), CHUNK), PAD, dtype=np.int16)
            for row, chunk in zip(block, chunks):
                row[: len(chunk)] = np.frombuffer(chunk, dtype=np.uint8)
            windows = CHUNK - WIDTH + 1
            best = np.empty((len(chunks), FILTERS), dtype=np.int64)
            peak = np.empty((len(chunks), FILTERS), dtype=np.float32)
            for piece in range(0, len(chunks), PIECE):  # long texts expand piece by piece
                part = block[piece : piece + PIECE]
                response = net.filters[0][part[:, :windows]]
                for place in range(1, WIDTH):
                    response += net.filters[place][part[:, place : place + windows]]
                # windows wholly in the padding after a text's end are no windows
                response[part[:, :windows] == PAD] = -1e9
                response[:, 0] = np.maximum(response[:, 0], -1e8)
                best[piece : piece + PIECE] = response.argmax(axis=1)
                peak[piece : piece + PIECE] = response.max(axis=1) + net.bias
            pooled = np.maximum(peak, 0)
            mean = np.add.reduceat(pooled, begins, axis=0) / counts[:, None]
            top = np.maximum.reduceat(pooled, begins, axis=0)
            p = net.probability(mean, top)
            d_z = (p - labels[docs]) * prior[docs] / len(docs)
            joined = np.concatenate([mean, top], axis=1)
            d_weights, d_offset = joined.T @ d_z, np.array([d_z.sum()])
            d_mean, d_top = np.outer(d_z, net.weights[:FILTERS]), np.outer(d_z, net.weights[FILTERS:])
            own = np.repeat(np.arange(len(docs)), counts)
            d_pooled = d_mean[own] / counts[own][:, None] + np.where(pooled == top[own], d_top[own], 0)
            d_pooled *= peak > 0
            d_filters = np.zeros_like(net.filters, dtype=np.float64)
            r, f = np.nonzero(d_pooled)
            for place in range(WIDTH):
                np.add.at(d_filters[place], (block[r, best[r, f] + place], f), d_pooled[r, f])
            d_filters[:, PAD] = 0
            steps += 1
            moved = []
            for value, grad, (m, v) in zip((net.filters, net.bias, net.weights, net.offset), (d_filters, d_pooled.sum(axis=0), d_weights, d_offset), state):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                moved.append(value - 0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8))
            net = Network(moved[0].astype(np.float32), moved[1].astype(np.float32), moved[2], float(moved[3][0]))
    return net


def remainder(doc_id: Column, by: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % by


def _cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All chunks of each text."""
    step = CHUNK - WIDTH + 1
    for series in texts:
        out = []
        for text in series:
            data = (text or "").encode("utf-8", "surrogatepass")
            out.append([data[k : k + CHUNK] for k in range(0, max(1, len(data)), step)])
        yield pd.Series(out)


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0, per_class: int = PER_CLASS) -> Network:
    """Train on the labelled documents outside fold ``fold`` with the smallest hashed ids."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(remainder(F.col("doc_id")) != fold)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    by_hash = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id"]
    picked = [known.filter(F.col("label") == y).orderBy(*by_hash).limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids: small whatever the corpus
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    cut = F.pandas_udf(_cut, "array<binary>")
    rows = sample.groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("doc_id", "label", cut("text").alias("chunks")).collect()
    rows.sort(key=lambda r: r.doc_id)
    found = {y: [r for r in rows if r.label == y] for y in (0, 1)}
    total = sum(sizes.values())
    if not (found[0] and found[1]):
        return constant(sizes.get(1, 0) / total if total else 0.5)
    return train([([bytes(c) for c in r.chunks], r.label) for r in rows], sizes.get(1, 0) / total)


def classify(docs: DataFrame, net: Network, threshold: float = THRESHOLD, fold: int = 0) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; no shuffle."""

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(net.score(list(series)))

    score = F.pandas_udf(scores, "double")
    return (
        docs.drop(*RESULTS)
        .withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == fold, F.lit(False)))
        .withColumn("score", score("text"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
