"""Quality classifier: a byte-level convolutional network in numpy.

A byte becomes a fixed vector of its kind and some fixed random features. Filters are learned over windows of WIDTH
bytes that start every STRIDE bytes. Activations are max-pooled over chunks of CHUNK bytes that overlap by half and
cover the whole document; the mean and the maximum over the chunks go through a logistic layer to one probability.

Fitting reads whole texts of a bounded sample of labelled rows: in the order of a hash of the id, at most SAMPLE rows,
each of them unless it would bring the sample's bytes above SAMPLE_BYTES. Scoring reads every byte of every text. Both
go through a text in stretches of one grid, of BUDGET bytes about, which bounds memory and changes no result.

Results for odd input: null and empty texts are one chunk of zero bytes and get that chunk's probability; without
both labels in the sample every score is near the share of label 1 (smoothed by 0.001; 0.5 without any label); repeated
rows score alike; a label counts once however many rows have its id, with the text of the least hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import written
from .common import hash_sample, map_batches

WIDTH, STRIDE, CHUNK, FILTERS = 8, 4, 512, 32
HALF = CHUNK // 2
WINDOWS = HALF // STRIDE
SAMPLE, SAMPLE_BYTES = 3_000, 32_000_000
EPOCHS, BATCH, RATE = 8, 48, 0.004
#: Bytes that the network holds at once.
BUDGET = 1_000_000


def byte_vectors() -> np.ndarray:
    """256 by 12: kinds of bytes, and random signs."""
    b = np.arange(256)
    kinds = [
        (b >= 97) & (b <= 122),
        (b >= 65) & (b <= 90),
        (b >= 48) & (b <= 57),
        b == 32,
        b == 10,
        (b > 32) & (b < 127) & ~((b >= 97) & (b <= 122)) & ~((b >= 65) & (b <= 90)) & ~((b >= 48) & (b <= 57)),
        b >= 128,
    ]
    signs = np.random.default_rng(5).choice([-0.5, 0.5], (256, 5))
    out = np.concatenate([np.array(kinds, float).T, signs], axis=1)
    out[0] = 0
    return out.astype(np.float32)


VECTORS = byte_vectors()


def _halves(text: bytes) -> int:
    return (len(text) + WIDTH) // HALF + 1


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each with zero bytes after it up to whole half-chunks, and each one's half-chunks.

    Eight zero bytes at least follow each text, so a text's last window, which would reach into the next one, is blank.
    """
    halves = np.array([_halves(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(int(n) * HALF, b"\0") for t, n in zip(texts, halves, strict=True)), np.uint8), halves


def windows(flat: np.ndarray, n: int) -> np.ndarray:
    """The first n windows: a row of WIDTH byte vectors for every STRIDE bytes. Zero bytes follow the end."""
    steps = VECTORS[np.r_[flat, np.zeros(n * STRIDE + WIDTH - STRIDE - len(flat), np.uint8)]].reshape(-1)
    d = VECTORS.shape[1]
    return np.lib.stride_tricks.as_strided(steps, (n, WIDTH * d), (steps.strides[0] * STRIDE * d, steps.strides[0]))


@dataclass
class Network:
    filters: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def tops(self, flat: np.ndarray, halves: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """For each half-chunk and filter the greatest activation and, if asked, its window. Last, blank windows count 0."""
        top = np.empty((len(flat) // HALF, self.filters.shape[1]), np.float32)
        place = np.empty(top.shape, np.uint8) if places else None
        last = np.cumsum(halves) - 1
        step = max(BUDGET // HALF, 1)
        for a in range(0, len(top), step):
            b = min(a + step, len(top))
            # the last window of a stretch reads on into the next one
            out = np.ascontiguousarray(windows(flat[a * HALF : b * HALF + WIDTH - STRIDE], (b - a) * WINDOWS)) @ self.filters
            out += self.shift
            np.maximum(out, 0, out=out)
            out = out.reshape(-1, WINDOWS, self.filters.shape[1])
            out[last[np.searchsorted(last, a) : np.searchsorted(last, b)] - a, -1] = 0
            if places:
                place[a:b] = out.argmax(axis=1)
                top[a:b] = np.take_along_axis(out, place[a:b, None].astype(np.int64), 1)[:, 0]
            else:
                top[a:b] = out.max(axis=1)
        return top, place

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum over the chunks, for each text."""
        out = np.zeros((len(texts), 2 * self.filters.shape[1]))
        for run in _runs(texts):
            flat, halves = layout(texts[run])
            out[run] = np.concatenate(chunk_means(self.tops(flat, halves)[0], halves), axis=1)
        return out

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(texts) @ self.weights + self.bias)))


def _runs(texts: list[bytes]):
    """Slices of consecutive texts within BUDGET bytes together; a longer text is alone in its slice."""
    start = total = 0
    for i, t in enumerate(texts):
        if start < i and total + len(t) > BUDGET:
            yield slice(start, i)
            start, total = i, 0
        total += len(t) + HALF
    if start < len(texts):
        yield slice(start, len(texts))


def chunk_means(top: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over each text's chunks, which are pairs of neighbouring half-chunks, or its only half-chunk."""
    last = np.cumsum(halves) - 1
    pair = top.copy()
    pair[:-1] = np.maximum(top[:-1], top[1:])
    pair[last] = 0  # a pair with the next text's first half-chunk
    alone = halves == 1
    pair[last[alone]] = top[last[alone]]
    start = last - halves + 1
    return np.add.reduceat(pair, start, axis=0, dtype=float) / np.maximum(halves - 1, 1)[:, None], np.maximum.reduceat(pair, start, axis=0)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3) -> Network:
    """Adam on the mean log loss; only the windows that win a chunk's maximum carry a gradient to the filters."""
    rng = np.random.default_rng(seed)
    d = WIDTH * VECTORS.shape[1]
    net = Network(
        (rng.normal(size=(d, FILTERS)) / np.sqrt(d)).astype(np.float32), np.full(FILTERS, 0.05, np.float32), rng.normal(size=2 * FILTERS) * 0.05, 0.0
    )
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        p = float(labels.mean()) if len(labels) else 0.5
        net.bias = float(np.log((p + 1e-3) / (1 - p + 1e-3)))
        return net
    moments = [[0.0, 0.0] for _ in range(4)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            who = order[a : a + BATCH]
            flat, halves = layout([texts[i] for i in who])
            y = labels[who]
            top, arg = net.tops(flat, halves, places=True)
            mean, most = chunk_means(top, halves)
            z = np.concatenate([mean, most], axis=1)
            error = (1 / (1 + np.exp(-(z @ net.weights + net.bias))) - y) / len(y)
            g_pool = error[:, None] * net.weights
            # back to half-chunks: the mean spreads over the chunks, the maximum goes to the chunk that holds it
            last = np.cumsum(halves) - 1
            owner = np.repeat(np.arange(len(halves)), halves)
            chunks = np.maximum(halves - 1, 1)
            pair_next = np.r_[top[1:], top[-1:]]
            tail = np.zeros(len(top), bool)
            tail[last] = True
            single = (halves == 1)[owner]
            pair = np.where(tail[:, None], np.where(single[:, None], top, 0), np.maximum(top, pair_next))
            g = np.where(tail & ~single, 0, 1)[:, None] * (g_pool[owner, :FILTERS] / chunks[owner][:, None])
            g += np.where((pair == most[owner]) & (pair > 0), g_pool[owner, FILTERS:], 0)
            first_wins = top >= pair_next
            g_top = np.where((tail & single)[:, None] | ~tail[:, None] & first_wins, g, 0)
            g_top[1:] += np.where(~tail[:-1, None] & ~first_wins[:-1], g[:-1], 0)
            g_top = np.where(top > 0, g_top, 0)
            # of each half-chunk's best window only its bytes are looked up again
            at = np.arange(len(top))[:, None] * HALF + arg.astype(np.int64) * STRIDE
            padded = np.r_[flat, np.zeros(WIDTH, np.uint8)]
            g_filters = np.zeros_like(net.filters)
            for f in range(FILTERS):
                used = np.flatnonzero(g_top[:, f])
                best = VECTORS[padded[at[used, f, None] + np.arange(WIDTH)]].reshape(len(used), d)
                g_filters[:, f] = best.T @ g_top[used, f].astype(np.float32)
            step += 1
            rate = RATE * (1 - step / (EPOCHS * (len(order) / BATCH + 1)))
            grads = (g_filters, g_top.sum(axis=0), z.T @ error + 1e-4 * net.weights, error.sum())
            values = []
            for k, (value, grad) in enumerate(zip((net.filters, net.shift, net.weights, net.bias), grads, strict=True)):
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad**2
                size = rate * (5 if k >= 2 else 1)
                values.append(value - size * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
            net = Network(values[0].astype(np.float32), values[1].astype(np.float32), values[2], float(values[3]))
    return net


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Learns labels.quality of a sample of the rows of labels where training, a Column over its doc_id, holds.

    A doc_id that labels repeats counts with its greatest quality.
    """
    known = labels.filter(training & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = F.broadcast(hash_sample(known, "id", sample))  # sample rows at most
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("id"), F.struct(F.xxhash64(text), F.coalesce(text, F.lit("")).alias("text")).alias("t")).join(chosen, "id")
    rows = written(rows.groupBy("id", "quality").agg(F.min("t").alias("t")).select("id", "quality", F.col("t.text").cast("binary").alias("text")), "sample")
    left, ids = sample_bytes, []
    for r in rows.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64(F.lit(7), "id"), "id").collect():
        if r["n"] <= left:
            left -= r["n"]
            ids.append(r["id"])
    rows = rows.filter(F.col("id").isin(ids)).toPandas().sort_values("id")
    return train([bytes(t) for t in rows["text"]], rows["quality"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        score = shared.value.probability(texts)
        columns = [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    text = docs["text"].cast("string").cast("binary")
    return map_batches(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text")), run, "doc_id bigint, score double, predicted int")
