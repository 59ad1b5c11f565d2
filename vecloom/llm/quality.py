"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by a filter's width less one, so
that every window of the whole text lies in a chunk. Filters of WIDTH bytes run over each
chunk; the largest response of each filter is kept, rectified, and averaged over the
text's chunks, and with these the share of a chunk's windows that there are: few maxima mean
little in a full chunk, but nothing in a short text. A logistic unit makes one probability of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_computed

WIDTH, FILTERS, EMBEDDING, CHUNK = 4, 16, 8, 256
#: The bounded sample that is learned from: documents of each label, whole.
TRAIN_DOCS = 600
#: Bytes of a document that a step of the training looks at: a stretch that is drawn anew each time, from anywhere in the text.
STRETCH = 768
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 16, 0.01, 1e-4, 7
#: From this score on a document is predicted to be of label 1.
THRESHOLD = 0.3


def to_bytes(text: str | None) -> np.ndarray:
    """A text's bytes; one that is shorter than a filter is filled up with zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw.ljust(WIDTH, b"\0"), np.uint8)


def starts_of(windows: int) -> np.ndarray:
    return np.arange(0, windows, CHUNK - WIDTH + 1)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = np.append(rng.normal(0, 0.3, FILTERS), 0).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Network:
        network = cls.__new__(cls)
        network.__dict__.update(arrays)
        return network

    def responses(self, data: np.ndarray) -> np.ndarray:
        """[window, filter]: a filter's product with an embedded byte depends on the byte alone, so it is looked up."""
        tables = [self.e @ self.w[k] for k in range(WIDTH)]
        n = len(data) - WIDTH + 1
        out = tables[0].take(data[:n], axis=0)
        for k in range(1, WIDTH):
            out += tables[k].take(data[k : k + n], axis=0)
        return out

    def features(self, data: np.ndarray) -> np.ndarray:
        """Rectified maxima of each filter, averaged over chunks; long texts go piece by piece."""
        total, count, step = np.zeros(FILTERS), 0, 64 * (CHUNK - WIDTH + 1)
        for at in range(0, len(data) - WIDTH + 1, step):
            part = self.responses(data[at : at + step + WIDTH - 1])
            peaks = np.maximum.reduceat(part, starts_of(len(part)), axis=0) + self.b
            total += np.maximum(peaks, 0).sum(axis=0, dtype=np.float64)
            count += len(peaks)
        return np.append(total, (len(data) - WIDTH + 1) / (CHUNK - WIDTH + 1)) / count

    def score(self, text: str | None) -> float:
        z = float(self.features(to_bytes(text)) @ self.v.astype(np.float64) + float(self.c[0]))
        return 1 / (1 + np.exp(-z)) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Network:
        """Adam on the weighted log loss; gradients pass only through the windows of the maxima."""
        rng = np.random.default_rng(SEED)
        docs = [to_bytes(t) for t in texts]
        short = [i for i in range(len(texts)) if labels[i] == 1]  # a good text's parts are good: short ones teach what little evidence looks like
        for i in short:
            size = int(2 ** rng.uniform(3, 7))
            at = int(rng.integers(0, max(1, len(texts[i]) - size)))
            docs.append(to_bytes(texts[i][at : at + size]))
        labels = np.concatenate([labels, labels[short]])
        weights = np.concatenate([weights, 0.5 * weights[short]])
        names = ("e", "w", "b", "v", "c")
        m = {n: np.zeros_like(getattr(self, n)) for n in names}
        s = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                g = {n: np.zeros_like(getattr(self, n)) for n in names}
                tables = np.zeros((WIDTH, 256 * FILTERS))
                for i in batch:
                    at = int(rng.integers(0, max(1, len(docs[i]) - STRETCH + 1)))
                    data = docs[i][at : at + STRETCH]
                    part = self.responses(data)
                    starts = starts_of(len(part))
                    at = np.stack([a + part[a : a + CHUNK - WIDTH + 1].argmax(axis=0) for a in starts])  # [chunk, filter]
                    peaks = part[at, np.arange(FILTERS)] + self.b
                    h = np.append(np.maximum(peaks, 0).mean(axis=0), len(part) / len(starts) / (CHUNK - WIDTH + 1))
                    z = float(h @ self.v + self.c[0])
                    d = float(weights[i]) * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
                    g["v"] += d * h
                    g["c"] += d
                    dp = d * self.v[None, :-1] * (peaks > 0) / len(starts)
                    g["b"] += dp.sum(axis=0)
                    for k in range(WIDTH):
                        spots = data[at + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                        np.add.at(tables[k], spots.ravel(), dp.ravel())
                for k in range(WIDTH):  # from the tables to what they are products of
                    gt = tables[k].reshape(256, FILTERS).astype(np.float32)
                    g["w"][k] += self.e.T @ gt
                    g["e"] += gt @ self.w[k].T
                step += 1
                for n in names:
                    grad = g[n] / max(1, len(batch)) + DECAY * getattr(self, n)
                    m[n] = 0.9 * m[n] + 0.1 * grad
                    s[n] = 0.999 * s[n] + 0.001 * grad * grad
                    getattr(self, n)[...] -= RATE * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)
        return self


def train(df: DataFrame, labels: DataFrame, trained: Column, text_col: str = "text", key_col: str = "doc_id", label_col: str = "quality") -> Network:
    """Learns from at most TRAIN_DOCS rows of each label, whole texts: those of least hash of their key.

    Weights restore the labels' shares among all labelled rows. Labels other than 0 and 1, and
    keys that are null, teach nothing. With rows of one label only, or none, the network
    is not fitted but answers with the share of label 1 (0.5 without rows).
    """
    rows = labels.filter(trained & F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull()).select(F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    network = Network()
    if len(counts) < 2:
        network.v[...] = 0
        network.c[...] = {(): 0.0, (0,): -3.0, (1,): 3.0}[tuple(counts)]
        return network
    order = F.xxhash64(F.col("k").cast("string"), F.lit("quality"))
    some = [rows.filter(F.col("y") == y).orderBy(order, "k").limit(TRAIN_DOCS) for y in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # bounded by TRAIN_DOCS
    texts = df.select(F.col(key_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(sample, "k")
    found = texts.groupBy("k", "y").agg(F.min("t").alias("t")).collect()  # rows that share a key teach one text
    found.sort(key=lambda r: (r.k, r.y))
    y = np.array([r.y for r in found], np.float64)
    if len(set(y)) < 2:
        network.v[...] = 0
        network.c[...] = np.log((counts[1] + 1) / (counts[0] + 1))
        return network
    share = {k: counts[k] / sum(counts.values()) * len(y) / (y == k).sum() for k in (0, 1)}
    return network.fit([r.t for r in found], y, np.array([share[int(k)] for k in y]))


def score_quality(df: DataFrame, network: Network, text_col: str | Column = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1; higher: label 1 is likelier) and predicted (1 from the threshold on).

    Null counts as the empty text; that has a score too. Every byte of a text counts, however long it
    is. Columns of these names are replaced; every row is kept.
    """
    held = df.sparkSession.sparkContext.broadcast(dict(network.__dict__))  # plain arrays: tasks need nothing of this package to read them

    def make():
        net = Network.of(held.value)

        def kernel(texts):
            scores = np.array([net.score(t.as_py()) for t in texts])
            return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

        return kernel

    return with_computed(df, [text_col], "score double, predicted int", make)
