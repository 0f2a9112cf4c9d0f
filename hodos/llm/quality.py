"""Operator 8: a byte-level convolutional network in numpy that scores a text's quality.

Learned filters run over every window of ``WIDTH`` bytes of overlapping chunks that together
cover the whole text. Each chunk keeps each filter's largest response; a text keeps the mean
and the maximum of those over its chunks, and one logistic unit makes them a probability.
It sees nothing but the bytes of the text. Null and empty texts are one chunk of padding.
Rows, nulls and further columns pass through; an input column called as the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hodos.llm.common import blocks_of, fold, table

WIDTH, FILTERS = 4, 16
CHUNK, OVERLAP = 512, 32
STEP = CHUNK - OVERLAP
#: The training sample: at most so many rows of either label, each with its whole text.
SAMPLE_ROWS = 1500
EPOCHS, BATCH, RATE = 8, 32, 0.01
ACCEPT = 0.7


def chunked(text: bytes) -> np.ndarray:
    """The overlapping chunks of a text, [n, CHUNK] bytes, zero-padded; at least one."""
    n = 1 if len(text) <= CHUNK else 1 + -(-(len(text) - CHUNK) // STEP)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))


class ByteNet:
    """filters [WIDTH, 256, FILTERS], bias [FILTERS], top [2 * FILTERS], offset [1]."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = {
            "filters": rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "top": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            "offset": np.zeros(1, np.float32),
        }

    def _tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to every filter, by the place of the pair."""
        f = self.weights["filters"]
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def responses(self, chunks: np.ndarray, pairs: list[np.ndarray] | None = None) -> np.ndarray:
        """[n, CHUNK - WIDTH + 1, FILTERS]; bytes are looked up in pairs."""
        last = CHUNK - WIDTH + 1
        pairs = pairs or getattr(self, "_pairs", None) or self._tables()
        codes = (chunks[:, :-1].astype(np.int32) << 8) | chunks[:, 1:]
        out = pairs[0].take(codes[:, :last], axis=0)
        for j in range(1, len(pairs)):
            out += pairs[j].take(codes[:, 2 * j : 2 * j + last], axis=0)
        return out

    def fixed(self) -> ByteNet:
        """Keeps the pair tables from now on; for scoring."""
        self._pairs = self._tables()
        return self

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """[n, FILTERS], a few chunks at a time."""
        parts = [self.responses(chunks[i : i + 64]).max(axis=1) for i in range(0, len(chunks), 64)]
        return np.maximum(np.concatenate(parts) + self.weights["bias"], 0)

    def combined(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One probability a text; ``first`` has where each text's chunks begin."""
        counts = np.diff(np.r_[first, len(pooled)])[:, None]
        features = np.hstack([np.add.reduceat(pooled, first, axis=0) / counts, np.maximum.reduceat(pooled, first, axis=0)])
        return 1 / (1 + np.exp(-(features @ self.weights["top"] + self.weights["offset"][0]).astype(np.float64)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in blocks_of(texts, 1 << 20):
            parts = [chunked(t) for t in texts[a:b]]
            first = np.cumsum([0] + [len(p) for p in parts[:-1]])
            out[a:b] = self.combined(self.pooled(np.concatenate(parts)), first)
        return out

    def fit(self, samples: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> ByteNet:
        """Adam on the log loss; the gradient goes to the window that won each maximum."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(samples))
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                step += 1
                self._step([samples[i] for i in picked], labels[picked], moments, step)
        return self

    def _step(self, parts: list[np.ndarray], truth: np.ndarray, moments: dict, step: int) -> None:
        w, chunks = self.weights, np.concatenate(parts)
        counts = np.array([len(p) for p in parts])
        first, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(parts)), counts)
        where, raw = np.empty((len(chunks), FILTERS), np.int64), np.empty((len(chunks), FILTERS), np.float32)
        pairs = self._tables()
        for a in range(0, len(chunks), 128):
            responses = self.responses(chunks[a : a + 128], pairs)
            at = where[a : a + 128] = responses.argmax(axis=1)
            raw[a : a + 128] = np.take_along_axis(responses, at[:, None, :], 1)[:, 0] + w["bias"]
        pooled = np.maximum(raw, 0)
        means, peaks = np.add.reduceat(pooled, first, axis=0) / counts[:, None], np.maximum.reduceat(pooled, first, axis=0)
        features = np.hstack([means, peaks])
        wrong = (1 / (1 + np.exp(-(features @ w["top"] + w["offset"][0]))) - truth).astype(np.float32) / len(parts)
        onto = wrong[:, None] * w["top"]
        down = (onto[:, :FILTERS] / counts[:, None])[owner] + onto[:, FILTERS:][owner] * (pooled == peaks[owner])
        down *= raw > 0
        grads = {"filters": np.zeros_like(w["filters"]), "bias": down.sum(0), "top": features.T @ wrong, "offset": np.array([wrong.sum()], np.float32)}
        rows = np.arange(len(chunks))[:, None]
        for j in range(WIDTH):
            np.add.at(grads["filters"][j], (chunks[rows, where + j], np.arange(FILTERS)[None, :]), down)
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def learned(documents: DataFrame, labels: DataFrame) -> ByteNet:
    """A network fitted on a bounded sample of the rows whose fold of four is not the second.

    The sample has at most ``SAMPLE_ROWS`` rows of either label, by the hash of the id; all chunks
    of their texts are learned from. Of rows that share an id one is learned from. Rows with a null id or label are not learned from. Without both labels the network stays unfitted and scores near a half.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    key = F.xxhash64("doc_id", "quality")
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("quality") == value).orderBy(key, "doc_id").limit(SAMPLE_ROWS)
        picked = part if picked is None else picked.unionByName(part)
    joined = documents.select("doc_id", "text").join(F.broadcast(picked.dropDuplicates()), "doc_id")

    # an id may stand for any number of rows: one of its texts, the same on every run, is taken
    once = joined.groupBy("doc_id", "quality").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = sorted(once.collect(), key=lambda r: (r.doc_id, r.quality))
    net = ByteNet()
    truth = np.array([r.quality for r in rows], np.float32)
    if len(set(truth.tolist())) == 2:
        net.fit([chunked(r.text.encode()) for r in rows], truth)
    return net


def scored(documents: DataFrame, net: ByteNet, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the network's probability of good quality for each whole text."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if not hasattr(net, "_pairs"):
            net.fixed()
        return pd.Series(net.score([t.encode() if t is not None else b"" for t in texts]))

    return documents.withColumn(score, probability(F.col(text)))


def quality(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, held_out, score, predicted for every row of ``documents``."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learned(documents, table(spark, sf_dir, "labels"))
    out = scored(documents, net)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
