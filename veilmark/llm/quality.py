"""Quality: logistic regression on hashed word uni- and bigrams, trained by follow-the-regularised-leader.

Training reads at most SAMPLE labelled rows (those with the smallest hashes of their ids: the same at any partitioning),
makes features of their whole texts in Spark and fits on the driver; scoring is a narrow sparse dot product over whole texts.

Results by case: null and empty texts score from the intercept; equal texts, so repeated rows, score alike; null labels and
ids teach nothing; an id with several rows or labels teaches each; an empty label table gives 0.5 everywhere, an empty table
of documents no rows; other columns are not read, keys named like the output are replaced by it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

BITS, SAMPLE, EPOCHS = 18, 12_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 1.0
TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


def featurizer():
    memo: dict[str, int] = {}

    def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers and log counts over the text's norm; bucket 0 is the intercept."""
        ids = []
        for w in TOKEN.findall(text or ""):
            h = memo.get(w)
            if h is None:
                if len(memo) > 300_000:
                    memo.clear()
                h = memo[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
            ids.append(h)
        a = np.array(ids, np.int64)
        both = np.concatenate([a, a[:-1] * 31 + a[1:] * 17 + 7]) if len(a) else a
        idx, n = np.unique(both * 2654435761 % (1 << 61) >> 20 & (1 << BITS) - 1, return_counts=True)
        val = np.log1p(n)
        val = val / max(1e-9, np.sqrt((val * val).sum()))
        return np.concatenate([[1 << BITS], idx]), np.concatenate([[1.0], val * 4])

    return features


def fit(data: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights from buckets, values and label of each row."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(7)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in order.permutation(len(data)):
            i, x, y = data[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most sample labels, and at most sample rows of theirs; only their buckets and values reach the driver."""
    some = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", "y"))

    def setup():
        features = featurizer()

        def batch(texts):
            found = [features(t) for t in texts]
            return {"i": [i.astype(np.int32).tobytes() for i, _ in found], "x": [x.astype(np.float32).tobytes() for _, x in found]}

        return batch

    made = map_texts(rows, ["h", "y"], "i binary, x binary", setup)
    got = made.orderBy("h", "y").limit(sample).select("i", "x", "y").toArrow()
    i, x, y = (got.column(k).to_pylist() for k in range(3))
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32), c) for a, b, c in zip(i, x, y, strict=True)])


def score(docs: DataFrame, weights: np.ndarray, keys: list[str], text_col: str = "text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def setup():
        features, w = featurizer(), held.value

        def batch(texts):
            return {"score": [float(1 / (1 + np.exp(-np.clip(w[i] @ x, -30, 30)))) for i, x in map(features, texts)]}

        return batch

    return map_texts(docs, keys, "score double", setup, text_col)
