"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is cut into words and runs of punctuation. Every token gives its own hash, the hash of it and
the token before, and the hash of the shapes of three tokens in a row; a shape tells lower case,
capitalised, upper case, digits and punctuation apart, and whether the token repeats the one before.
A text's features are the shares of these hashes among all of its n-grams, so a score is a sparse dot
product of shares and weights, computed over the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back, remainder
from formspark.llm.sampling import bounded_sample

BITS = 18
PER_LABEL = 3000       # labelled rows of each class that the weights are fitted on, at most
EPOCHS = 4
THRESHOLD = 0.3        # scores from here on count as good
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
SCALE = 30.0           # shares are multiplied by this, so that weights stay in the range the learner moves in
TOKEN = re.compile(r"\w+|[^\w\s]+")
CHUNK = 1 << 20        # characters whose tokens are in memory at a time
MEMO = 100_000         # tokens a worker remembers, within a task
MASK = np.int64((1 << BITS) - 1)


class Tokens(dict):
    """(hash, shape) of a token as one integer: shape in the low 3 bits. Forgotten when it grows large."""

    def __missing__(self, token: str) -> int:
        first = token[0]
        if not (first.isalnum() or first == "_"):
            shape = 1
        elif token.isdigit():
            shape = 2
        elif len(token) > 1 and token.isupper():
            shape = 3
        elif first.isupper():
            shape = 4
        elif token.islower():
            shape = 5
        else:
            shape = 6
        value = (zlib.crc32(token.encode("utf-8", "replace")) << 3) | shape
        self[token] = value
        return value


TOKENS = Tokens()


def features(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of the whole text, with repeats, a block of characters at a time."""
    if not text:
        return
    last = np.zeros(2, np.int64)
    at = 0
    while at < len(text):
        stop = at + CHUNK
        if stop < len(text):  # cut at white space, where there is some
            space = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
            stop = space if space > at else stop
        if len(TOKENS) > MEMO:
            TOKENS.clear()
        words = TOKEN.findall(text, at, stop)
        at = stop
        if not words:
            continue
        coded = np.concatenate([last, np.fromiter(map(TOKENS.__getitem__, words), np.int64, len(words))])
        last = coded[-2:]
        same = np.zeros(len(coded), np.int64)
        same[1:] = coded[1:] == coded[:-1]
        shape = (coded & 7) | (same << 3)
        one, two = coded >> 3, coded[1:-1] >> 3
        yield (one[2:] * 0x9E3779B1 >> 11) & MASK
        yield ((one[2:] * 0x85EBCA77 + two * 0xC2B2AE3D) >> 13) & MASK
        yield ((shape[2:] | shape[1:-1] << 4 | shape[:-2] << 8) * 0x27D4EB2F >> 7) & MASK


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their scaled shares."""
    parts = list(features(text))
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    index, n = np.unique(np.concatenate(parts), return_counts=True)
    return index, n * (SCALE / n.sum())


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows of (label, features, values), in the order given; returns weights and bias.

    The bias is a feature of value one without penalties.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        free = at == size
        l1, l2 = np.where(free, 0.0, L1), np.where(free, 0.0, L2)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + l2))

    for _ in range(epochs):
        for label, index, value in rows:
            at, x = np.append(index, size), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows: docs (doc_id, text), labels (doc_id, quality).

    Only labels of 0 or 1 and ids whose crc32 modulo 5 is not 0 count. At most ``per_label`` label rows
    of each class are taken, by hash, which bounds the texts that are read and the features that reach
    the driver; classes are weighed back to their shares by the bias.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sample = bounded_sample(known, "quality", per_label, "doc_id").select("doc_id", "quality")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(int(q), *shares(t)) for q, t in zip(rows["quality"], rows["text"], strict=True)]
            yield pd.DataFrame({"h": [zlib.crc32(b"".join((i.tobytes(), x.tobytes()))) for _, i, x in out], "quality": [q for q, _, _ in out],
                                "index": [i.astype(np.int32).tobytes() for _, i, _ in out], "value": [x.astype(np.float32).tobytes() for _, _, x in out]})
        TOKENS.clear()  # workers outlive their task
        give_back()

    # the sample has a bound (two classes of per_label rows), so it may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text")
    rows = joined.mapInPandas(extract, "h bigint, quality int, index binary, value binary").collect()
    rows.sort(key=lambda r: (r["h"], r["quality"]))
    learned = [(r["quality"], np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float)) for r in rows]
    weights, bias = learn(learned)
    seen = {q: sum(1 for r in learned if r[0] == q) for q in (0, 1)}
    if all(seen.values()) and all(totals.get(q) for q in (0, 1)):
        bias += float(np.log(totals[1] / totals[0]) - np.log(seen[1] / seen[0]))
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability that a reader marks ``text`` as good, by the whole text.

    Null and empty texts and texts without a token get the probability of the bias alone. With no
    labelled rows all weights are zero and every score is one half. Other columns stay; a column of
    the name ``out`` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = held.value

        def one(text: str | None) -> float:
            total, n = 0.0, 0
            for part in features(text):
                total += float(weights[part].sum(dtype=np.float64))
                n += len(part)
            return 1 / (1 + np.exp(-np.clip(bias + (SCALE * total / n if n else 0.0), -35, 35)))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")
        TOKENS.clear()
        give_back()

    return docs.withColumn(out, scored(F.col(f"`{text}`")))
