"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased; runs of anything but letters become one space. For each order from 1 to
``ORDER`` a model holds the hashes of the n-grams that any language has seen, sorted, and beside
them the interpolated log-probability of the n-gram's last character in every language; contexts and
their back-off weights lie in sorted hash arrays of their own. A text is scored whole: each position
by the longest n-gram found, backing off where it is not. The language of least cross-entropy per
character wins; it is rejected where the cross-entropy lies far above what texts of that language
and length show.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back, remainder
from formspark.llm.sampling import bounded_sample

ORDER = 4
PER_LANGUAGE = 400     # labelled rows that a language's model is fitted on, at most
DEVIATIONS = 12.0      # a text is rejected beyond so many standard deviations
SPACE = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20        # characters that are scored at a time
RESULT = "struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>"
UNKNOWN = "und"


def characters(text: str) -> np.ndarray:
    """Code points of the normalised text, after ``ORDER - 1`` spaces that give each a whole context."""
    plain = " " * (ORDER - 1) + SPACE.sub(" ", text.lower()).strip() + " "
    return np.frombuffer(plain.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def run_hashes(codes: np.ndarray, first: int, order: int) -> np.ndarray:
    """Hash of ``order`` characters, the first of them ``first`` after the start of each whole context."""
    n = len(codes) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(first, first + order):
        out = (out + codes[k:k + n] + np.uint64(1)) * MIX
        out ^= out >> np.uint64(29)
    return out


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each position of the text."""
    return run_hashes(codes, ORDER - order, order)


def before(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters before each position of the text."""
    return run_hashes(codes, ORDER - 1 - order, order)


class Hashed:
    """A sorted array of hashes, with an index of their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(2**64 - 1))  # a last one to look at
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length()))
        self.first = np.searchsorted(keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.size = len(keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, or -1."""
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        there = self.keys[at]
        out = np.where(there == wanted, at, -1)
        todo = np.flatnonzero(there < wanted)
        while len(todo):
            at[todo] += 1
            there = self.keys[at[todo]]
            same = there == wanted[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[there < wanted[todo]]
        return np.where(out < self.size, out, -1)


@dataclass
class Model:
    """grams[n], log_p[n]: n-grams and log-probabilities by language; contexts[n], log_back[n]: back-off weights."""

    languages: list[str]
    grams: list[Hashed]
    log_p: list[np.ndarray]
    contexts: list[Hashed]
    log_back: list[np.ndarray]
    log_unknown: np.ndarray
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray

    def positions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities by language, and their sum of squares."""
        n = len(codes) - ORDER + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        todo = np.arange(n)
        for order in range(ORDER, 0, -1):
            place = self.grams[order].find(hashes(codes, order)[todo])
            hit = place >= 0
            out[todo[hit]] += self.log_p[order][place[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if order > 1:  # the context of the n-gram ends one position earlier
                place = self.contexts[order - 1].find(before(codes, order - 1)[todo])
                hit = place >= 0
                out[todo[hit]] += self.log_back[order - 1][place[hit]]
        if len(todo):
            out[todo] += self.log_unknown
        return out.sum(axis=0, dtype=np.float64), (out.astype(np.float64) ** 2).sum(axis=0)

    def entropies(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Characters, cross-entropy by language and variance of a character's, over the whole text."""
        codes = characters(text)
        total, squares = np.zeros(len(self.languages)), np.zeros(len(self.languages))
        n = len(codes) - ORDER + 1
        for at in range(0, n, CHUNK):
            part = self.positions(codes[at:min(n, at + CHUNK) + ORDER - 1])
            total += part[0]
            squares += part[1]
        mean = total / n
        return n, -mean, squares / n - mean**2

    def judge(self, text: str | None) -> tuple[str, float, float | None, bool]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, None, True
        n, entropy, _ = self.entropies(text)
        best = int(np.argmin(entropy))
        odds = np.exp(-(entropy - entropy[best]) * min(n, 100))
        limit = self.mean[best] + DEVIATIONS * np.sqrt(self.between[best] + self.within[best] / n)
        return self.languages[best], float(1 / odds.sum()), float(entropy[best]), bool(entropy[best] > limit)


def gram_counts(labelled: DataFrame) -> pd.DataFrame:
    """n-grams of the labelled rows (lang, text), counted by Spark: (lang, order, gram, context, shorter, n)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                codes = characters(text)
                for order in range(1, ORDER + 1):
                    gram, first, n = np.unique(hashes(codes, order), return_index=True, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "order": order, "gram": gram.view(np.int64), "context": before(codes, order - 1)[first].view(np.int64) if order > 1 else 0,
                                        "shorter": hashes(codes, order - 1)[first].view(np.int64), "n": n})
        give_back()

    counted = labelled.mapInPandas(count, "lang string, order int, gram bigint, context bigint, shorter bigint, n bigint")
    return counted.groupBy("lang", "order", "gram", "context", "shorter").agg(F.sum("n").alias("n")).toPandas()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit one model a language on labelled rows (doc_id, lang, text): at most ``per_language`` whole
    texts of each, chosen by hash. The sample bounds what reaches the driver: its distinct n-grams."""
    bounded_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").where(F.regexp_like("text", F.lit(r"\p{L}")))
    sample = bounded_sample(known, "lang", per_language, "doc_id", "text").select("lang", "text").persist()
    try:
        table = gram_counts(sample)
        languages = sorted(table["lang"].unique())
        model = kneser_ney(table, languages)
        calibrate(model, sample)
    finally:
        sample.unpersist()
    return model


def kneser_ney(table: pd.DataFrame, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney: counts at the highest order, below it in how many longer n-grams one ends."""
    width = len(languages)
    empty = Hashed(np.empty(0, np.uint64))
    grams, log_p, contexts, log_back = ([empty] + [empty] * ORDER, [np.zeros((0, width), np.float32)] * (ORDER + 1), [empty] * (ORDER + 1), [np.zeros((0, width), np.float32)] * (ORDER + 1))
    letters = max(1, table.loc[table["order"] == 1, "gram"].nunique()) + 1
    lower = None
    unknown = np.full(width, 1 / letters)
    for order in range(1, ORDER + 1):
        here = table[table["order"] == order]
        keys, index = np.unique(here["gram"].to_numpy(np.int64).view(np.uint64), return_index=True)
        shorter = here["shorter"].to_numpy(np.int64).view(np.uint64)[index]
        heads = np.unique(here["context"].to_numpy(np.int64).view(np.uint64))
        context_of = here["context"].to_numpy(np.int64).view(np.uint64)[index]
        grams[order] = Hashed(keys)
        base = np.full((len(keys), width), 1 / letters) if order == 1 else lower[grams[order - 1].find(shorter)]
        back = np.ones((len(heads), width))
        p = np.zeros((len(keys), width))
        for k, lang in enumerate(languages):
            rows = here[here["lang"] == lang]
            if rows.empty:
                continue
            place = grams[order].find(rows["gram"].to_numpy(np.int64).view(np.uint64))
            if order == ORDER:
                value = rows["n"].to_numpy(float)
            else:
                longer = table[(table["lang"] == lang) & (table["order"] == order + 1)]
                ends, times = np.unique(longer["shorter"].to_numpy(np.int64), return_counts=True)
                value = np.maximum(1, pd.Series(times, index=ends).reindex(rows["gram"].to_numpy(np.int64)).fillna(0).to_numpy(float))
            once, twice = (value == 1).sum(), (value == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            head = np.searchsorted(heads, rows["context"].to_numpy(np.int64).view(np.uint64))
            total, kinds = np.bincount(head, value, len(heads)), np.bincount(head, minlength=len(heads))
            back[kinds > 0, k] = discount * kinds[kinds > 0] / total[kinds > 0]
            p[place, k] = (value - discount) / total[head]
            if order == 1:
                unknown[k] = back[0, k] / letters
        p += back[np.searchsorted(heads, context_of)] * base
        lower = p
        log_p[order] = np.log(p).astype(np.float32)
        if order > 1:
            contexts[order - 1], log_back[order - 1] = Hashed(heads), np.log(back).astype(np.float32)
    zeros = np.zeros(width)
    return Model(languages, grams, log_p, contexts, log_back, np.log(unknown).astype(np.float32), zeros, zeros, zeros)


def calibrate(model: Model, sample: DataFrame) -> None:
    """What cross-entropies the labelled texts have in their own language: mean, variance between texts, variance of a character."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for rows in batches:
            out = []
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                n, entropy, spread = own.entropies(text)
                k = own.languages.index(lang)
                out.append((k, n, entropy[k], spread[k]))
            yield pd.DataFrame(out, columns=["k", "n", "entropy", "spread"])

    long = F.when(F.col("n") >= 200, F.col("entropy"))
    by = sample.mapInPandas(measure, "k int, n bigint, entropy double, spread double").groupBy("k").agg(
        (F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("mean"), F.coalesce(F.var_pop(long), F.lit(0.0)).alias("between"), F.avg("spread").alias("within")).collect()
    model.mean, model.between, model.within = (np.zeros(len(model.languages)) for _ in range(3))
    for r in by:
        model.mean[r["k"]], model.between[r["k"]], model.within[r["k"]] = r["mean"], r["between"] + 0.01, r["within"] * 4


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``, by the whole of ``text``.

    A null text and one without a letter get ``und``, score 0, no cross-entropy, and are rejected, and
    so is every text where no language was learned. Ties go to the first language in order. Other
    columns stay; columns of the names above are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for texts in batches:
            yield pd.DataFrame([own.judge(t) for t in texts], columns=["lang_pred", "score", "cross_entropy", "rejected"])
        give_back()

    out = docs.withColumn("__judged", judged(F.col(f"`{text}`")))
    return out.withColumns({n: F.col(f"__judged.{n}") for n in ("lang_pred", "score", "cross_entropy", "rejected")}).drop("__judged")


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows whose language may be learned: crc32 of the id's text modulo 4 is not 2."""
    return docs.where(remainder(F.col(f"`{doc_id}`"), 4) != 2)
