"""Importance resampling towards a target: hashed n-gram counts, weights, and the best share of noisy scores.

Runs of one to three words fall into buckets by checksum. Spark adds up the buckets of all documents and
of all target texts; a bucket's gain is the logarithm of how much likelier it is in the target, and a
document's weight the sum of the gains of its runs, taken from an array over whole batches of texts. A
noise that depends on the document's id alone is added, so that taking the highest scores is a draw
without replacement by weight.

The draw needs no sort of all rows: scores are written once, and the cutoff is found by halving the range
of scores with exact counts, several halvings a job. Rows that tie with the cutoff are told apart by id,
and rows of one id by their place, in the same way. Only drawn rows are sorted, by ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back, materialise
from formspark.llm.ngrams import ngrams

BUCKETS = 10_000
LEAST_WORDS = 20      # documents of fewer words are not drawn
PERCENT = 5
SEED = 42
HALVINGS = 4          # halvings of a range that one count job does at once


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of one to three words fall into each bucket, over all texts. Null has none."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for sums, _, _ in ngrams(batch.column(0)):
                total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])
        give_back()

    sums = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # one number for each bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much likelier a bucket is in the target, one added to all
    counts, rounded down. Zeros where neither holds anything."""
    n = len(docs)
    s, t = docs.astype(np.float64), target.astype(np.float64)
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without the text, and ``n_words``, ``n_features`` and ``weight`` of it. Null has no words."""
    bounded_batches(docs.sparkSession)
    buckets = len(gain)
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def batch_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for sums, of, new in ngrams(texts):
                words += new
                features += np.bincount(of, minlength=len(texts))
                weight += np.bincount(of, gain[sums % np.uint32(buckets)], minlength=len(texts)).astype(np.int64)  # whole numbers far below 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in others] + [pa.array(x) for x in (words, features, weight)],
                                             names=[*others, "n_words", "n_features", "weight"])
        give_back()

    return docs.mapInArrow(batch_weights, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that depends on the seed and the id, rounded down; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def nth_least(rows: DataFrame, value: Column, n: int) -> tuple[int, int]:
    """The n-th least of a column of whole numbers (n from 1 on, repeats counted), and how many rows are
    less than it: by halving the range between the least and the greatest, with exact counts."""
    rows = rows.select(value.alias("v"))
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    low, high, below = ends["low"], ends["high"], 0  # low <= result <= high; below rows are under low
    while low < high:
        marks = sorted({low + (high - low) * k // (1 << HALVINGS) for k in range(1, 1 << HALVINGS)} - {high})
        counts = rows.agg(*[F.sum(F.when(F.col("v") <= m, 1).otherwise(0)).alias(f"m{k}") for k, m in enumerate(marks)]).first()
        for k, m in enumerate(marks):
            if counts[k] >= n:
                high = m
                break
            low, below = m + 1, counts[k]
    return low, below


def drawn(scored: DataFrame, n: int) -> Column:
    """Which rows of ``scored`` (``score``, ``id``, ``row``, no equal rows) are the ``n`` first: higher scores first,
    then smaller ids, rows without an id last, then smaller row numbers."""
    if n <= 0:
        return F.lit(False)
    least, before = nth_least(scored, -F.col("score"), n)
    score = F.col("score")
    better, tied = score > -least, score == -least
    n -= before
    rows = scored.where(tied)
    with_id, total = rows.agg(F.count("id"), F.count("*")).first()
    if n == total:
        return better | tied
    if n > with_id:  # all with an id, and some without
        number, _ = nth_least(rows.where("id is null"), F.col("row"), n - with_id)
        return better | tied & (F.col("id").isNotNull() | (F.col("row") <= number))
    last, before = nth_least(rows.where("id is not null"), F.col("id"), n)
    here = F.coalesce(F.col("id") < last, F.lit(False))
    number, _ = nth_least(rows.where(F.col("id") == last), F.col("row"), n - before)
    return better | tied & (here | F.coalesce((F.col("id") == last) & (F.col("row") <= number), F.lit(False)))


def ranked(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows from 1 on in ``order``: sorted range by range, each range numbered from where the one before ended."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + place + 1).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_words, n_features, weight, score, rank) and the columns ``carry``;
    ``rank`` numbers the rows drawn, 1 for the highest score, and is null for the others.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down. Ties go
    to the smaller id, rows without an id come last; rows of one id and score, repeated ones for instance,
    are told apart by where they were read, each counted for itself. Null and empty texts have no words and
    weigh nothing. Without target texts all gains follow from the documents alone; without documents there
    are no rows. Columns not named are left out, whatever their names; ids are whole numbers.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("__none")).alias("carried"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    if not carry:
        rows = rows.drop("carried")
    weighed = weigh(rows, gain)
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    chosen = drawn(able, percent * able.count() // 100) & (F.col("n_words") >= least_words)
    first = ranked(scored.where(chosen), [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], "rank")
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    both = first.unionByName(rest)
    return both.select(F.col("id").alias(doc_id), "n_words", "n_features", "weight", "score", "rank", *[F.col(f"carried.`{c}`") for c in carry])
