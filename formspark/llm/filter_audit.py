"""Filter interaction audit: what every order of a set of filters removes at every step.

A row is only its mask, the set of filters that it fails. In lexicographic order the permutations that
begin with the same letters are one interval of ranks; the letters' Lehmer code is where it begins. So
the orders in which a mask leaves at step s are intervals too: one for each choice of s - 1 filters that
the mask passes and one that it fails. Counts of a mask are added where its intervals begin and taken
off where they end; a prefix sum over the ranks then gives the totals of all orders at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import materialise

LETTERS = "ABCDE"
#: White space between words, as in a pattern.
SPACE = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 8      # orders are counted in arrays as long as the factorial of the number of filters


def rank(letters: Sequence[int], n: int) -> int:
    """Rank of the first permutation of ``n`` letters, in lexicographic order, that begins with ``letters``."""
    left = list(range(n))
    at = 0
    for place, letter in enumerate(letters):
        digit = left.index(letter)
        at += digit * factorial(n - 1 - place)
        del left[digit]
    return at


def intervals(n: int) -> tuple[np.ndarray, ...]:
    """(mask, step, first rank, rank after the last) of every interval in which a mask leaves at a step."""
    found = []
    for step in range(1, n + 1):
        for head in permutations(range(n), step):
            passed, fails = head[:-1], head[-1]
            low = rank(head, n)
            rest = [k for k in range(n) if k not in head]
            for more in range(1 << len(rest)):
                mask = 1 << fails | sum(1 << k for j, k in enumerate(rest) if more >> j & 1)
                assert not any(mask >> k & 1 for k in passed)
                found.append((mask, step - 1, low, low + factorial(n - step)))
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True))


def totals(letters: str, masks: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Totals of all orders from counts of masks: ``counts`` has a column for rows, good rows and toxic rows."""
    n = len(letters)
    orders = np.array(list(permutations(range(n))), np.int64)
    by_mask = np.zeros((1 << n, 3), np.int64)
    np.add.at(by_mask, masks, counts)
    of, step, low, high = intervals(n)
    steps = np.zeros((n, len(orders) + 1, 3), np.int64)
    np.add.at(steps, (step, low), by_mask[of])
    np.subtract.at(steps, (step, high), by_mask[of])
    steps = steps.cumsum(axis=1)[:, :-1].transpose(1, 0, 2)  # order, step, count
    removed = steps[:, :, 0]
    failing = np.array([by_mask[[m for m in range(1 << n) if m >> k & 1], 0].sum() for k in range(n)], np.int64)
    alone = by_mask[[1 << k for k in range(n)], 0]
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed)
    return {
        "filter_order": np.repeat(np.array(["".join(letters[k] for k in o) for o in orders], object), n),
        "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
        "kept": (by_mask[:, 0].sum() - removed.cumsum(axis=1)).ravel(),
        "removed": removed.ravel(),
        "redundant": (failing[orders] - removed).ravel(),
        "unique_fails": alone[orders].ravel(),
        "good_lost": steps[:, :, 1].ravel(),
        "toxic_lost": steps[:, :, 2].ravel(),
        "shapley": shapley[orders].ravel(),
    }


def audit(rows: DataFrame, part: str, fails: dict[str, Column], good: Column, toxic: Column) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``fails`` has a condition for each filter, by a letter, in the order of the letters; a condition that
    is null counts as passed, and so do null ``good`` and ``toxic``. ``rows`` are counted by part and mask
    before anything moves, so a part is one row of at most ``2 ** len(fails)`` masks, whatever it holds.
    Parts are told apart as texts; a null part is the empty text. A table without rows has no parts.
    """
    letters = "".join(fails)
    if not 1 <= len(letters) == len(fails) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by one letter")
    if list(letters) != sorted(letters):
        raise ValueError("filters stand in the order of their letters")
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    one = [F.coalesce(c, F.lit(False)).cast("long") for c in (good, toxic)]
    counted = rows.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), one[0].alias("good"), one[1].alias("toxic"))
    counted = counted.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, masks in zip(batch["part"], batch["masks"], strict=True):
                masks = [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in masks]
                found = totals(letters, np.array([m[0] for m in masks], np.int64), np.array([m[1:] for m in masks], np.int64))
                yield pd.DataFrame({"part": name, **found})

    longs = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return by_part.mapInPandas(orders, f"part string, filter_order string, step int, {longs}")


def text_filters(text: Column) -> dict[str, Column]:
    """The four filters that look at one text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACE), "")
    upper = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * upper > 10 * F.length(whole),
        "D": whole.rlike("[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The audit of five filters on whole texts: A few words, B few distinct words, C many capitals, D odd
    signs, E a copy of a text with a smaller id.

    A null text is empty; empty texts are copies of each other like any other. A row with a null id is no
    copy, and nothing is a copy of it. Rows that repeat count as often as they come; rows of one id are no
    copies of each other. A document is good (toxic) if any label row of its id says quality (toxic) 1.
    Other columns have no effect, whatever their names.

    Texts stay where they are: what moves is a row of an id, a digest and four flags.
    """
    flags = text_filters(F.col("text"))
    rows = docs.select(F.col(f"`{part}`").alias("part"), F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("part", "id", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in flags.items()])
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = materialise(rows.join(marks, "id", "left"))
    # a table of its own, so that the join deals both sides and Spark can split the rows of a text that many have
    copies = materialise(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(copies, "digest", "left")
    return audit(rows, "part", {**{k: F.col(k) for k in flags}, "E": F.col("id") > F.col("first")}, F.col("good") == 1, F.col("toxic") == 1)
