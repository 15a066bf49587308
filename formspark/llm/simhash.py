"""SimHash near-duplicates: fingerprints, exact links by tiled comparison, components.

A fingerprint is linked to every other one that differs in at most ``RADIUS`` bits. Equal
fingerprints are one row from the start. The 64 bits are cut into six parts; two fingerprints that
differ in four bits agree on two whole parts at least, so each fingerprint is dealt into the 15
buckets of its pairs of parts, and a link is found in one of them or more. Inside a bucket the
comparison is tiled: fingerprints are ranked by population count, tiles are ranks of ``TILE``, and a
fingerprint is sent to those tile pairs only whose population counts are within the radius of its
own. A tile pair is compared whole, by exclusive-or and bit counts. It returns links to the least
fingerprint of each of its groups, not all pairs: enough for the components, and at most one for
each row of the tile pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back, materialise
from formspark.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 2048
FEW = 8                # cells of so many rows are compared many at a time
ROWS = 1 << 16         # rows of cells that are in memory at a time, and the rest of a cell
CHUNK = 1 << 16        # shingles whose bits are in memory at a time
PARTS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, bits
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half of the shingles' hashes, as a signed 64-bit integer."""
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[SHINGLE - 1:].tolist() if len(words) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``, the fingerprint of ``text`` as a signed 64-bit integer. Texts without words (null,
    empty, white space) get zero; a text of fewer than four words is one shingle."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")
        give_back()

    return docs.withColumn(out, of(F.col(f"`{text}`")))


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def buckets(value: Column) -> Column:
    """One bucket number for each pair of parts."""
    part = [F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in PARTS]
    return F.array(*[F.lit(k << 22) + F.shiftleft(part[i], 11) + part[j] for k, (i, j) in enumerate(combinations(range(len(PARTS)), 2))])


def cells(values: DataFrame, tile: int) -> DataFrame:
    """(bucket, low, high, side, fp): rows of the tile pair (low, high) of a bucket."""
    rows = values.select("fp", F.bit_count("fp").alias("pop"), F.explode(buckets(F.col("fp"))).alias("bucket"))
    large = materialise(rows.groupBy("bucket", "pop").count().groupBy("bucket")
                        .agg(F.sum("count").alias("n"), F.collect_list(F.struct("pop", "count")).alias("pops")).where(F.col("n") > tile).select("bucket", "pops"))

    def below(pop: Column) -> Column:
        return F.aggregate("pops", F.lit(0).cast("long"), lambda n, x: n + F.when(x["pop"] < pop, x["count"]).otherwise(0))

    own = F.aggregate("pops", F.lit(0).cast("long"), lambda n, x: n + F.when(x["pop"] == F.col("pop"), x["count"]).otherwise(0))
    rank = below(F.col("pop")) + F.pmod(F.xxhash64("fp"), F.greatest(own, F.lit(1)))
    dealt = rows.join(large, "bucket", "left").withColumn("side", F.when(F.col("pops").isNull(), 0).otherwise(F.floor(rank / tile)))
    first = F.floor(below(F.col("pop") - RADIUS) / tile)
    last = F.floor((below(F.col("pop") + RADIUS + 1) - 1) / tile)
    partners = F.when(F.col("pops").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    return (dealt.withColumn("partner", F.explode(partners))
            .select("bucket", F.least("side", "partner").alias("low"), F.greatest("side", "partner").alias("high"), "side", "fp"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a tile are within the radius of which rows of another."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= RADIUS


def tile_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile pair, as (fingerprint, least fingerprint of its group in this tile pair)."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    group = np.empty(len(both), np.int64)
    group[order] = np.arange(len(both))  # least rank of the group
    touched = False
    for at in range(0, len(a), 128):
        hit = near(a[at:at + 128], b)
        for k in np.flatnonzero(hit.any(axis=1)):
            members = np.concatenate([[at + k], len(a) + np.flatnonzero(hit[k])])
            old = np.unique(group[members])
            if len(old) > 1:
                group[np.isin(group, old)] = old[0]
                touched = True
    if not touched:
        return both[:0], both[:0]
    least = both[order][group]
    linked = least != both
    return both[linked], least[linked]


def cell_links(bucket: np.ndarray, low: np.ndarray, high: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside each cell; rows of a cell stand together."""
    new = np.ones(len(fp), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fp)))
    number = np.cumsum(new) - 1
    few = (size <= FEW)[number]
    for step in range(1, FEW):
        if len(fp) > step:
            same = (number[step:] == number[:-step]) & few[step:]
            at = np.flatnonzero(same)
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= RADIUS]
            yield fp[at], fp[at + step]
    for k in np.flatnonzero(size > FEW):
        rows = slice(start[k], start[k] + size[k])
        values, sides = fp[rows], side[rows]
        one = values[sides == low[start[k]]]
        yield tile_links(one, one if low[start[k]] == high[start[k]] else values[sides == high[start[k]]])


def links(values: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` that join the same groups as all pairs within the radius."""
    names = ["bucket", "low", "high", "side", "fp"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        waiting: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
            if not waiting or batch is not None and sum(len(b) for b in waiting) < ROWS:
                continue
            columns = [np.concatenate([h, *(b.column(n).to_numpy(zero_copy_only=False) for b in waiting)]) for h, n in zip(held, names, strict=True)]
            waiting = []
            if not len(columns[0]):
                continue
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])  # the cell may go on
            held = [c[last] for c in columns]
            yield from found([c[~last] for c in columns])
        yield from found(held)

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            pairs = [(u.view(np.int64), v.view(np.int64)) for u, v in cell_links(*columns[:4], columns[4].view(np.uint64)) if len(u)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)], names=["u", "v"])

    dealt = cells(values, tile).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest id reachable by links of
    at most four differing bits, the row's own id included. Texts without words have fingerprint zero
    and are linked like any other. Repeated rows are returned as often as they come. Rows with a null
    id take part; where a whole component has no id, its component_id is null. An empty table gives
    no rows. Other columns are left out, whatever their names.
    """
    signed = materialise(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", "fp").drop("text"))
    values = materialise(signed.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(links(values.select("fp"), tile)).withColumnRenamed("node", "fp")
    linked = materialise(groups.join(values, "fp"))
    least = linked.groupBy("label").agg(F.min("first").alias("group_first"))
    found = linked.join(least, "label").select("fp", "group_first")
    by_value = materialise(values.join(found, "fp", "left").select("fp", F.coalesce("group_first", "first").alias("component")))
    return signed.join(by_value, "fp", "left").select(F.col("id").alias(doc_id), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id (a row with
    an id before rows without, then the smaller fingerprint; equal rows count as one).

    Columns stay as they are. The text is shuffled once: rows of one id and fingerprint are merged
    before and after it, and the choice is joined on the same keys.
    """
    names = [c for c in docs.columns]
    marked = fingerprints(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", "fp").drop("text")
    signed = materialise(marked.select("id", "fp"))
    values = materialise(signed.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(links(values.select("fp"), tile)).withColumnRenamed("node", "fp")
    linked = groups.join(values, "fp")
    order = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("fp"))
    winners = linked.groupBy("label").agg(F.min(order).alias("best")).select("best.id", "best.fp")
    alone = values.join(groups, "fp", "left_anti").select(F.col("first").alias("id"), "fp")
    kept = winners.union(alone)
    rows = marked.groupBy("id", "fp").agg(F.first("row").alias("row"))
    return rows.join(kept.select(F.col("id").alias("__id"), F.col("fp").alias("__fp")), F.col("id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left_semi").select("row.*")
