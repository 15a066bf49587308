"""Training order on disk: a keyed permutation of all sequences, in shards of fixed stride.

The ids of all rows, each row closed by an end mark, are one long stream that is cut into sequences of
``length`` ids. A row's place in the stream is the sum of what comes before it: totals of the input's
partitions (one number each) and a running sum inside a partition. Sequence number ``i`` goes to slot
``permute(i)``: a Feistel network over the next power of four, walked until it lands among the
sequences, so that every slot is taken once and a slot's sequence follows from the key alone. Each
range of slots is one task, which writes one shard: records of ``length`` ids and one line feed. Record
``k`` of a shard starts at byte ``k * stride``, so a reader may go on from any slot.

Shards are written by Spark's own writer: commits are atomic, on any store that Spark knows, and a
task that is repeated writes the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches

END, PAD = 0xFF, 0xFE    # byte ids that UTF-8 never uses
ROUNDS = 8
LENGTH = 2048
SHARD_RECORDS = 32_768


def permute(values: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. size - 1 (or its inverse), of many values at a time."""
    half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def mixed(right: np.ndarray, k: int) -> np.ndarray:
        x = (right + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in rounds:
            left, right = (right ^ mixed(left, k), left) if back else (right, left ^ mixed(right, k))
        return (left << half) | right

    out = once(values.astype(np.uint64))
    while len(far := np.flatnonzero(out >= np.uint64(size))):  # cycle-walking
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Order:
    """What a reader needs to know: where the shards are, their shape, and the key of the permutation."""

    folder: str
    sequences: int
    length: int
    shard_records: int
    key: int

    @property
    def stride(self) -> int:
        return self.length + 1


def write_order(rows: DataFrame, ids: str, folder: str, key: int = 0, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> Order:
    """Write the ids of ``rows`` (a binary column of one-byte ids) in training order below ``folder``.

    Ids are 0 to 253: 254 and 255 are the pad and the end mark, and a row that holds one is an error.

    ``rows`` must give the same partitions with the same rows each time it is read, as tables of files
    do; a partition whose total has changed is an error, never a silent shift. Null and empty ids add
    their end mark alone; repeated rows are written as often as they come; the last sequence is filled
    up with pads. A table without rows writes no shard. Other columns are not read. A shard holds
    ``shard_records`` records, or fewer if there would be fewer shards than shuffle partitions.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    only = rows.select(F.col(f"`{ids}`").cast("binary").alias("ids"))
    sizes = only.select(F.spark_partition_id().alias("part"), (F.coalesce(F.octet_length("ids"), F.lit(0)) + 1).cast("long").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    totals = {r["part"]: r["n"] for r in sizes}  # one number for each partition of the input
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]
    count = -(-total // length)
    records = min(shard_records, max(1, -(-count // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    order = Order(folder, count, length, records, key)
    if not count:
        return order

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = starts.get(part, 0)
        end = at + totals.get(part, 0)
        squeeze = zstandard.ZstdCompressor(level=3).compress  # pieces travel compressed
        for batch in batches:
            index, place, pieces = [], [], []
            for value in batch.column(0).to_pylist():
                if value and (END in value or PAD in value):
                    raise ValueError(f"ids {PAD} and {END} are kept for pads and end marks")
                data = (value or b"") + bytes([END])
                done = 0
                while done < len(data):
                    take = min(length - at % length, len(data) - done)
                    index.append(at // length), place.append(at % length), pieces.append(squeeze(data[done:done + take]))
                    at += take
                    done += take
            slots = permute(np.array(index, np.int64), count, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots // records, pa.int32()), pa.array(slots), pa.array(place, pa.int32()), pa.array(pieces, pa.binary())], names=["shard", "slot", "place", "piece"])
        if at != end:
            raise ValueError(f"partition {part} has changed since its ids were counted")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = -1, []
        done: list[bytes] = []
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for s, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != slot:
                    if parts:
                        done.append(b"".join(parts).ljust(length, bytes([PAD])))
                    slot, parts = s, []
                parts.append(plain(piece))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["record"])
                done = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts).ljust(length, bytes([PAD]))], pa.binary())], names=["record"])

    pieces = only.mapInArrow(cut, "shard int, slot bigint, place int, piece binary")
    ranged = pieces.repartitionById(-(-count // records), F.col("shard")).sortWithinPartitions("slot", "place").select("slot", "piece")
    # a text record is its bytes and the line separator, so all records have one stride
    ranged.mapInArrow(join, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").mode("overwrite").text(folder)
    return order


def read_order(spark: SparkSession, order: Order, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, shard, place, sequence, record) of the slots from ``start`` to before ``stop``, in shards
    as they lie; only the files of the shards that hold such slots are opened. ``sequence`` is the number in the
    stream, ``record`` the ids. To resume, pass the first slot that was not yet read."""
    stop = order.sequences if stop is None else min(stop, order.sequences)

    @F.pandas_udf("bigint")
    def number(slots: pd.Series) -> pd.Series:
        return pd.Series(permute(slots.to_numpy(np.int64), order.sequences, order.key, back=True))

    start = max(start, 0)
    if start >= stop:
        return spark.createDataFrame([], "slot bigint, shard int, place bigint, sequence bigint, record binary")
    first, last = start // order.shard_records, (stop - 1) // order.shard_records
    whole = start == 0 and stop == order.sequences
    named = order.folder if whole else f"{order.folder}/part-{{{','.join(f'{n:05d}' for n in range(first, last + 1))}}}-*"
    files = spark.read.format("binaryFile").load(named)
    shard = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("int")
    held = files.select(shard.alias("shard"), "content").where(F.col("shard").between(first, last))
    places = F.sequence(F.lit(0).cast("long"), (F.length("content") / order.stride).cast("long") - 1)
    rows = held.where(F.length("content") > 0).select("shard", "content", F.explode(places).alias("place"))
    rows = rows.select((F.col("shard").cast("long") * order.shard_records + F.col("place")).alias("slot"), "shard", "place",
                       F.substring(F.col("content"), (F.col("place") * order.stride + 1).cast("int"), F.lit(order.length)).alias("record"))
    return rows.where(F.col("slot").between(start, stop - 1)).select("slot", "shard", "place", number("slot").alias("sequence"), "record")
