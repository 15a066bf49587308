"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's set of shingles gives a signature: for each of ``COORDINATES`` orders of all shingles the least
of its own. Two sets agree on a coordinate with the probability of their Jaccard similarity, so a pair
from 0.8 on agrees on ``MATCHES`` of 64 or more but for two cases in 10 ** 8. Sets are posted under their
(coordinate, value) pairs. A pair that only one set has can lead nowhere and is dropped, and so are sets
with fewer than ``MATCHES`` of them left. Of the rest each set's rarest are its prefix, as many as it has
beyond ``MATCHES - 1``: two sets with enough in common meet in their prefixes. Long lists are skipped in
that way; they are only probed, when the collisions of a pair that met are counted. Pairs with enough
collisions are confirmed on their full sets.

Not all pairs of a list are formed. First each set meets one leader of each of its lists, which grows with
the postings and not with their square; links found give components. Then only pairs of different
components are left to meet, the few outside a list's largest component with all of the list, block
by block in arrays; a list within one component is done. So a large group of near copies costs its own
size and what stays apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back, materialise
from formspark.llm.components import components

SHINGLE = 4
COORDINATES = 64
MATCHES = 32          # collisions that a pair of signatures must have
PERCENT = 80          # similarity of a link, in hundredths
LOW_BITS = 40         # bits of a posting that tell it from others as rare
LARGEST = (1 << 22) - 1   # lists of so many sets and more count as equally long
LEADERS = 8           # orders in which lists choose their leaders: a set meets some leaders, not one a list
FILTER_BITS = 1 << 25 # bits of the filter that keeps texts of other nodes where they are: 4 MB, whatever the tables
BLOCK = 512           # nodes outside a list's largest component that go together
STRIP = 32            # of which so many are compared at a time
CHUNK = 1 << 18       # shingles whose values under all orders are in memory at a time
MEMO = 200_000        # words a worker remembers, within a task
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RANDOM = np.random.Generator(np.random.PCG64(20_240_229))
MULTIPLY = _RANDOM.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hash of a word. Forgotten when it grows large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingles(text: str | None, memo: Words) -> np.ndarray:
    """Distinct hashes of the text's runs of four words, in order. Fewer words are one run; none, no run."""
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * MIX + hashes[k:len(hashes) - size + 1 + k])
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """The least value under each order; the order itself is a multiplication and an addition."""
    least = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(values), CHUNK):
        part = values[at:at + CHUNK]
        for k in range(COORDINATES):
            least[k] = min(least[k], (part * MULTIPLY[k] + ADD[k]).min())
    return least


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of sets that are not empty, many small ones at a time."""
    out = np.empty((len(sets), COORDINATES), np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= CHUNK):
            total += len(sets[last])
            last += 1
        if last == first + 1:
            out[first] = signature(sets[first])
        else:
            values = np.concatenate(sets[first:last])
            starts = np.cumsum([0, *map(len, sets[first:last - 1])])
            for k in range(COORDINATES):
                out[first:last, k] = np.minimum.reduceat(values * MULTIPLY[k] + ADD[k], starts)
        first = last
    return out


def postings(minima: np.ndarray) -> np.ndarray:
    """A number for each coordinate and value: the coordinate is in the low bits."""
    return (mixed(minima) & ~np.uint64(COORDINATES - 1) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(id, key, n_shingles, set, posts) of (id, text): ``key`` is a hash of the text, ``set`` is a digest of the set of shingles, ``posts`` the
    postings of its signature, both null where the set is empty."""
    bounded_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            sets = [shingles(t, memo) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            posts = iter(postings(signatures(full)) if full else ())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(posts) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["id", "key", "n_shingles", "set", "posts"])
        memo.clear()
        give_back()

    return docs.select("id", F.xxhash64("text").alias("key"), "text").mapInArrow(sketch, "id bigint, key bigint, n_shingles bigint, set binary, posts array<bigint>")


def live_lists(sets: DataFrame) -> DataFrame:
    """(node, n_shingles, live) of (node, n_shingles, posts): the postings that other sets share, rarest first,
    of those sets that have enough of them to match any other. A posting's number is led by how many
    sets share it, so that numbers compare as rarity does; the coordinate stays in the low bits.

    Two sets with enough matches share one of any ``COORDINATES - MATCHES + 1`` coordinates: sets that
    share none of the first so many are left out before the rest of their postings is looked at."""
    def shared(posts: DataFrame) -> DataFrame:
        return posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")

    some = sets.select("node", F.explode(F.slice("posts", 1, COORDINATES - MATCHES + 1)).alias("post"))
    able = materialise(some.join(shared(some), "post", "left_semi").select("node").distinct())
    posts = sets.join(able, "node", "left_semi").select("node", F.explode("posts").alias("post"))
    number = F.shiftleft(F.least("n", F.lit(LARGEST)), LOW_BITS).bitwiseOR(F.col("post").bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    live = posts.join(shared(posts), "post").groupBy("node").agg(F.sort_array(F.collect_list(number)).alias("live"))
    return live.where(F.size("live") >= MATCHES).join(sets.select("node", "n_shingles"), "node")


def maybe_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``__key`` is no ``key`` of ``wanted``, by a bitmap of fixed size."""
    bits = wanted.select(F.pmod("key", F.lit(FILTER_BITS)).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    at = F.pmod("__key", F.lit(FILTER_BITS))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "__bucket")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("__bucket", "__bits")


def of_nodes(sets: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes): full sets of ``nodes``, made again from the texts they came from."""
    wanted = sets.join(nodes, "node", "left_semi").select("node", F.col("set").alias("own"), F.col("first").alias("__id"), "key")
    rows = maybe_in(docs.withColumn("__key", F.xxhash64("text")), wanted)
    texts = rows.join(wanted, (F.col("__key") == F.col("key")) & F.col("id").eqNullSafe(F.col("__id"))).select("node", "own", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            made = [shingles(t, memo) for t in batch.column("text").to_pylist()]
            right = [xxhash.xxh3_128_digest(s) == own for s, own in zip(made, batch.column("own").to_pylist(), strict=True)]  # texts of one hash may differ
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column("node"), pa.array(right, pa.bool_())),
                                              pa.array([s.view(np.int64) for s, r in zip(made, right, strict=True) if r], pa.list_(pa.int64()))], names=["node", "hashes"])
        memo.clear()
        give_back()

    return texts.mapInArrow(full, "node bigint, hashes array<bigint>").groupBy("node").agg(F.first("hashes").alias("hashes"))  # equal rows


def confirmed(pairs: DataFrame, live: DataFrame, hashes: DataFrame) -> DataFrame:
    """Those (u, v) of ``pairs``, which may repeat, that have enough collisions and are similar enough."""
    def side(name: str, table: DataFrame) -> DataFrame:
        return table.select(*[F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in table.columns])

    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    pairs = pairs.join(side("u", live), "u").join(side("v", live), "v")
    pairs = pairs.where((100 * F.least("u_n_shingles", "v_n_shingles") >= PERCENT * F.greatest("u_n_shingles", "v_n_shingles"))
                        & (F.size(F.array_intersect("u_live", "v_live")) >= MATCHES)).select("u", "v")
    both = pairs.join(side("u", hashes), "u").join(side("v", hashes), "v")
    common = F.size(F.array_intersect("u_hashes", "v_hashes"))
    return both.where(100 * common >= PERCENT * (F.size("u_hashes") + F.size("v_hashes") - common)).select("u", "v")


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): links between nodes that join the same components as all links."""
    live = materialise(live_lists(sets))
    prefix = live.select("node", F.explode(F.slice("live", F.lit(1), F.size("live") - (MATCHES - 1))).alias("post"))
    sizes = prefix.groupBy("post").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.col("post") % LEADERS)).alias("leader")).where("n > 1")
    lists = materialise(prefix.join(sizes, "post").select("post", "node", "leader"))
    hashes = materialise(of_nodes(sets, docs, lists.select("node").distinct()))
    found = materialise(confirmed(lists.select(F.col("node").alias("u"), F.col("leader").alias("v")), live, hashes))
    return found.union(across(lists, live, components(found), hashes))


def across(lists: DataFrame, live: DataFrame, labels: DataFrame, hashes: DataFrame) -> DataFrame:
    """(u, v): links between nodes of a list that are in different components.

    The nodes outside a list's largest component, in blocks, meet all nodes of the list. A pair is
    looked at in the rarest list that both are in, and leads on if it has enough collisions. What
    leads on in a block is one row of pairs; their sets are fetched once a block and compared there.
    """
    known = materialise(lists.select("post", "node").join(labels, "node", "left").select("post", "node", F.coalesce("label", "node").alias("label")))
    parts = known.groupBy("post", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("post").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    largest = materialise(largest.select("post", "main", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks")))
    rows = known.join(largest, "post").join(live, "node").withColumn("is_main", F.col("label") == F.col("main"))
    own = F.when(~F.col("is_main"), F.array(F.struct(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"))))
    all_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("side")))
    dealt = rows.select("post", F.explode(F.concat(F.coalesce(own, F.array().cast("array<struct<block: int, side: int>>")), all_blocks)).alias("at"), "node", "label", "is_main", "n_shingles", "live")
    dealt = dealt.select("post", "at.block", "at.side", "node", "label", "is_main", "n_shingles", "live").repartition("post", "block").sortWithinPartitions("post", "block", "side")
    met = dealt.mapInArrow(_meet, "us array<bigint>, vs array<bigint>, u_labels array<bigint>, v_labels array<bigint>")
    met = materialise(met.withColumn("cell", F.monotonically_increasing_id()))

    wanted = met.select("cell", F.explode(F.array_distinct(F.concat("us", "vs"))).alias("node")).join(hashes, "node")
    none = F.lit(None).cast("array<bigint>")
    both = met.select("cell", F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("node"), none.alias("hashes"), "us", "vs", "u_labels", "v_labels").unionByName(
        wanted.select("cell", F.lit(0).alias("side"), "node", "hashes", *[none.alias(c) for c in ("us", "vs", "u_labels", "v_labels")]))
    return both.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_compare, "u bigint, v bigint")


def _runs(*columns: np.ndarray) -> list[int]:
    """Where rows begin that differ from the one before in any column, and the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return [0, *np.flatnonzero(new).tolist(), len(new)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with enough collisions, of the rows of a block (side 0) and the rows of its list (side 1), which follow."""
    held: list[tuple[np.ndarray, ...]] = []
    cell = None
    for batch in batches:
        post, block, side, node, label, is_main, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        listed = batch.column(7)
        flat = listed.flatten().to_numpy(zero_copy_only=False)
        keys = np.zeros((len(post), COORDINATES), np.int64)
        keys[np.repeat(np.arange(len(post)), listed.value_lengths().to_numpy(zero_copy_only=False)), flat & (COORDINATES - 1)] = flat
        cuts = _runs(post, block, side) if len(post) else [0]
        out: list[list[np.ndarray]] = []
        for at, stop in zip(cuts, cuts[1:], strict=False):
            rows = slice(at, stop)
            if cell != (post[at], block[at]):
                cell, held = (post[at], block[at]), []
            if side[at] == 0:
                held.append((node[rows], label[rows], n[rows], keys[rows]))
                continue
            for own in held:
                for j in range(at, stop, BLOCK):
                    seen = slice(j, min(j + BLOCK, stop))
                    found: list[list[np.ndarray]] = []
                    for k in range(0, len(own[0]), STRIP):
                        us, ul, un, uk = (x[k:k + STRIP] for x in own)
                        same = (uk[:, None, :] == keys[seen][None]) & (uk != 0)[:, None, :]
                        hit = same.sum(axis=2) >= MATCHES
                        hit &= ~(same & (uk < post[at])[:, None, :]).any(axis=2)  # both are in a rarer list
                        hit &= (ul[:, None] != label[seen][None]) & (is_main[seen][None] | (us[:, None] < node[seen][None]))
                        low, high = np.minimum(un[:, None], n[seen][None]), np.maximum(un[:, None], n[seen][None])
                        a, b = np.nonzero(hit & (100 * low >= PERCENT * high))
                        if len(a):
                            found.append([us[a], node[seen][b], ul[a], label[seen][b]])
                    if found:
                        out.append([np.concatenate(x) for x in zip(*found, strict=True)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.list_(pa.int64())) for c in range(4)], names=["us", "vs", "u_labels", "v_labels"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the pairs of a cell (side 1), whose sets came before; one is enough between two components."""
    cell, sets = None, {}
    for batch in batches:
        u_out: list[int] = []
        v_out: list[int] = []
        columns = [batch.column(k) for k in range(8)]
        for k in range(batch.num_rows):
            if columns[0][k].as_py() != cell:
                cell, sets = columns[0][k].as_py(), {}
            if columns[1][k].as_py() == 0:
                sets[columns[2][k].as_py()] = frozenset(columns[3][k].values.to_numpy(zero_copy_only=False).tolist())
                continue
            joined: dict[int, int] = {}

            def top(x: int) -> int:
                while x in joined:  # noqa: B023 - used at once
                    x = joined[x]  # noqa: B023
                return x

            for u, v, a, b in zip(*(columns[c][k].as_py() for c in (4, 5, 6, 7)), strict=True):
                a, b = top(a), top(b)
                if a == b:
                    continue
                common = len(sets[u] & sets[v])
                if 100 * common >= PERCENT * (len(sets[u]) + len(sets[v]) - common):
                    joined[a] = b
                    u_out.append(u)
                    v_out.append(v)
        if u_out:
            yield pa.RecordBatch.from_arrays([pa.array(u_out, pa.int64()), pa.array(v_out, pa.int64())], names=["u", "v"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``n_shingles`` is the size of the text's set of runs of four words; ``component_id`` the smallest id
    reachable by links of at least 0.8, the row's own included; ``kept`` says that they are the same. Null
    and empty texts, and texts without words, have an empty set and are linked with nothing. Rows that
    repeat are returned as often as they come, each with the same answer. Rows with a null id take part;
    where a whole component has no id, its component_id is null and its rows are kept. An empty table
    gives no rows. Other columns are left out, whatever their names; ids are whole numbers.

    Equal sets are one node from the start, so copies cost a row each. Texts move once, those alone that
    share enough coordinates with another.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    marks = materialise(sketched(docs))
    sets = marks.where("set is not null").groupBy("set").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("posts").alias("posts"))
    sets = materialise(sets.select("set", F.col("row.id").alias("first"), "row.key", "n_shingles", "posts", F.monotonically_increasing_id().alias("node")))
    labels = components(links(sets, docs))
    grouped = sets.select("node", "set", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("first").alias("component"))
    component = materialise(grouped.join(least, "label").select("set", "component"))
    found = marks.select("id", "n_shingles", "set").join(component, "set", "left")
    own = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select(F.col("id").alias(doc_id), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
