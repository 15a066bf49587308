"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the public pattern; each piece is merged on its own. Over the byte
positions of a piece lies a segment tree: leaf ``p`` holds ``rank * leaves + p`` for the pair that
starts at the live token ``p`` (nothing if the pair has no rank), an inner node the least of its
children. The root is therefore the leftmost pair of least rank. A merge changes three leaves (the
merged token, the token it swallowed, the live neighbour before it) and their paths to the root.

Short pieces, nearly all of them, are merged many at a time: one row of a numpy matrix is one tree,
and one step merges the root of every tree that still has one. Long pieces have a tree of their own.
Pieces that came before are looked up in a bounded memo; a piece's ids never depend on the memo.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back

# The public pattern for texts up to U+02C1, whose letters, numbers and spaces are these.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼-¾", "\\t\\n\x0b\x0c\\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile("[^\x00-ˁ]")
# Letters and numbers of Unicode versions later than the one of the vocabulary's library, which counts them as neither.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_X = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\P{{L}}{_X}]+| ?[^\P{{N}}{_X}]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{_X}])+|\s+(?!\S)|\s+")

NONE = np.int32(2**31 - 1)
SHORT = 64          # bytes of the pieces that are merged many at a time
MEMO = 80_000       # pieces a worker remembers, within a task
PIECES = 30_000     # pieces that are in memory at a time


def pieces(text: str) -> Iterator[str]:
    """The matches of the pattern, in order."""
    return (m.group() for m in (ANY if BEYOND.search(text) else LATIN).finditer(text))


class Pairs:
    """Rank of the merge of two tokens: open addressing in two numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            self.keys[slots[free]] = keys[free]  # the last of equal slots wins, the others go on
            placed = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[placed]]] = np.array(merged, np.int32)[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        self.by_key = dict(zip(keys.tolist(), merged, strict=True))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NONE)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[todo]]
            same = there == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (there != -1)]
        return out


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Ids of pieces by the ranks of one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.ranks = ranks_of(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = Pairs(self.ranks)
        self.memo: dict[str, bytes] = {}

    def merge_one(self, piece: bytes) -> bytes:
        """Merge a piece of any length: O(log length) for each merge."""
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        none = (1 << 40) * leaves
        ids, rank_of = self.single[np.frombuffer(piece, np.uint8)].tolist(), self.pairs.by_key.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def leaf(p: int) -> int:
            rank = rank_of((ids[p] << 20) | ids[after[p]]) if after[p] < n else None
            return none if rank is None else rank * leaves + p

        def put(p: int, key: int) -> None:
            node = leaves + p
            tree[node] = key
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        for p in range(n):
            tree[leaves + p] = leaf(p)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        live = bytearray(b"\x01") * n
        while tree[1] < none:
            rank, p = divmod(tree[1], leaves)
            gone = after[p]
            ids[p], live[gone], after[p] = rank, 0, after[gone]
            if after[p] < n:
                before[after[p]] = p
            put(gone, none)
            put(p, leaf(p))
            if before[p] >= 0:
                put(before[p], leaf(before[p]))
        return np.array([i for i, alive in zip(ids, live, strict=True) if alive], "<u4").tobytes()

    def merge_many(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Merge pieces of 2 to ``leaves`` bytes, one tree a row, all rows at a time."""
        rows = len(words)
        lengths = np.array([len(w) for w in words], np.int32)
        text = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(rows, leaves)
        ids = self.single[text]
        spot = np.arange(leaves, dtype=np.int32)
        after = np.tile(spot + 1, (rows, 1)).astype(np.int32)
        before = np.tile(spot - 1, (rows, 1)).astype(np.int32)
        tree = np.full((rows, 2 * leaves), NONE, np.int32)
        ranks = self.pairs.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, leaves - 1)
        known = (ranks != NONE) & (spot[None, 1:] < lengths[:, None])
        tree[:, leaves:2 * leaves - 1] = np.where(known, ranks * leaves + spot[:-1], NONE)
        width = leaves
        while width > 1:
            width //= 2
            tree[:, width:2 * width] = np.minimum(tree[:, 2 * width:4 * width:2], tree[:, 2 * width + 1:4 * width:2])
        live = spot[None, :] < lengths[:, None]
        flat_ids, flat_after, flat_before, flat_tree, flat_live = (x.reshape(-1) for x in (ids, after, before, tree, live))
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            least = tree[row, 1]
            p = (least % leaves).astype(np.int64)
            base, top, n = row * leaves, row * (2 * leaves), lengths[row]
            gone = flat_after[base + p]
            nxt = flat_after[base + gone]
            flat_ids[base + p] = least // leaves
            flat_live[base + gone] = False
            flat_after[base + p] = nxt
            inside = nxt < n
            flat_before[(base + nxt)[inside]] = p[inside]
            prev = flat_before[base + p]
            left = np.concatenate([base + p, base + np.maximum(prev, 0)])
            right = np.concatenate([base + np.minimum(nxt, leaves - 1), base + p])
            rank = self.pairs.of(flat_ids[left], flat_ids[right])
            start = np.concatenate([p, np.maximum(prev, 0)])
            there = np.concatenate([inside, prev >= 0]) & (rank != NONE)
            key = np.where(there, rank * leaves + start, NONE).astype(np.int32)
            here, ahead = key[:len(p)], key[len(p):]
            flat_tree[top + leaves + gone] = NONE
            flat_tree[top + leaves + p] = here
            has = prev >= 0
            flat_tree[(top + leaves + prev)[has]] = ahead[has]
            node = np.concatenate([leaves + p, leaves + gone, leaves + np.where(has, prev, p)])
            tops = np.concatenate([top, top, top])
            for _ in range(leaves.bit_length() - 1):
                node >>= 1
                child = tops + 2 * node
                flat_tree[tops + node] = np.minimum(flat_tree[child], flat_tree[child + 1])
            row = row[tree[row, 1] != NONE]
        packed = flat_ids[flat_live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, words: set[str]) -> None:
        """Put the ids of these pieces into the memo."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.memo[word] = rank.to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.memo[word] = self.merge_one(raw)
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((word, raw))
        for leaves, group in by_size.items():
            step = max(64, (1 << 18) // leaves)
            for at in range(0, len(group), step):
                part = group[at:at + step]
                self.memo.update(zip((w for w, _ in part), self.merge_many([r for _, r in part], leaves), strict=True))

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of pieces."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set().union(*texts) - self.memo.keys()
        if new:
            self.learn(new)
        return [b"".join(map(self.memo.__getitem__, words)) for words in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, a bounded number of pieces at a time."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            if text is not None and len(text) > 4 * PIECES:  # long: a block of pieces at a time
                out += self.ids(group)
                group, held = [], 0
                stream = pieces(text)
                out.append(b"".join(self.ids([block])[0] for block in iter(lambda s=stream: list(islice(s, PIECES)), [])))
                continue
            words = (ANY if BEYOND.search(text) else LATIN).findall(text) if text else []
            group.append(words)
            held += len(words)
            if held > PIECES:
                out += self.ids(group)
                group, held = [], 0
        return out + self.ids(group)

@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(path)


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    """Bytes of each id."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the token ids of ``text``, packed as little-endian unsigned 32-bit integers.

    ``vocabulary`` is a rank file that every executor has at the same path, as installed libraries
    are. No special tokens; their strings are ordinary text. Null and empty texts give zero ids (an
    empty value, not null). Rows keep their order, number and other columns; a column that is
    already named ``ids`` is replaced. Every piece is merged to the end, whatever its length.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(vocabulary)
        for texts in batches:
            yield pd.Series(own.encode(texts.tolist()), dtype=object)
        own.memo.clear()  # workers outlive their task
        give_back()

    return docs.withColumn(ids, packed(F.col(f"`{text}`")))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that packed ``ids`` stand for; null ids give zero bytes."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = tokens(vocabulary).__getitem__
        for rows in batches:
            yield pd.Series([b"".join(map(token, np.frombuffer(row, "<u4").tolist())) if row else b"" for row in rows], dtype=object)

    return docs.withColumn(decoded, unpacked(F.col(f"`{ids}`")))


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass of one worker: adds ``ids`` and ``decoded``, as they would."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("struct<ids: binary, decoded: binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, token = codec(vocabulary), tokens(vocabulary).__getitem__
        for texts in batches:
            rows = own.encode(texts.tolist())
            yield pd.DataFrame({"ids": pd.Series(rows, dtype=object), "decoded": pd.Series([b"".join(map(token, np.frombuffer(row, "<u4").tolist())) for row in rows], dtype=object)})
        own.memo.clear()
        give_back()

    out = docs.withColumn("__both", both(F.col(f"`{text}`")))
    return out.withColumns({ids: F.col("__both.ids"), decoded: F.col("__both.decoded")}).drop("__both")


def n_tokens(ids: str = "ids") -> Column:
    """Number of ids in a packed value."""
    return (F.octet_length(F.col(f"`{ids}`")) / 4).cast("long")
