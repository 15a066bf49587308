"""Benchmark decontamination by one Aho-Corasick automaton.

Every run of 13 item words (a whole item, if it has fewer) is a pattern of the automaton, whose
letters are word numbers. A text is lower-cased, cut into words and run through the automaton once;
each match ends at a word, and word numbers lead back to offsets of the text as it came.

The automaton is held by every worker, so its size is bounded: items are dealt into blocks of at
most ``BLOCK_BYTES`` of text, usually one, and each block has an automaton of its own. All texts
meet all blocks; what the blocks find is joined per document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, give_back

WINDOW = 13
SHARE = 20            # a document is contaminated if at least one word in SHARE is hit
BLOCK_BYTES = 4 << 20
RUN = 10_000          # windows of an item that are kept together
CHUNK = 4 << 20       # bytes of a text that are cut into words at a time
# Bytes that no word holds become spaces, A-Z become a-z; bytes from 0x80 belong to words.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "struct<n_words: bigint, items: array<string>, spans: array<struct<first: bigint, last: bigint, start: bigint, stop: bigint>>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split()


class Scanner:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - WINDOW + 1) if words else 0):
                windows.setdefault(tuple(words[at:at + WINDOW]), set()).add(item_id)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in windows.items():
            self.machine.add_word(window, (len(window), tuple(sorted(ids))))
        self.machine.make_automaton()
        self.empty = not windows

    def scan(self, text: str) -> tuple[int, set[str], list[tuple[int, int]]]:
        """Words of the text, items met, and the runs of hit words (first, last), apart and in order."""
        raw = text.encode("utf-8", "replace").translate(TABLE)
        n, at, tail = 0, 0, ()
        items: set[str] = set()
        found: list[tuple[int, int]] = []
        number = self.number.get
        while at < len(raw):
            stop = len(raw)
            if stop - at > CHUNK:  # cut where a word ends
                stop = raw.rfind(b" ", at, at + CHUNK) + 1
                if stop <= at:
                    stop = (raw.find(b" ", at) + 1) or len(raw)
            words = raw[at:stop].split()
            at = stop
            if not self.empty:
                letters = (*tail, *[number(w, 0) for w in words])
                shift = n - len(tail)
                for end, (length, ids) in self.machine.iter(letters):
                    found.append((shift + end - length + 1, shift + end))
                    items.update(ids)
                tail = letters[-(WINDOW - 1):]
            n += len(words)
        return n, items, union(found)

    def row(self, text: str | None) -> tuple:
        if not text:
            return 0, [], []
        n, items, runs = self.scan(text)
        if not runs:
            return n, [], []
        spans, run = [], iter(runs)
        first, last = next(run)
        start = 0
        for k, m in enumerate(WORD.finditer(text)):
            if k == first:
                start = m.start()
            if k == last:
                spans.append((first, last, start, m.end()))
                first, last = next(run, (-1, -1))
                if first < 0:
                    break
        return n, sorted(items), spans


def union(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that meet or touch become one."""
    out: list[list[int]] = []
    for first, last in sorted(set(found)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


_SCANNERS: dict[str, Scanner] = {}


def scan_block(texts: Column, items, key: str) -> Column:
    """Hits of one block; ``items`` is the block's broadcast list of (item id, text)."""
    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _SCANNERS:  # one automaton for each worker process
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(items.value)
        scanner = _SCANNERS[key]
        for batch in batches:
            yield pd.DataFrame([scanner.row(t) for t in batch], columns=["n_words", "items", "spans"])
        give_back()

    return hits(texts)


def blocks_of(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one at a time. A long item is cut into overlapping runs
    of words, so that each of its windows is in one run."""
    words = F.regexp_extract_all(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    runs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("words") - (WINDOW - 1)) / RUN).cast("int") - 1))
    named = (items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), words.alias("words")).where(F.size("words") > 0)
             .select("id", F.explode(F.transform(runs, lambda k: F.array_join(F.slice("words", k * RUN + 1, RUN + WINDOW - 1), " "))).alias("text")).distinct())
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = 1 + total // block_bytes
    for part in range(parts):
        block = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield [(r["id"], r["text"]) for r in block.collect()]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items``, ``spans`` and ``contaminated`` to ``docs``.

    ``spans`` are the runs of hit words: numbers of the first and last word, and the offsets (code
    points, end exclusive) of the run in the text as it came. A document is contaminated if a word
    is hit and at least one word in 20 is. A null or empty text has no words and no hits; items with
    null or empty texts, or without words, match nothing; an item with a null id has the empty id;
    equal windows of several items count for each of them. Other columns stay; columns of the names
    above are replaced. No items: nothing is hit.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = docs
    names = []
    for block in blocks_of(items, item_id, item_text, block_bytes):
        names.append(f"__hits_{len(names)}")
        found = found.withColumn(names[-1], scan_block(F.col(f"`{text}`"), spark.sparkContext.broadcast(block), uuid.uuid4().hex))
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{n}.spans") for n in names])))
    if len(names) > 1:  # runs of several blocks may overlap
        spans = F.aggregate(spans, F.array().cast("array<struct<first: bigint, last: bigint, start: bigint, stop: bigint>>"), _joined)
    items_met = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
    found = found.withColumns({"n_words": F.col(f"{names[0]}.n_words"), "items": items_met, "spans": spans}).drop(*names)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _joined(runs: Column, s: Column) -> Column:
    top = F.element_at(runs, -1)
    wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["stop"], s["stop"]).alias("stop"))
    return F.when((F.size(runs) > 0) & (s["first"] <= F.try_element_at(runs, F.lit(-1))["last"] + 1),
                  F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(wider))).otherwise(F.concat(runs, F.array(s)))
