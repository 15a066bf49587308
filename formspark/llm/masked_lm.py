"""Document scores by masked pseudo-likelihood.

Tokens are the lower-cased words between white space. The vocabulary is counted over the whole corpus:
the most frequent words have numbers of their own, the others share classes by how they begin. A window
network predicts a token from the ``SIDE`` tokens before and after it: embeddings, one hidden layer, a
softmax over the vocabulary. It is trained in numpy where the data is: every position of every document
is predicted in the training, each task trains a copy on its partition from the same start, and copies are
averaged by the tokens they saw, in two steps, round by round. What is counted, trained on and sent
grows with the corpus.

A document's score is the sum over all of its tokens of the log-probability of each, given the tokens
on both sides: the network's, and for a word of a class its spelling's, given the class. Spelling is a
chain of characters, counted over the whole corpus's words outside of the vocabulary into a table of
fixed size. A class is what words' first two characters say, so its own probability under the chain is
a sum over the table, and what is left for a word sums to one over all words of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, materialise

SIZE = 256          # vocabulary: 0 is beyond the text's ends, then frequent words, then as many buckets
FREQUENT = 127
SIDE = 3
WIDTH = 16          # embedding
HIDDEN = 32
ROUNDS = 1
BATCH = 1024        # places of a training step, the ends of texts included
STEP = 0.05
BLOCK = 1024        # positions that are scored at a time
CHUNK = 1 << 20     # characters of a text that are cut into words at a time
GROUPS = 64         # partial averages that reach the driver
PLAIN = 592         # characters below this code have symbols of their own, the others share the rest
SYMBOLS = 1024      # of the spelling table; the last one is a word's beginning and end
CODES = 0x110000
CONTEXT = [k for k in range(-SIDE, SIDE + 1) if k]
SHAPES = {"embed": (SIZE, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner_bias": (HIDDEN,), "outer": (HIDDEN, SIZE), "outer_bias": (SIZE,)}
Weights = dict[str, np.ndarray]


def start() -> Weights:
    rng = np.random.default_rng(1)
    return {name: (rng.standard_normal(shape) * (0 if name.endswith("bias") else 0.1)).astype(np.float32) for name, shape in SHAPES.items()}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at:at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Texts in lower case, as (number, text), ``CHUNK`` characters together. Longer texts are cut at white space."""
    group: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            stop = at + CHUNK
            if stop < len(text):  # cut at white space, where there is some
                space = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                stop = space if space > at else stop
            group.append((k, text[at:stop].lower()))
            size += len(group[-1][1])
            at = stop
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def symbols(word: str) -> list[int]:
    """A word's characters as symbols, and its end."""
    return [c if c < PLAIN else PLAIN + c % (SYMBOLS - 1 - PLAIN) for c in map(ord, word)] + [SYMBOLS - 1]


def class_of(spelled: list[int]) -> int:
    """The class of a word that begins with these two symbols."""
    return int(_CLASSES[spelled[0], spelled[1]])


#: Symbols of the characters below 0x10000; white space ends words.
_SYMBOLS = np.where(np.arange(1 << 16) < PLAIN, np.arange(1 << 16), PLAIN + np.arange(1 << 16) % (SYMBOLS - 1 - PLAIN)).astype(np.int16)
_SYMBOLS[[c for c in range(1 << 16) if chr(c).isspace()]] = SYMBOLS - 1

#: Class of each pair of first symbols.
_CLASSES = ((np.arange(SYMBOLS, dtype=np.uint32)[:, None] * np.uint32(2_654_435_761) + np.arange(SYMBOLS, dtype=np.uint32)[None, :] * np.uint32(40_503)) >> np.uint32(13)) % np.uint32(SIZE - FREQUENT - 1)


class Spelling:
    """Log-probabilities of words by a chain of symbols, given their class."""

    def __init__(self, pairs: np.ndarray, frequent: list[str]) -> None:
        """``pairs`` counts how often a symbol follows another, of all rare words of the corpus."""
        counts = pairs.astype(np.float64)
        counts[-1, -1] = 0  # a word has a symbol at least
        overall = counts.sum(axis=0) + 1.0
        overall /= overall.sum()
        smoothed = counts + overall  # one more of what follows anything
        smoothed[-1, -1] = 0
        self.chain = np.log(smoothed / smoothed.sum(axis=1, keepdims=True), out=np.full(smoothed.shape, -np.inf), where=smoothed > 0)
        begins = np.exp(self.chain[-1][:, None] + self.chain)
        begins[-1] = 0
        self.classes = np.log(np.bincount(_CLASSES.ravel(), begins.ravel(), SIZE - FREQUENT - 1))
        self.own = set(frequent)
        self.share = float(np.log(-(-(CODES - PLAIN) // (SYMBOLS - 1 - PLAIN))))  # of characters with one symbol

    def log_p(self, word: str) -> float:
        """Zero for a word that has a number of its own."""
        if word in self.own:
            return 0.0
        spelled = symbols(word)
        total = -self.classes[class_of(spelled)] + self.chain[-1, spelled[0]]
        for a, b in zip(spelled, spelled[1:], strict=False):
            total += self.chain[a, b]
        far = sum(c >= PLAIN for c in spelled[:-1])  # characters that share a symbol share its probability
        return float(total - far * self.share)


class Vocabulary(dict):
    """Numbers of words: their own, or that of their class."""

    def __init__(self, frequent: list[str]) -> None:
        super().__init__((w, k + 1) for k, w in enumerate(frequent))

    def __missing__(self, word: str) -> int:
        return FREQUENT + 1 + class_of(symbols(word))

    def numbers(self, texts: list[str | None], spelling: Spelling | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Token numbers of whole texts, and the sums of their rare words' log-probabilities of spelling.

        Many texts are one line of characters: where words begin, their classes and spellings are read
        off it in arrays; only whether a word has a number of its own is looked up word by word."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        spelled = np.zeros(len(texts))
        end = SYMBOLS - 1
        for group in groups(texts):
            line = " ".join(t for _, t in group)
            words = line.split()
            codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
            here = np.full(len(codes) + 1, end, np.int16)
            here[:-1] = _SYMBOLS[np.minimum(codes, 0xFFFF)]
            far = np.flatnonzero(codes > 0xFFFF)
            here[far] = PLAIN + codes[far] % (end - PLAIN)
            before = np.concatenate([[end], here[:-1]]).astype(np.int16)
            starts = np.flatnonzero((here != end) & (before == end))
            own = np.fromiter(map(self.get, words, repeat(0)), np.int16, len(words))
            classes = _CLASSES[here[starts], here[starts + 1]].astype(np.int16)
            ids = np.where(own > 0, own, FREQUENT + 1 + classes).astype(np.int16)
            cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for _, t in group])[:-1])
            for (k, _), part in zip(group, np.split(ids, cuts), strict=True):
                parts[k].append(part)
            if spelling is not None and len(words):
                steps = spelling.chain[before, here]
                steps[(before == end) & (here == end)] = 0
                steps[:-1][(codes >= PLAIN) & (here[:-1] != end)] -= spelling.share
                sums = np.concatenate([[0.0], np.cumsum(steps)])
                stops = np.flatnonzero((here == end) & (before != end))
                each = np.where(own > 0, 0.0, sums[stops + 1] - sums[starts] - spelling.classes[classes])
                for (k, _), part in zip(group, np.split(each, cuts), strict=True):
                    spelled[k] += part.sum()
        return [np.concatenate(p) if p else np.empty(0, np.int16) for p in parts], spelled


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in a row with ``SIDE`` zeros before, between and after the texts; the texts' starts."""
    gap = np.zeros(SIDE, np.int16)
    parts = [gap]
    for t in texts:
        parts += [t, gap]
    starts = np.cumsum([SIDE] + [len(t) + SIDE for t in texts])[:-1]
    return np.concatenate(parts), starts


def logits_of(a: np.ndarray, w: Weights) -> np.ndarray:
    """The classes' logits by rows of the hidden layer and a one, small enough for their exponentials: where
    they could be too large, each row is moved by its greatest."""
    layer = np.vstack([w["outer"], w["outer_bias"]])
    logits = a @ layer
    if np.abs(layer).sum(axis=0).max() > 60:  # the hidden layer is within one
        logits -= logits.max(axis=1, keepdims=True)
    return logits


class Trainer:
    """One copy of the network, moved by AdaGrad steps."""

    def __init__(self, weights: Weights) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.w.items()}

    def step(self, tokens: np.ndarray) -> None:
        """Predict every token between the first and the last ``SIDE``; the ends of texts are no targets.

        The hidden layer's input is a sum of rows of tables, so its gradient is summed by token first:
        one order of the tokens serves all places of the window."""
        w, n = self.w, len(tokens) - 2 * SIDE
        target = tokens[SIDE:SIDE + n]
        real = np.flatnonzero(target)
        if not len(real):
            return
        parts = w["inner"].reshape(2 * SIDE, WIDTH, HIDDEN)
        a = np.ones((n, HIDDEN + 1), np.float32)  # and a one for the bias
        hidden = np.repeat(w["inner_bias"][None, :], n, axis=0)
        for part, k in zip(parts, CONTEXT, strict=True):
            hidden += np.take(w["embed"] @ part, tokens[SIDE + k:SIDE + k + n], axis=0)
        a[:, :-1] = np.tanh(hidden, out=hidden)
        p = logits_of(a, w)
        np.exp(p, out=p)
        outer_t = np.ascontiguousarray(w["outer"].T)
        back = p @ np.column_stack([outer_t, np.ones(SIZE, np.float32)])  # sums of rows are the last column
        scale = (target > 0).astype(np.float32) / len(real)
        over = scale / back[:, -1]
        back = (back[:, :-1] * over[:, None] - np.take(outer_t, target, axis=0) * scale[:, None]) * (1 - hidden * hidden)
        # what tokens add to sums at each place of the window and as targets, in the order of tokens
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        met = ranked[begins]
        padded = np.zeros((len(tokens) + 2 * SIDE, HIDDEN), np.float32)  # no position is beyond the row's ends
        padded[2 * SIDE:2 * SIDE + n] = back
        # a token is at place k of the position k before it: those around it are side by side, the last place first
        around = np.lib.stride_tricks.as_strided(padded, (len(tokens), (2 * SIDE + 1) * HIDDEN), (HIDDEN * 4, 4), writeable=False)
        sums = np.zeros((SIZE, 2 * SIDE + 1, HIDDEN), np.float32)
        sums[met] = np.add.reduceat(around[order], begins, axis=0).reshape(-1, 2 * SIDE + 1, HIDDEN)
        sums = np.ascontiguousarray(sums[:, [SIDE - k for k in CONTEXT]].transpose(1, 0, 2))
        padded[2 * SIDE:2 * SIDE + n] = hidden * scale[:, None]
        own = np.zeros((SIZE, HIDDEN), np.float32)
        own[met] = np.add.reduceat(padded[order + SIDE], begins, axis=0)
        outer = (a * over[:, None]).T @ p
        outer_bias = outer[-1] - np.bincount(target[real], minlength=SIZE).astype(np.float32) / len(real)
        inner = (w["embed"].T @ sums).reshape(w["inner"].shape)
        embed = (sums @ parts.transpose(0, 2, 1)).sum(axis=0)
        for name, g in (("outer", outer[:-1] - own.T), ("outer_bias", outer_bias), ("inner", inner), ("inner_bias", back.sum(axis=0)), ("embed", embed)):
            self.seen[name] += g * g
            w[name] -= STEP * g / np.sqrt(self.seen[name])


@dataclass
class Model:
    """``pairs`` are the counts of the spelling table; without them rare words count as their class alone."""

    frequent: list[str]
    weights: Weights
    pairs: np.ndarray | None = None

    def tables(self) -> np.ndarray:
        """The hidden layer's share of each token at each place of the window."""
        inner = self.weights["inner"].reshape(2 * SIDE, WIDTH, HIDDEN)
        return np.stack([self.weights["embed"] @ part for part in inner])

    def log_p(self, tokens: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Log-probability of each token between the first and the last ``SIDE``, given both sides."""
        n = len(tokens) - 2 * SIDE
        out = np.empty(max(n, 0))
        w = self.weights
        for at in range(0, n, BLOCK):
            m = min(BLOCK, n - at)
            a = np.ones((m, HIDDEN + 1), np.float32)
            hidden = np.repeat(w["inner_bias"][None, :], m, axis=0)
            for table, k in zip(tables, CONTEXT, strict=True):
                hidden += np.take(table, tokens[at + SIDE + k:at + SIDE + k + m], axis=0)
            a[:, :-1] = np.tanh(hidden, out=hidden)
            logits = logits_of(a, w)
            target = logits[np.arange(m), tokens[at + SIDE:at + SIDE + m]]
            np.exp(logits, out=logits)
            out[at:at + m] = target - np.log(logits @ np.ones(SIZE, np.float32))
        return out


def split_words(text: str) -> Column:
    """The words of a text, as Python's ``lower`` and ``split`` have them."""
    return F.filter(F.split(F.lower(F.col(f"`{text}`")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, count) of the whole corpus."""
    return materialise(docs.select(F.explode(split_words(text)).alias("word")).groupBy("word").count())


def frequent_words(counts: DataFrame) -> list[str]:
    """The corpus's most frequent words; ties go to the first in order."""
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(FREQUENT).collect()]


def symbol_pairs(counts: DataFrame, frequent: list[str]) -> np.ndarray:
    """How often each symbol follows each in the words outside of the vocabulary, as often as these come."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        own = set(frequent)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in own:
                    last = SYMBOLS - 1
                    for s in symbols(word):
                        total[last * SYMBOLS + s] += n
                        last = s
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    sums = counts.select("word", "count").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for row in sums.collect():  # a number for each pair of symbols
        out[row["pair"]] = row["n"]
    return out.reshape(SYMBOLS, SYMBOLS)


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Fit the network to all documents; null texts and texts without words teach nothing."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = word_counts(docs, text)
    frequent = frequent_words(counts)
    model, pairs = Model(frequent, start()), symbol_pairs(counts, frequent)
    texts = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            words, trainer, seen = Vocabulary(own.frequent), Trainer(own.weights), 0
            for batch in batches:
                rows = batch.column(0).to_pylist()
                for at in range(0, len(rows), 64):
                    tokens, _ = laid_out(words.numbers(rows[at:at + 64])[0])
                    for first in range(0, len(tokens) - 2 * SIDE, BATCH):
                        trainer.step(tokens[first:first + BATCH + 2 * SIDE])
                    seen += int(np.count_nonzero(tokens))
            if seen:
                group = TaskContext.get().partitionId() % GROUPS
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([(flat(trainer.w).astype(np.float64) * seen).tobytes()], pa.binary())], names=["part", "seen", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist())
            return pa.table({"seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        copies = texts.mapInArrow(learn, "part int, seen bigint, sums binary")
        sums = copies.groupBy("part").applyInArrow(add, "seen bigint, sums binary").collect()  # GROUPS rows at most
        if sums:
            model = Model(frequent, shaped(sum(np.frombuffer(r["sums"], np.float64) for r in sums) / sum(r["seen"] for r in sums)))
    return Model(frequent, model.weights, pairs)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``log_likelihood`` (the sum over all words) and ``per_word`` to ``docs``.

    Null texts and texts without words have no words, a sum of zero and a null mean. Other columns
    stay; columns of the names above are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<n_words: bigint, log_likelihood: double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        words, tables = Vocabulary(own.frequent), own.tables()
        spelling = None if own.pairs is None else Spelling(own.pairs, own.frequent)
        for texts in batches:
            rows, spelled = words.numbers(texts.tolist(), spelling)
            tokens, starts = laid_out(rows)
            sums = np.concatenate([[0.0], np.cumsum(own.log_p(tokens, tables) * (tokens[SIDE:-SIDE] > 0))])
            n = np.array([len(r) for r in rows], np.int64)
            yield pd.DataFrame({"n_words": n, "log_likelihood": sums[starts - SIDE + n] - sums[starts - SIDE] + spelled})

    out = docs.withColumn("__scored", scored(F.col(f"`{text}`")))
    n, total = F.col("__scored.n_words"), F.col("__scored.log_likelihood")
    return out.withColumns({"n_words": n, "log_likelihood": total, "per_word": F.when(n > 0, total / n)}).drop("__scored")
