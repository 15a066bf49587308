"""crc32 of word n-grams over whole batches of texts, without a step of Python for each word.

Words are found by a table over bytes, and their checksums are computed column by column: first bytes of
all words, second bytes of all, and so on. Checksums are linear, so that of a run of words follows from
those of its words: the checksum so far is moved on by the length of what is added, which a table of that
length does, and combined with the checksum of what is added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20       # bytes of texts that are looked at together
BLOCK = 1 << 18       # words whose runs are in memory at a time
SHORT = 48            # words of up to so many bytes go by tables; longer ones are computed one by one
#: Bytes of a word, in lower case; the others are 0.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0 for b in range(256)], np.uint8)


def byte_table() -> np.ndarray:
    """Checksum steps of one byte: the usual table, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


BYTE = byte_table()


def moves(most: int) -> np.ndarray:
    """Tables that move a checksum on by 0 to ``most`` bytes, flat: (length, byte of the checksum, its value)."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).ravel()
    out = [values]
    for _ in range(most):
        values = BYTE[values & 255] ^ (values >> 8)
        out.append(values)
    return np.concatenate(out)


MOVES = moves(SHORT + 1)
SPACE = np.array([zlib.crc32(b" ")], np.uint32)


def moved(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums moved on by so many bytes each, up to ``SHORT + 1``."""
    base = lengths.astype(np.int32) << 10
    out = MOVES[base + (sums & 255)]
    for k in (1, 2, 3):
        out ^= MOVES[base + (k << 8) + ((sums >> (8 * k)) & 255)]
    return out


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of every word."""
    order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    at, size = starts[order], lengths[order]
    n_long = int(np.searchsorted(-size, -SHORT, side="left")) if len(size) else 0
    sums = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at, size, state = at[n_long:], size[n_long:], sums[n_long:]
    for place in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -place, side="left"))  # words that are longer than the place
        part = state[:n]
        state[:n] = BYTE[(part ^ data[at[:n] + place]) & 255] ^ (part >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = sums ^ np.uint32(0xFFFFFFFF)
    for k in order[:n_long].tolist():
        out[k] = zlib.crc32(data[starts[k]:starts[k] + lengths[k]])
    return out


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes in lower case, ends of texts, number of the first text): whole texts, of ``CHUNK`` bytes
    together or one longer text. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield LOWER[data[offsets[first]:offsets[last]]], offsets[first + 1:last + 1] - offsets[first], first
        first = last


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of every word, of every two and of every three in a row, joined by one space."""
    def spaced_word(k: int) -> bytes:
        return b" " + data[starts[k]:starts[k] + lengths[k]].tobytes()

    one = checksums(data, starts, lengths)
    size = np.where(lengths <= SHORT, lengths, 0)
    after = moved(np.broadcast_to(SPACE, len(one)), size) ^ one  # of a space and the word
    two = moved(one[:-1], size[1:] + 1) ^ after[1:]
    far = np.flatnonzero(lengths > SHORT)
    for k in far[far >= 1].tolist():
        two[k - 1] = zlib.crc32(spaced_word(k), int(one[k - 1]))
    three = moved(two[:-1], size[2:] + 1) ^ after[2:]
    for k in far[far >= 2].tolist():
        three[k - 2] = zlib.crc32(spaced_word(k), int(two[k - 2]))
    return one, two, three


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(checksums of all runs of one to three words, the text that each is in, the words that are new in each
    text up to there), ``BLOCK`` words at a time. Texts are numbered from 0; one may go on in the next block."""
    for data, ends, first in pieces(texts):
        inside = data != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[0] = True
        edge[ends] = True  # texts stand side by side
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        lengths = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 - starts
        del inside, edge
        for at in range(0, len(starts), BLOCK):
            low = max(0, at - 2)  # with the two words before; a run counts where its last word is new
            new = at - low
            block = slice(low, at + BLOCK)
            of = np.searchsorted(ends, starts[block], side="right") + first
            one, two, three = runs(data, starts[block], lengths[block])
            same2 = np.flatnonzero(of[1:] == of[:-1])
            same3 = np.flatnonzero(of[2:] == of[:-2])
            same2, same3 = same2[same2 + 1 >= new], same3[same3 + 2 >= new]
            yield (np.concatenate([one[new:], two[same2], three[same3]]), np.concatenate([of[new:], of[same2], of[same3]]),
                   np.bincount(of[new:], minlength=len(texts)))
