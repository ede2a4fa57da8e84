"""Words of a whole Arrow batch of texts, found with a few numpy passes over its UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64

# fixed values: bytes of white space, bytes of word characters after lower-casing
SPACE_BYTES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[SPACE_BYTES] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; a longer text makes a run of its own."""
    if batch.num_rows == 0:
        return
    at = offsets_of(batch.column(batch.schema.get_field_index(column))).astype(np.int64)
    ends, first, base = at[1:], 0, int(at[0])
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(first, last - first)
        base, first = int(ends[last - 1]), last


def offsets_of(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    if len(array) == 0:
        return np.zeros(1, kind)
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins and ends. Null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    at = offsets_of(array).astype(np.int64)
    data = array.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    buf: np.ndarray  # bytes that the spans point into
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # for each text, the number of its first word; one more entry at the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def words_of(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes that ``inside`` marks, never across two texts."""
    mask = inside[buf]
    before = np.empty_like(mask)
    after = np.empty_like(mask)
    if len(mask):
        before[0] = after[-1] = False
        before[1:] = mask[:-1]
        after[:-1] = mask[1:]
        edges = at[(at > 0) & (at < len(buf))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, at, side="left"))


_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
RUN = 1 << 20  # bytes that word hashes are summed over at a time, longer words aside
BITS_RUN = 1 << 16  # values whose bits are unpacked at a time
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` from 0 on; only a table of ``RUN`` entries is kept."""
    if n <= RUN and base in _powers:
        return _powers[base][:n]
    table = np.full(max(n, RUN), base, U)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if n <= RUN:
        _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, taken from running sums over runs of words, then mixed."""
    out, i = np.empty(len(w.starts), U), 0
    while i < len(out):
        begin = int(w.starts[i])
        j = max(i + 1, int(np.searchsorted(w.ends, begin + RUN, side="right")))
        n = int(w.ends[j - 1]) - begin
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum((w.buf[begin : begin + n].astype(U) + U(1)) * _power_table(_MULT, n), out=sums[1:])
        out[i:j] = (sums[w.ends[i:j] - begin] - sums[w.starts[i:j] - begin]) * _power_table(_INVERSE, n)[w.starts[i:j] - begin]
        i = j
    return mix(out)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words, by the number of its first word."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for j in range(n):
        out = out * U(0xC2B2AE3D27D4EB4F) + h[j : j + len(out)]
    return mix(out)


def bit_sums(run: Callable[[int, int], np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each group's values; ``run(i, j)`` gives values i to j of all groups one after another."""
    edges = np.concatenate(([0], np.cumsum(sizes)))
    ones = np.zeros((len(sizes), 64), np.int64)
    for i in range(0, int(edges[-1]), BITS_RUN):
        j = min(i + BITS_RUN, int(edges[-1]))
        first, last = int(np.searchsorted(edges, i, side="right")) - 1, int(np.searchsorted(edges, j, side="left"))
        bits = np.unpackbits(run(i, j).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = first + np.flatnonzero(sizes[first:last])
        ones[some] += np.add.reduceat(bits, np.maximum(edges[some], i) - i, axis=0, dtype=np.int32)
    return ones


def majority(ones: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the bits that over half the values of each group have."""
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def squeezed(w: Words) -> Words:
    """The same words in a buffer with one space between the words of a text."""
    lengths = w.ends - w.starts
    if len(lengths) == 0:
        return Words(np.zeros(0, np.uint8), w.starts, w.ends, w.first)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    keep = np.zeros(len(w.buf) + 1, np.int8)
    keep[w.starts] += 1
    keep[w.ends] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    room = np.ones(len(out), bool)
    room[starts + lengths] = False
    out[room] = w.buf[inside]
    return Words(out, starts, starts + lengths, w.first)


# fixed values: the five primes of XXH64
P1, P2, P3, P4, P5 = (
    U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer at once."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
        length = (ends - starts).astype(np.int64)
        at = starts.astype(np.int64).copy()
        acc = np.full(len(at), U(seed) + P5, U)
        stripes = length // 32
        long = np.flatnonzero(stripes)
        if len(long):
            v = [np.full(len(long), x, U) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
            left, here = stripes[long].copy(), at[long].copy()
            live = np.arange(len(long))
            while len(live):
                for j in range(4):
                    v[j][live] = _round(v[j][live], eight[here[live] + 8 * j])
                here[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            total = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                total = (total ^ _round(np.zeros(len(x), U), x)) * P1 + P4
            acc[long] = total
            at[long] = here
        acc += length.astype(U)
        rest = length % 32
        for _ in range(3):
            i = np.flatnonzero(rest >= 8)
            if not len(i):
                break
            acc[i] = _rotl(acc[i] ^ _round(np.zeros(len(i), U), eight[at[i]]), 27) * P1 + P4
            at[i] += 8
            rest[i] -= 8
        i = np.flatnonzero(rest >= 4)
        if len(i):
            acc[i] = _rotl(acc[i] ^ (four[at[i]].astype(U) * P1), 23) * P2 + P3
            at[i] += 4
            rest[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(rest >= 1)
            if not len(i):
                break
            acc[i] = _rotl(acc[i] ^ (padded[at[i]].astype(U) * P5), 11) * P1
            at[i] += 1
            rest[i] -= 1
        acc ^= acc >> U(33)
        acc *= P2
        acc ^= acc >> U(29)
        acc *= P3
        return acc ^ (acc >> U(32))
