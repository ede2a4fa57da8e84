"""Phrases looked up in texts by windows of their lengths.

Every stretch of a text that is as long as some phrase gets a hash, by doubling:
a window's is made of those of two windows of a power of two, which may overlap.
The phrases first in order, a bounded number of them, go to all tasks; a text
that holds one of those needs no others, as they come later.  Windows of other
texts are kept if a bitmap of fixed size has them, and joined to the phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
P1, P2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
HEAD, HEAD_CHARS = 1 << 18, 1 << 25  # phrases that all tasks get, and their characters
PIECE = 1 << 20  # characters of texts that are looked through together
BITS = 26


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * P2
    return h ^ (h >> U(29))


def window_hashes(points: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``sizes``, in ascending order, the hashes of all windows of so many code points, by their first place."""
    with np.errstate(over="ignore"):
        power, h = 1, _mixed((points.astype(U) + U(1)) * P1)
        for n in sizes:
            if n > len(points):
                return
            while 2 * power <= n:
                h = _mixed(h[:-power] * P1 + (h[power:] ^ P2))
                power *= 2
            rest = n - power
            yield n, _mixed(h[: len(points) - n + 1] * P1 + h[rest : rest + len(points) - n + 1] + U(n))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_of(phrase: str) -> int:
    """A phrase's hash, as its windows in texts have it; signed."""
    return int(next(window_hashes(points_of(phrase), [len(phrase)]))[1].view(np.int64)[0])


def with_hashes(phrases: DataFrame, phrase: str) -> DataFrame:
    """``phrases`` with ``hash`` of a column of texts that aren't empty."""
    return phrases.withColumn("hash", F.udf(lambda p: hash_of(p), "long")(phrase))


@dataclass(frozen=True)
class Sought:
    """``head``: phrases in order; ``hashes``, sorted, of those at ``places``; ``cells``: a bitmap of all hashes; ``sizes``: all lengths."""

    head: list[str]
    hashes: np.ndarray
    places: np.ndarray
    cells: np.ndarray
    sizes: list[int]
    more: bool

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> U(64 - BITS)
        return np.flatnonzero((self.cells[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & np.uint8(1))


def sought(phrases: DataFrame, head: int = HEAD) -> Sought:
    """Of ``phrases(rank, phrase, hash)``, ranks counted from 0."""
    chars = F.coalesce(F.sum(F.char_length("phrase")), F.lit(0))
    while head and phrases.where(F.col("rank") < head).agg(chars).first()[0] > HEAD_CHARS:
        head //= 2
    sizes = sorted(r[0] for r in phrases.select(F.char_length("phrase")).distinct().collect())
    first = phrases.where(F.col("rank") < head).select("rank", "phrase", "hash").toArrow().sort_by("rank")
    hashes = first.column("hash").to_numpy().view(U)
    order = np.argsort(hashes, kind="stable")
    slot = F.shiftrightunsigned("hash", 64 - BITS)
    words = phrases.groupBy(F.shiftrightunsigned(slot, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) & 63 as int))")).alias("word")).toArrow()
    cells = np.zeros(1 << (BITS - 6), np.int64)
    cells[words.column("cell").to_numpy()] = words.column("word").to_numpy()
    more = not phrases.where(F.col("rank") >= head).isEmpty()
    return Sought(first.column("phrase").to_pylist(), hashes[order], order, cells.astype("<i8").view(np.uint8), sizes, more)


def found_in(texts: list[str], s: Sought) -> tuple[dict[int, int], set[tuple[int, str]]]:
    """The first phrase of the head that each text holds, by their places; of other texts the windows that may be a phrase."""
    whole = "".join(texts)
    points = points_of(whole)
    ends = np.cumsum([len(t) for t in texts])
    of, rank = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    windows: list[tuple[int, np.ndarray, np.ndarray]] = []
    for n, hashes in window_hashes(points, s.sizes):
        at = s.marked(hashes)
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[text]
        at, text = at[inside], text[inside]
        windows.append((n, at, text))
        low = np.searchsorted(s.hashes, hashes[at], side="left")
        while len(low):  # all phrases of one hash
            live = low < len(s.hashes)
            live[live] = s.hashes[low[live]] == hashes[at[live]]
            low, at, text = low[live], at[live], text[live]
            of.append(text)
            rank.append(s.places[low])
            low = low + 1
    of_, rank_ = np.concatenate(of), np.concatenate(rank)
    first: dict[int, int] = {}
    for k in np.lexsort((rank_, of_)):
        t = int(of_[k])
        if t not in first and s.head[rank_[k]] in texts[t]:
            first[t] = int(rank_[k])
    others = set()
    if s.more:
        settled = np.zeros(len(texts), bool)
        settled[list(first)] = True
        for n, at, text in windows:
            open_ = ~settled[text]
            others.update((int(t), whole[i : i + n]) for i, t in zip(at[open_].tolist(), text[open_].tolist()))
    return first, others


def first_ranks(texts: DataFrame, phrases: DataFrame, head: int = HEAD) -> DataFrame:
    """``(id, rank)`` of the first of ``phrases(rank, phrase, hash)`` that each of ``texts(id, text)`` holds."""
    sent = texts.sparkSession.sparkContext.broadcast(sought(phrases, head))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch in batches:
            ids, strings = batch.column(0), batch.column(1).to_pylist()
            low = 0
            while low < len(strings):
                to, size = low, 0
                while to < len(strings) and (to == low or size + len(strings[to]) <= PIECE):
                    size += len(strings[to])
                    to += 1
                first, others = found_in(strings[low:to], s)
                rows = [(low + t, r, None) for t, r in first.items()] + [(low + t, None, w) for t, w in others]
                low = to
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["id", "rank", "phrase"])

    found = texts.select("id", "text").where("text is not null").mapInArrow(run, f"id {kind}, rank long, phrase string")
    if not sent.value.more:
        return found.groupBy("id").agg(F.min("rank").alias("rank"))
    joined = found.join(phrases.select("phrase", F.col("rank").alias("later")), "phrase", "left")
    return joined.groupBy("id").agg(F.min(F.coalesce("rank", "later")).alias("rank")).where("rank is not null")
