"""A probabilistic suffix tree over words, learnt and applied by joins.

States are contexts of up to ``depth`` words.  A context is a candidate if it
is frequent; it is kept if the next word after it is distributed otherwise than
after its longest proper suffix (count times Kullback-Leibler divergence), or if
a longer kept context begins or ends with it.  What follows a state is smoothed
towards its suffix:

    P(s | c) = (n(cs) + prior P(s | suffix of c)) / (n(c) + prior)

for words s seen often enough after c, and a share of P(s | suffix of c) for all
others, so that each state's probabilities add up to one.  The root, without
context, is the add-one estimate over words.  A word's probability is that of
the longest state that its past ends with.

The logarithm of that is a sum over the text's word sequences: each stored
sequence g = cs adds log P(s | c) - log P(s | suffix of c) - log share(c), and
each that is a state adds log share(g) for the word after it.  So the tree is
one table from a sequence's hash to a number, and scoring adds up numbers.  The
most frequent words, states and other sequences, fixed numbers of them, go to all
tasks; the rest, which grows with the corpus, is asked for what a bitmap of fixed
size doesn't sort out, and answers with sums for each text.  Nothing else is sent
anywhere whole.

What tasks count or ask for is dealt out by ranges of keys as packed columns, one
row for each batch and range: sorted numbers as their steps, bytes of equal
weight together.  A sequence of a context and a word that all tasks have is known
by their two numbers, which take less room than its hash; others by the hash.

Words and sequences are known by 64-bit hashes: of v distinct ones some two are
expected to agree with probability v * v / 2^65.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import passing, stored
from .common import broadcast_if_small, table, text_of
from .textbytes import LOWER, NOT_SPACE, P1, P2, P3, P4, P5, U, Words, bytes_of, slices, word_hashes, words_of

END, BEGIN = 1, 2  # keys of the end of a text, which is a word to predict, and of its beginning, which is only a context
BLOCK = 1 << 20  # bytes whose words are hashed together
SCALE = float(1 << 32)  # log10 values are added as integers, so sums don't depend on their order
UNITS = float(1 << 48)  # the same for probabilities
MOST_BITS = 26
RANGE = 1 << 21  # words of the corpus for each range of keys


@dataclass(frozen=True)
class Settings:
    """``context``: occurrences that make a context a candidate. ``pair``: those that store a word after it. ``test``: divergence, in nats times occurrences, that keeps it."""

    depth: int = 3
    context: int = 64
    pair: int = 4
    prior: float = 8.0
    test: float = 16.0
    head: int = 1 << 18  # sequences that are sent to all tasks
    listed: int = 1 << 20  # contexts, and words, that all tasks have a number for
    held: int = 1 << 22  # sequences that a task gathers before it gives them out, packed


@dataclass(frozen=True)
class Tree:
    """``rows(key, prefix, word, score, base, known, grow, n)``: sequences, of a prefix and a word if they are longer, with their additions; ``tokens`` and ``words`` of the corpus."""

    rows: DataFrame
    tokens: int
    words: int
    settings: Settings

    @property
    def range_bits(self) -> int:
        return _range_bits(self.tokens)


def _range_bits(tokens: int) -> int:
    """64 ranges of keys or more, in proportion to the corpus."""
    return min(24, max(6, math.ceil(math.log2(max(1, tokens) / RANGE))))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Steps made in here drop their shuffle files once their result is written, instead of at some later time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hash_long(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8 bytes each, as Spark's ``xxhash64`` has it for a bigint."""
    with np.errstate(over="ignore"):
        k = value * P2
        h = (np.asarray(seed, U) + P5 + U(8)) ^ (((k << U(31)) | (k >> U(33))) * P1)
        h = ((h << U(27)) | (h >> U(37))) * P1 + P4
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


def joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a sequence with one more word; ``xxhash64(before, word)`` in Spark."""
    return hash_long(word, hash_long(before, 42))


@dataclass
class Tokens:
    """Keys of all tokens of a batch, each text between a BEGIN and an END, and where texts begin."""

    key: np.ndarray
    first: np.ndarray

    @property
    def place(self) -> np.ndarray:
        return np.arange(len(self.key)) - np.repeat(self.first[:-1], np.diff(self.first))


def tokens_of(texts: pa.Array) -> Tokens:
    buf, at = bytes_of(texts)
    w = words_of(LOWER[buf], at, NOT_SPACE)
    n = np.diff(w.first)
    first = np.concatenate(([0], np.cumsum(n + 2)))
    key = np.full(int(first[-1]), BEGIN, U)
    key[first[1:] - 1] = END
    inside = np.ones(len(key), bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    key[inside] = _hashes(w)
    return Tokens(key, first)


def _hashes(w: Words) -> np.ndarray:
    """Hashes of words, a megabyte of text at a time: their running sums needn't be as long as the longest text."""
    out, at = np.empty(len(w.starts), U), 0
    while at < len(out):
        low = int(w.starts[at])
        to = max(at + 1, int(np.searchsorted(w.ends, low + BLOCK, side="right")))
        part = Words(w.buf[low : int(w.ends[to - 1])], w.starts[at:to] - low, w.ends[at:to] - low, w.first)
        out[at:to] = word_hashes(part)
        at = to
    return out


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


# counts


def word_counts(texts: DataFrame) -> DataFrame:
    """``(key, n)`` of every word, of END, and of BEGIN, which counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                key, n = np.unique(tokens_of(part.column("text")).key, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(n)], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# packed numbers


def packed(values: np.ndarray) -> bytes:
    """Numbers, most of them small or alike, in little room."""
    wide = np.ascontiguousarray(values).astype("<u8")
    width = (int(wide.max(initial=0)).bit_length() + 7) // 8
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<QB", len(wide), width) + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _steps(ascending: np.ndarray) -> bytes:
    return packed(np.diff(ascending, prepend=U(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=U)


def _cuts(ascending: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, slice]]:
    """Each range of keys of ``bits`` bits that has some, by its number, with the stretch of them."""
    of = (ascending >> U(bits - ranges)).astype(np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    for i, n in zip(at.tolist(), np.diff(at, append=len(of)).tolist(), strict=True):
        yield int(of[i]), slice(i, i + n)


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sum of its ``n``, or else its number."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if n is None:
        return ordered[at], order[at], np.diff(at, append=len(keys))
    return ordered[at], order[at], np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Places:
    """Keys in order, with the place where each stretch of them begins; the last is no key, and what isn't found is there."""

    key: np.ndarray
    starts: np.ndarray
    shift: int

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or of the last if it isn't there."""
        at = self.starts[(keys >> U(self.shift)).astype(np.int64)]
        behind = np.flatnonzero(self.key[at] < keys)
        while len(behind):
            at[behind] += 1
            behind = behind[self.key[at[behind]] < keys[behind]]
        return np.where(self.key[at] == keys, at, len(self.key) - 1)


def _places(ordered: np.ndarray) -> Places:
    bits = max(1, min(22, math.ceil(math.log2(len(ordered) + 2))))
    key = np.append(ordered, U(0xFFFFFFFFFFFFFFFF))
    starts = np.searchsorted(key, np.arange(1 << bits, dtype=U) << U(64 - bits)).astype(np.int32)
    return Places(key, starts, 64 - bits)


@dataclass(frozen=True)
class Listed:
    """The most frequent of some keys; ``whole`` if they are all of them."""

    places: Places
    whole: bool

    def __len__(self) -> int:
        return len(self.places.key) - 1


def _least(rows: DataFrame, room: int) -> tuple[int, int]:
    """``n`` from which on ``rows(n)`` are at most ``room``, a power of two or 0, and the number of rows below."""
    by_size = rows.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect()  # 64 rows at most
    for i, r in enumerate(by_size):
        room -= r["rows"]
        if room < 0:
            return 1 << (r["size"] + 1), sum(x["rows"] for x in by_size[i:])
    return 0, 0


def listed(rows: DataFrame, room: int) -> Listed:
    """Of ``rows(key, n)``."""
    least, below = _least(rows, room)
    key = rows.where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy().view(U)
    return Listed(_places(np.sort(key)), below == 0)


@dataclass(frozen=True)
class Grid:
    """Codes of pairs of one of ``contexts`` and one of ``words`` numbers: spread evenly over ``bits`` bits, and one to one."""

    contexts: int
    words: int
    ranges: int

    @property
    def bits(self) -> int:
        return max(self.ranges, (max(1, self.contexts) * max(1, self.words)).bit_length())

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (context.astype(U) * U(self.words) + word.astype(U)) * U(SPREAD) & U((1 << self.bits) - 1)

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = codes * U(pow(SPREAD, -1, 1 << 64)) & U((1 << self.bits) - 1)
        context, word = np.divmod(plain, U(max(1, self.words)))
        return context.astype(np.int64), word.astype(np.int64)


@dataclass(frozen=True)
class Codes:
    """Codes of listed contexts, each with a listed word."""

    contexts: Listed
    words: Listed
    ranges: int

    @property
    def grid(self) -> Grid:
        return Grid(len(self.contexts), len(self.words), self.ranges)

    def keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        context, word = self.grid.parts(codes)
        return self.contexts.places.key[context], self.words.places.key[word]


SPREAD = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


def _after(keys: np.ndarray, ok: np.ndarray, word: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that ``ok`` marks by their last place, each with the word after it, where ``often`` marks that."""
    follows = np.flatnonzero(ok[:-1] & often[1:]) + 1
    return keys[follows - 1], word[follows]


PACKED_PAIRS = pa.schema([("range", pa.int32()), ("codes", pa.binary()), ("code_n", pa.binary()), ("prefix", pa.binary()), ("word", pa.binary()), ("pair_n", pa.binary())])


class _Held:
    """Pairs of a task that weren't given out yet: codes, and contexts and words of those that have none."""

    def __init__(self, codes: Codes) -> None:
        self.by, self.codes, self.prefix, self.word, self.n = codes, [], [], [], 0

    def add(self, prefix: np.ndarray, word: np.ndarray) -> None:
        by = self.by
        c, w = by.contexts.places.find(prefix), by.words.places.find(word)
        no_c, no_w = c == len(by.contexts), w == len(by.words)
        both = ~(no_c | no_w)
        # what a whole list hasn't is no frequent context, or no word that is seen often enough
        others = np.flatnonzero(~both & ~(no_c & by.contexts.whole) & ~(no_w & by.words.whole))
        self.codes.append(by.grid.of(c[both], w[both]))
        self.prefix.append(prefix[others])
        self.word.append(word[others])
        self.n += len(self.codes[-1]) + len(others)

    def given_out(self) -> pa.RecordBatch:
        rows: dict[int, dict] = {}
        codes, _, n = _summed(np.concatenate(self.codes))
        for r, part in _cuts(codes, self.by.grid.bits, self.by.ranges):
            rows[r] = {"range": r, "codes": _steps(codes[part]), "code_n": packed(n[part])}
        prefix, word = np.concatenate(self.prefix), np.concatenate(self.word)
        key, at, n = _summed(joined(prefix, word))
        for r, part in _cuts(key, 64, self.by.ranges):
            rows[r] = rows.get(r, {"range": r}) | {"prefix": packed(prefix[at[part]]), "word": packed(word[at[part]]), "pair_n": packed(n[part])}
        self.codes, self.prefix, self.word, self.n = [], [], [], 0
        return pa.RecordBatch.from_pylist(list(rows.values()), PACKED_PAIRS)


def pair_counts(texts: DataFrame, sent: Broadcast, level: int, s: Settings) -> DataFrame:
    """``(prefix, word, n)``: how often words follow frequent contexts of ``level`` words, if ``s.pair`` times or more.

    ``sent`` has a bitmap of the contexts, one of sequences of as many words
    that are seen often enough to be stored, and the codes.  A word after a
    context counts if its last ``level`` words are marked: else it can't be
    frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, stored_, by = sent.value
        held = _Held(by)
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                t = tokens_of(part.column("text"))
                place, keys = t.place, t.key
                for _ in range(level - 1):
                    keys = _longer(keys, t.key)
                held.add(*_after(keys, frequent.has(keys) & (place >= level - 1), t.key, stored_.has(keys) & (place >= level)))
                if held.n >= s.held:
                    yield held.given_out()
        if held.n:
            yield held.given_out()

    def total(group: pa.Table) -> pa.Table:
        by, rows = sent.value[2], group.to_pylist()
        some = [r for r in rows if r["codes"] is not None]
        found = []
        if some:
            code, _, n = _summed(np.concatenate([_from_steps(r["codes"]) for r in some]), np.concatenate([unpacked(r["code_n"]) for r in some]).view(np.int64))
            enough = n >= s.pair
            found.append((*by.keys(code[enough]), n[enough]))
        some = [r for r in rows if r["prefix"] is not None]
        if some:
            prefix, word, n = (np.concatenate([unpacked(r[c]) for r in some]) for c in ("prefix", "word", "pair_n"))
            _, at, n = _summed(joined(prefix, word), n.view(np.int64))
            enough = n >= s.pair
            found.append((prefix[at[enough]], word[at[enough]], n[enough]))
        prefix, word, n = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"prefix": _signed(prefix), "word": _signed(word), "n": pa.array(n)})

    asked = texts.select("text").mapInArrow(run, "range int, codes binary, code_n binary, prefix binary, word binary, pair_n binary")
    return asked.groupBy("range").applyInArrow(total, "prefix long, word long, n long")


def _longer(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of sequences one word longer, by the place of their last word; the first place has none that means anything."""
    out = np.empty_like(keys)
    out[:1] = 0
    out[1:] = joined(keys[:-1], word[1:])
    return out


@dataclass(frozen=True)
class Bitmap:
    """A bit for each key's upper bits: no key of it is missed; others may be hit."""

    bits: int
    cells: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> U(64 - self.bits)
        return (self.cells[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & np.uint8(1) != 0


def bitmap(keys: DataFrame, n: int) -> Bitmap:
    """Of ``keys(key)``, ``n`` of them: 16 bits or more for each up to 2^26 bits in all, whatever their number; built by partial sums."""
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(16 * max(1, n)))))
    slot = F.shiftrightunsigned("key", 64 - bits)
    words = keys.groupBy(F.shiftrightunsigned(slot, 6).cast("int").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("word")).toArrow()
    cells = np.zeros(1 << (bits - 6), np.int64)
    cells[words.column("cell").to_numpy()] = words.column("word").to_numpy()
    return Bitmap(bits, cells.astype("<i8").view(np.uint8))


# the tree


def grown(texts: DataFrame, settings: Settings = Settings()) -> Tree:
    """The tree of ``texts(text)``; a null text is an empty one, and a corpus without texts gives a tree that knows no word."""
    with shuffles_freed(texts.sparkSession), passing(texts.sparkSession) as put:
        return _grown(texts.select(text_of().alias("text")), settings, put)


def _grown(texts: DataFrame, s: Settings, put: Callable[[DataFrame], DataFrame]) -> Tree:
    words = put(word_counts(texts))
    seen = words.where(F.col("key") != BEGIN)
    tokens, kinds, frequent = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") >= s.context)).first()
    root = words.select("key", "n", F.lit(None).cast("long").alias("suffix"), F.when(F.col("key") != BEGIN, F.log((F.col("n") + 1) / F.lit(float(tokens + kinds + 1)))).alias("lp"))
    grams = [root]
    contexts = [put(root.where((F.col("n") >= s.context) & (F.col("key") != END)).select("key", "n", "suffix", F.lit(None).cast("long").alias("prefix")))]
    often = words.where(F.col("n") >= s.pair)
    known = listed(often, s.listed) if s.depth else None
    for level in range(1, s.depth + 1):
        marks = bitmap(contexts[-1], frequent + 1 if level == 1 else contexts[-1].count()), bitmap(often, kinds if level == 1 else often.count())
        sent = texts.sparkSession.sparkContext.broadcast((*marks, Codes(listed(contexts[-1], s.listed), known, _range_bits(tokens))))
        grams.append(put(_smoothed(pair_counts(texts, sent, level, s), contexts[-1], grams[-1], level, s)))
        sent.destroy()  # else each executor keeps it on its disk
        often = grams[-1]
        if level < s.depth:
            contexts.append(put(_contexts(grams[-1], s)))
    return Tree(stored(_table(grams, contexts, s, put)), tokens, kinds, s)


def _contexts(grams: DataFrame, s: Settings) -> DataFrame:
    """Stored sequences that are candidates: frequent, and not at a text's end."""
    return grams.where((F.col("n") >= s.context) & (F.col("word") != END)).select("key", "n", "suffix", "prefix")


def _smoothed(counted: DataFrame, contexts: DataFrame, shorter: DataFrame, level: int, s: Settings) -> DataFrame:
    """``(key, prefix, word, suffix, n, total, lp, lp_suffix)`` of words after candidate contexts.

    The suffix of a stored sequence is stored as well: it is at least as frequent.
    """
    known = contexts.select(F.col("key").alias("prefix"), F.col("n").alias("total"), F.col("suffix").alias("shorter"))
    pairs = counted.select("prefix", "word", "n").join(broadcast_if_small(known, 24), "prefix")
    suffix = F.col("word") if level == 1 else F.xxhash64("shorter", "word")
    pairs = pairs.select(F.xxhash64("prefix", "word").alias("key"), "prefix", "word", suffix.alias("suffix"), "n", "total")
    below = shorter.where((F.col("n") >= s.pair) & F.col("lp").isNotNull()).select(F.col("key").alias("suffix"), F.col("lp").alias("lp_suffix"))
    lp = F.log((F.col("n") + s.prior * F.exp("lp_suffix")) / (F.col("total") + s.prior))
    return pairs.join(below, "suffix").withColumn("lp", lp)


def _states(grams: DataFrame, s: Settings) -> DataFrame:
    """``(key, share, passes)`` of contexts with stored words: the log of what is left for others, and the divergence test."""

    def total(value: Column) -> Column:
        return F.sum(F.round(value * UNITS).cast("long")) / UNITS

    p, q = F.exp("lp"), F.exp("lp_suffix")
    summed = grams.groupBy(F.col("prefix").alias("key")).agg(F.max("total").alias("total"), total(p).alias("p"), total(q).alias("q"), total(p * (F.col("lp") - F.col("lp_suffix"))).alias("kl"))
    left, left_below = F.greatest(1 - F.col("p"), F.lit(1e-12)), F.greatest(1 - F.col("q"), F.lit(1e-12))
    share = F.log(left / left_below)
    return summed.select("key", share.alias("share"), ((F.col("kl") + left * share) * F.col("total") >= s.test).alias("passes"))


def _table(grams: list[DataFrame], contexts: list[DataFrame], s: Settings, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Kept states from the longest down, then what each sequence adds."""

    def fixed(nats: Column) -> Column:
        return F.round(nats * (SCALE / math.log(10))).cast("long")

    kept: list[DataFrame] = [None] * (s.depth + 1)
    ends = None  # parts of longer kept contexts
    for level in range(s.depth, 0, -1):
        states = put(_states(grams[level], s))
        mine = states.where("passes").select("key")
        mine = (mine if ends is None else mine.unionByName(ends)).distinct()
        kept[level] = put(mine.join(states, "key", "left").select("key", F.coalesce("share", F.lit(0.0)).alias("share")))
        if level > 1:
            parts = contexts[level - 1].join(broadcast_if_small(kept[level].select("key"), 8), "key", "left_semi")
            ends = parts.select(F.explode(F.array("prefix", "suffix")).alias("key"))
    rows = []
    for level in range(s.depth + 1):
        given = grams[level]
        if level == 0:
            given = given.select("key", F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("word"), "n", F.when(F.col("lp").isNull(), 0).otherwise(F.log(F.col("n") + 1.0)).alias("adds"), F.col("lp").isNotNull().alias("known"))
        else:
            before = broadcast_if_small(kept[level].select(F.col("key").alias("prefix"), F.col("share").alias("given")), 16)
            given = given.join(before, "prefix").select("key", "prefix", "word", "n", (F.col("lp") - F.col("lp_suffix") - F.col("given")).alias("adds"), F.lit(False).alias("known"))
        if level < s.depth:
            given = given.join(broadcast_if_small(kept[level + 1], 16), "key", "left")
        else:
            given = given.withColumn("share", F.lit(None).cast("double"))
        base = F.when(F.col("known"), fixed(F.col("adds"))).otherwise(F.lit(0))
        rows.append(given.select("key", "prefix", "word", "n", (fixed(F.col("adds")) + fixed(F.coalesce("share", F.lit(0.0)))).alias("score"), base.cast("long").alias("base"), "known", F.col("share").isNotNull().alias("grow")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


# scores


@dataclass(frozen=True)
class Head:
    """What all tasks have of the tree, by place, with what it adds; at the last place nothing.  States and words are numbered."""

    places: Places
    score: np.ndarray
    base: np.ndarray
    flags: np.ndarray  # 1: a known word, 2: a state
    word: np.ndarray  # its number, or -1
    state: np.ndarray
    whole: bool  # there are no other states
    ranges: int

    @property
    def grid(self) -> Grid:
        return Grid(int(self.state.max()) + 1, int(self.word.max()) + 1, self.ranges)


def _head(rows: DataFrame, whole: bool, ranges: int) -> Head:
    got = rows.select("key", "score", "base", (F.col("known").cast("int") + 2 * F.col("grow").cast("int")).cast("byte").alias("flags")).toArrow()
    key = got.column("key").to_numpy().view(U)
    order = np.argsort(key)
    score, base, flags = (np.append(got.column(c).to_numpy()[order], 0) for c in ("score", "base", "flags"))
    word, state = (np.where(flags & bit != 0, np.cumsum(flags & bit != 0) - 1, -1).astype(np.int32) for bit in (1, 2))
    return Head(_places(key[order]), score, base, flags, word, state, whole, ranges)


def scored(docs: DataFrame, tree: Tree, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, n_tokens, n_known, base_score, score for each row of ``docs``; repeated rows each get theirs, a null text is empty.

    Scores are log10 probabilities of the words, lower-cased, and of the end.
    """
    with shuffles_freed(docs.sparkSession):
        return _scored(docs, tree, keys, text)


def _scored(docs: DataFrame, tree: Tree, keys: tuple[str, ...], text: str) -> DataFrame:
    s, sc, ranges = tree.settings, docs.sparkSession.sparkContext, tree.range_bits
    least, _ = _least(tree.rows, s.head)
    least_word, _ = _least(tree.rows.where("known"), s.listed)
    least_state, others = _least(tree.rows.where("grow"), s.listed)
    sent = (F.col("n") >= least) | (F.col("known") & (F.col("n") >= least_word)) | (F.col("grow") & (F.col("n") >= least_state))
    head = sc.broadcast(_head(tree.rows.where(sent), others == 0, ranges))
    rest = tree.rows.where(~sent)
    n_rest = rest.count()
    marks = sc.broadcast(bitmap(rest, n_rest) if n_rest else None)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema), "n_tokens long, n_known long, _base long, _score long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, rows, asked, grid, kinds = TaskContext.get().partitionId() << 32, 0, [], head.value.grid, None
        for batch in batches:
            for part in slices(batch, "_text"):
                t = tokens_of(part.column("_text"))
                sums, at, name, coded = _added(t, head.value, grid, marks.value, s.depth)
                n = part.num_rows
                out = pa.table({**{k: part.column(k) for k in keys}, "n_tokens": np.diff(t.first) - 1, "n_known": sums[0], "_base": sums[1], "_score": sums[2], "_flush": np.full(n, flush), "_place": np.arange(rows, rows + n, dtype=np.int32), "_range": pa.nulls(n, pa.int32()), "_coded": pa.nulls(n, pa.bool_()), **{c: pa.nulls(n, pa.binary()) for c in PACKED}})
                kinds = out.schema
                yield from out.to_batches()
                asked.append(((at + rows).astype(np.int32), name, coded))
                rows += n
                if sum(len(x[1]) for x in asked) >= s.held:
                    yield _asked(flush, asked, grid, kinds)
                    flush, rows, asked = flush + 1, 0, []
        if asked:
            yield _asked(flush, asked, grid, kinds)

    found = docs.select(*keys, text_of(text).alias("_text")).mapInArrow(run, f"{schema}, _flush long, _place int, _range int, _coded boolean, _a binary, _b binary, _c binary, _d binary")
    if n_rest:
        found = stored(found)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some: list[pa.RecordBatch] = []
            for batch in batches:
                some.append(batch)
                if sum(x.num_rows for x in some) >= s.held:
                    yield _dealt(pa.Table.from_batches(some), head.value)
                    some = []
            if some:
                yield _dealt(pa.Table.from_batches(some), head.value)

        held = rest.select("key", "prefix", "word", "base", (F.col("score") - F.col("base")).alias("more"), F.col("known").cast("long").alias("known")).mapInArrow(dealt, "_range int, _coded boolean, _a binary, _b binary, _c binary, _d binary")
        asked = found.where("_range is not null").select("_flush", "_range", "_coded", "_a", "_b", "_c")
        answers = asked.groupBy("_range").cogroup(held.groupBy("_range")).applyInArrow(_answered, "_flush long, _a binary, _b binary, _c binary, _d binary")
        both = found.where("_range is null").unionByName(answers, allowMissingColumns=True)
        found = both.groupBy("_flush").applyInArrow(_with_rest, schema)
    each = F.col("n_tokens") * math.log10(tree.tokens + tree.words + 1)
    return found.select(*keys, "n_tokens", "n_known", (F.col("_base") / SCALE - each).alias("base_score"), (F.col("_score") / SCALE - each).alias("score"))


def _added(t: Tokens, head: Head, grid: Grid, marks: Bitmap | None, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """By text: known words, base and score of sequences in the head.  And of those that may be among the rest: the text's number, code or hash, and which it is."""
    n, place = len(t.key), t.place
    score, base, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, keys, state, word = np.arange(n), t.key, np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    rest_at, rest_name, rest_coded = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, bool)]
    for level in range(1, depth + 2):
        where = head.places.find(keys)
        score[at] += head.score[where]
        flags = head.flags[where]
        if level == 1:
            base += head.base[where]
            known += flags & 1
            word = head.word[where]
        grow = flags & 2 != 0
        if marks is not None:
            lost = np.flatnonzero(where == len(head.score) - 1)
            lost = lost[marks.has(keys[lost])]
            coded = (state[lost] >= 0) & (word[at[lost]] >= 0)
            rest_at.append(at[lost])
            rest_name.append(np.where(coded, grid.of(state[lost], word[at[lost]]), keys[lost]))
            rest_coded.append(coded)
            grow[lost] = not head.whole  # whether it is a state isn't known here, if it may be: longer ones are looked up, too
        if level > depth:
            break
        grow &= t.key[at] != END
        keys, at, state = joined(keys[grow], t.key[at[grow] + 1]), at[grow] + 1, head.state[where[grow]]
    ends = np.stack([known, base, score]).cumsum(axis=1)
    ends = np.concatenate([np.zeros((3, 1), np.int64), ends], axis=1)[:, t.first]
    text = np.searchsorted(t.first, np.concatenate(rest_at), side="right") - 1
    return list(np.diff(ends, axis=1)), text, np.concatenate(rest_name), np.concatenate(rest_coded)


def _zigzag(values: np.ndarray) -> np.ndarray:
    return ((values << 1) ^ (values >> 63)).view(U)


def _signs(values: np.ndarray) -> np.ndarray:
    return (values >> U(1)).view(np.int64) ^ -(values & U(1)).view(np.int64)


PACKED = ("_a", "_b", "_c", "_d")


def _asked(flush: int, asked: list[tuple[np.ndarray, ...]], grid: Grid, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each range and kind of names: the names, how often each is asked for, and for which texts."""
    at, name, coded = (np.concatenate(x) for x in zip(*asked, strict=True))
    rows = []
    for kind in (True, False):  # codes, hashes
        mine = np.flatnonzero(coded == kind)
        mine = mine[np.argsort(name[mine], kind="stable")]
        names, _, n = _summed(name[mine])
        ends = np.concatenate(([0], np.cumsum(n)))
        for r, part in _cuts(names, grid.bits if kind else 64, grid.ranges):
            rows.append({"_flush": flush, "_range": r, "_coded": kind, "_a": _steps(names[part]), "_b": packed(n[part]), "_c": packed(at[mine[ends[part.start] : ends[part.stop]]])})
    return pa.RecordBatch.from_pylist(rows, schema)


def _dealt(rows: pa.Table, head: Head) -> pa.RecordBatch:
    """Rows of the rest, packed by range and kind of names, as they are asked for."""
    grid, none = head.grid, len(head.score) - 1
    key, prefix, word = (rows.column(c).fill_null(0).to_numpy().view(U) for c in ("key", "prefix", "word"))
    longer = rows.column("prefix").is_valid().to_numpy()
    c, w = head.places.find(prefix), head.places.find(word)
    c, w = head.state[c], head.word[w]
    coded = longer & (c >= 0) & (w >= 0)
    name = np.where(coded, grid.of(c, w), key)
    values = [rows.column("base").to_numpy().view(U), _zigzag(rows.column("more").to_numpy()), rows.column("known").to_numpy().view(U)]
    out = []
    for kind in (True, False):  # codes, hashes
        mine = np.flatnonzero(coded == kind)
        mine = mine[np.argsort(name[mine])]
        for r, part in _cuts(name[mine], grid.bits if kind else 64, grid.ranges):
            out.append({"_range": r, "_coded": kind, "_a": _steps(name[mine[part]])} | {c: packed(v[mine[part]]) for c, v in zip(PACKED[1:], values, strict=True)})
    return pa.RecordBatch.from_pylist(out, pa.schema([("_range", pa.int32()), ("_coded", pa.bool_()), *((c, pa.binary()) for c in PACKED)]))


def _answered(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """For each batch of texts that asks: the texts that have sequences of ``rows``, and what those add to base, score and known words."""
    out, given, wanted = [], rows.to_pylist(), asked.to_pylist()
    for kind in (True, False):  # codes, hashes
        mine = [r for r in given if r["_coded"] == kind]
        if not mine:
            continue
        name = np.concatenate([_from_steps(r["_a"]) for r in mine])
        order = np.argsort(name)
        name = name[order]
        base, more, known = (np.concatenate([unpacked(r[c]) for r in mine])[order] for c in PACKED[1:])
        base, known = base.view(np.int64), known.view(np.int64)
        score = base + _signs(more)
        for r in wanted:
            if r["_coded"] != kind:
                continue
            names = _from_steps(r["_a"])
            at = np.minimum(np.searchsorted(name, names), len(name) - 1)
            hit = np.repeat(name[at] == names, unpacked(r["_b"]).astype(np.int64))
            at = np.repeat(at, unpacked(r["_b"]).astype(np.int64))[hit]
            texts, place = np.unique(unpacked(r["_c"])[hit], return_inverse=True)
            sums = np.zeros((3, len(texts)), np.int64)
            for total, value in zip(sums, (base, score, known), strict=True):
                np.add.at(total, place, value[at])
            out.append({"_flush": r["_flush"], "_a": _steps(texts), "_b": packed(sums[0]), "_c": packed(_zigzag(sums[1])), "_d": packed(sums[2])})
    return pa.Table.from_pylist(out, pa.schema([("_flush", pa.int64()), *((c, pa.binary()) for c in PACKED)]))


def _with_rest(group: pa.Table) -> pa.Table:
    """Rows of texts with what their sequences among the rest add."""
    texts = group.filter(group.column("_place").is_valid())
    out = texts.select([c for c in group.column_names if c not in ("_flush", "_place", "_range", "_coded", *PACKED)])
    sums = np.zeros((3, texts.num_rows), np.int64)
    for r in group.filter(group.column("_place").is_null()).select(list(PACKED)).to_pylist():
        sums[:, _from_steps(r["_a"]).astype(np.int64)] += np.stack([unpacked(r["_b"]).view(np.int64), _signs(unpacked(r["_c"])), unpacked(r["_d"]).view(np.int64)])
    place = texts.column("_place").to_numpy()
    for name, total in zip(("_base", "_score", "n_known"), sums, strict=True):
        i = out.column_names.index(name)
        out = out.set_column(i, name, pa.array(out.column(i).to_numpy() + total[place]))
    return out


def op12_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a tree of those whose crc32 isn't 2 modulo 7.

    A row for each row of ``documents``, repeated ones too, which count as often
    in the tree.  Null and empty texts are an end alone.  A row without a doc_id
    is learnt from.  An empty table has no rows.  Columns besides doc_id and
    text aren't read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    tree = grown(docs.where("not held_out"))
    out = scored(docs, tree, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")
