"""SimHash near-duplicates, found through Golay-code keys.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits.  Two
fingerprints at most 4 bits apart spread their errors over the segments in one
of two ways: some segment has none, and then one of the other two has at most
2; or every segment has 1 or 2.  So they have in common either an exact segment
with a Golay key of another one (33 bits), or a Golay key of all three
(36 bits).  Both kinds of key are wide enough that chance meetings stay few as
the corpus grows.  Whatever meets under a key is compared bit by bit, so links
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import golay
from .common import cut, keep_rows, spread, table, text_key
from .components import apart, classes_under_hubs
from .textbytes import LOWER, NOT_SPACE, Words, bit_sums, bytes_of, majority, slices, squeezed, words_of, xxh64

SHINGLE, SEED, MAX_BITS = 4, 42, 4
PIECE = 2 << 20  # bytes of a longer text that are read at a time
KEYED_AT_ONCE = 20_000  # fingerprints that one task makes all keys of
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


def _sums(w: Words, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bits of each text's shingles, and how many it has: one of all its words if it has fewer than ``n``."""
    count = np.diff(w.first)
    sizes = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    ends = np.cumsum(sizes)
    long = np.minimum(count, n)

    def run(i: int, j: int) -> np.ndarray:
        number = np.arange(i, j)
        text = np.searchsorted(ends, number, side="right")
        word = number - (ends - sizes)[text] + w.first[:-1][text]
        starts, stops = w.starts[word], w.ends[word + long[text] - 1]
        begin = int(starts[0])
        return xxh64(w.buf[begin : int(stops[-1])], starts - begin, stops - begin, seed)

    return bit_sums(run, sizes), sizes


def _spaced(buf: np.ndarray) -> Words:
    return squeezed(words_of(LOWER[buf], np.array([0, len(buf)]), NOT_SPACE))


def _long_simhash(buf: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The fingerprint of one long text, read in pieces that end after white space; each begins with the last ``n - 1`` words before it."""
    ones, size, at, carried = np.zeros((1, 64), np.int64), np.zeros(1, np.int64), 0, np.zeros(0, np.uint8)
    while at < len(buf):
        end, ahead = len(buf), at + PIECE
        while ahead < len(buf):
            gaps = np.flatnonzero(~NOT_SPACE[buf[at:ahead]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            ahead += ahead - at
        w = _spaced(np.concatenate((carried, buf[at:end])))
        if len(w.starts) >= n:
            more, made = _sums(w, n, seed)
            ones, size = ones + more, size + made
        carried = w.buf[w.starts[-(n - 1) :][0] :].copy() if n > 1 and len(w.starts) else np.zeros(0, np.uint8)
        at = end
    return majority(ones, size) if size[0] else majority(*_sums(_spaced(carried), n, seed))


def simhash(texts: pa.Array, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of an array of texts, as unsigned 64-bit numbers; zero where a text has no word."""
    buf, at = bytes_of(texts)
    if len(at) == 2 and len(buf) > PIECE:
        return _long_simhash(buf, n, seed)
    return majority(*_sums(squeezed(words_of(LOWER[buf], at, NOT_SPACE)), n, seed))


def with_fingerprints(docs: DataFrame, text: str = "text", n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``text`` replaced by its fingerprint ``fp`` (a long with the same 64 bits)."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                fp = pa.array(simhash(part.column(text), n, seed).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), fp], [*rest, "fp"])

    return docs.select(*rest, F.col(text)).mapInArrow(run, schema)


def key_rows(fp: np.ndarray, of_three: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All keys of some fingerprints, and for each the number of its fingerprint; ``of_three``: also those of a Golay key of all three segments, five in six of all."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [golay.keys(p) for p in parts]
    made, owner = [], []

    def add(kind: int, key: np.ndarray, good: np.ndarray) -> None:
        made.append((key | (kind << 40))[good])
        owner.append(np.nonzero(good)[0])

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, (parts[i] << 12)[:, None] | near[j], near[j] >= 0)
                kind += 1
    if not of_three:
        return np.concatenate(made), np.concatenate(owner)
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    good = (a >= 0) & (b >= 0) & (c >= 0)
    add(kind, (a << 24) | (b << 12) | c, good)
    return np.concatenate(made), np.concatenate(owner)


def fingerprint_keys(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, each once, to ``(key, fp)``: at most 252 rows for each, 182 on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 1000):
                key, owner = key_rows(fp[i : i + 1000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 1000][owner])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def near(a: str, b: str, bits: int = MAX_BITS):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, each once and cut, to ``(fp, root)`` for each that is linked to a smaller one.

    A key's hub is its smallest fingerprint.  All keys of one fingerprint are
    made in one task, so fingerprints are dealt out by their number first.
    """
    by_key = Window.partitionBy("key")
    keyed = fingerprint_keys(spread(fps.select("fp"), fps.count(), KEYED_AT_ONCE))
    met = keyed.withColumn("hub", F.min("fp").over(by_key)).withColumn("top", F.max("fp").over(by_key)).where("hub <> top")

    def linked(minor: DataFrame, members: DataFrame) -> DataFrame:
        found = minor.alias("a").join(members.alias("b"), apart() & near("a.node", "b.node"))
        return found.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))

    members = cut(met.select("hub", F.col("fp").alias("node")).distinct())
    return classes_under_hubs(members, lambda pairs: pairs.where(near("u", "v")), linked).withColumnRenamed("u", "fp").withColumnRenamed("v", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``.

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest
    doc_id that links reach.  Null and empty texts have the fingerprint zero and
    are linked like any other.  Rows with the same text meet in one fingerprint,
    and only distinct fingerprints are searched.  A null doc_id is never the
    smallest; a component of null ids alone has a null component_id.  Other
    columns are not read.
    """
    known = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    fps = cut(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = fps.join(fingerprint_classes(fps), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # cut, so that Spark may split the rows of a large root
    ids = rooted.join(least, "root").select("fp", "component_id")
    return known.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id, of those the one whose ``text_key`` is smallest; of rows equal in both, one.

    A row without a doc_id can't be the smallest and is no copy that an id
    could name, so it stays.  An id that repeats with texts of several groups
    stands for a row in each of them.
    """
    named = docs.where("doc_id is not null").select("doc_id", text_key().alias("h"), "text")
    known = cut(with_fingerprints(named))
    fps = cut(known.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("least")))
    rooted = fps.join(fingerprint_classes(fps), "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first")).select("first.*")
    return keep_rows(docs, known, firsts)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, 4-word shingles and links at 4 bits, as ``near_duplicates`` says."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
