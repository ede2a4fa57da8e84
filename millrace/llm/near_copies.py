"""Near copies by SimHash and Golay keys, verified by word shingles, for the pipeline's stage.

A text is the set of its 5-word shingles.  Texts with equal sets are one node.
Links at similarity 0.8 are too far apart for one fingerprint of shingles (a
replaced word changes five of them), so candidates come from ``PRINTS``
independent 64-bit SimHashes of a text's distinct words, where it changes one:
nodes meet under keys of an exact segment with a Golay index of another one, of
any print.  Of pairs at similarity 0.8 to 0.85 some 96 % meet, of all 99 %
(measured); most of the others are linked through a third text.  Pairs whose wide SimHash of shingles (``64 * WIDE`` bits) is too far apart for
that similarity are passed over; every other one is verified by the exact
similarity of its sets, so no link is an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, keep_rows, spread, text_key
from .components import apart, classes_under_hubs
from .simhash import KEYED_AT_ONCE, key_rows
from .textbytes import LOWER, NOT_SPACE, U, Words, bit_sums, bytes_of, gram_hashes, majority, mix, slices, word_hashes, words_of

WORDS, SIMILARITY = 5, 0.8
PRINTS = 4
WIDE, WIDE_BITS = 4, 70  # longs of the wide SimHash, and how many of its bits similar sets differ in at most: 39 are expected at 0.8, 48 of sets of 4 and 5 shingles
SHAPE = ["n", *(f"w{i}" for i in range(WIDE))]


def _distinct(values: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner in rising order, and how many each has."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=owners)


def _words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    buf, at = bytes_of(texts)
    w = words_of(LOWER[buf], at, NOT_SPACE)
    return w, word_hashes(w)


def shingle_sets(w: Words, h: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text after text in rising order, and how many each text has.

    A text of fewer than ``n`` words has one shingle of all of them, one without words has none.
    """
    first, count = w.first[:-1], np.diff(w.first)
    many = np.where(count >= n, count - n + 1, 0)
    of = np.repeat(np.arange(len(count)), many)
    found = [gram_hashes(h, n)[np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]]
    owner = [of]
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        found.append(gram_hashes(h, size)[first[short]])
        owner.append(short)
    return _distinct(np.concatenate(found), np.concatenate(owner), len(count))


def set_hashes(g: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash of each whole set; zero for an empty one."""
    out = np.zeros(len(count), U)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(g), (np.cumsum(count) - count)[some]) + count[some].astype(U))
    return out


def prints(values: np.ndarray, count: np.ndarray, first: int, number: int) -> np.ndarray:
    """``number`` SimHashes of each text's values, a row for each, from seed ``first``; zero without values."""
    return np.stack([majority(bit_sums(lambda i, j: mix(values[i:j] ^ U(first + p)), count), count) for p in range(number)])


def with_prints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, h, text)`` to ``(doc_id, h, fp, p0, p1 .., n, w0, w1 ..)``: hash of its shingle set, SimHashes of its words, size and wide SimHash of the set."""
    made = ["fp", *(f"p{i}" for i in range(PRINTS)), *SHAPE]
    schema = docs.select("doc_id", "h", *(F.lit(0).cast("long").alias(c) for c in made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, h = _words(part.column("text"))
                g, count = shingle_sets(w, h)
                narrow, wide = prints(*_distinct(h, w.doc, len(w.first) - 1), 1, PRINTS), prints(g, count, 1 + PRINTS, WIDE)
                values = [set_hashes(g, count).view(np.int64), *narrow.view(np.int64), count.astype(np.int64), *wide.view(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), *map(pa.array, values)], ["doc_id", "h", *made])

    return docs.select("doc_id", "h", "text").mapInArrow(run, schema)


def with_sets(docs: DataFrame) -> DataFrame:
    """``docs(text)`` to ``(fp, shingles)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                g, count = shingle_sets(*_words(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(g, count).view(np.int64)), lists], ["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp long, shingles array<long>")


def node_keys(nodes: DataFrame) -> DataFrame:
    """``nodes(fp, p0, p1 ..)`` to ``(key, fp)``: about 32 rows for each print of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for p in range(PRINTS):
                of = batch.column(f"p{p}").to_numpy(zero_copy_only=False).view(U)
                for i in range(0, len(fp), 1000):
                    key, owner = key_rows(of[i : i + 1000], of_three=False)
                    yield pa.RecordBatch.from_arrays([pa.array(key | (p << 48)), pa.array(fp[i : i + 1000][owner])], ["key", "fp"])

    return nodes.select("fp", *(f"p{p}" for p in range(PRINTS))).mapInArrow(run, "key long, fp long")


def may_be_similar(a: str = "a", b: str = "b") -> Column:
    """Whether sizes and wide SimHashes of two nodes allow a similarity of ``SIMILARITY``."""
    bits = sum((F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(WIDE)), F.lit(0))
    return (F.least(f"{a}.n", f"{b}.n") >= SIMILARITY * F.greatest(f"{a}.n", f"{b}.n")) & (bits <= WIDE_BITS)


def are_similar(a: str = "a", b: str = "b") -> Column:
    both = F.size(F.array_intersect(f"{a}.shingles", f"{b}.shingles"))
    return both >= SIMILARITY * (F.size(f"{a}.shingles") + F.size(f"{b}.shingles") - both)


def sets_of(named: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(fp, shingles)`` of the nodes that ``named(fp)`` lists, made anew from one text of each."""
    rows = cut(nodes.join(named.distinct(), "fp").select("first.*").distinct())
    return cut(with_sets(docs.join(broadcast_if_small(rows, 24), ["doc_id", "h"], "left_semi")).dropDuplicates(["fp"]))


def links_with_hubs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` that are similar."""
    a, b = (nodes.select(F.col("fp").alias(k), F.struct(*SHAPE).alias(f"s{k}")) for k in ("u", "v"))
    near = cut(pairs.join(a, "u").join(b, "v").where(may_be_similar("su", "sv")).select("u", "v"))
    sets = sets_of(near.select(F.explode(F.array("u", "v")).alias("fp")), nodes, docs)
    a, b = (sets.select(F.col("fp").alias(k), F.struct("shingles").alias(f"s{k}")) for k in ("u", "v"))
    return near.join(a, "u").join(b, "v").where(are_similar("su", "sv")).select("u", "v")


def links_with_others(members: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between ``members`` of the same hub, one of them outside its main component.

    Rows that may have a partner are found first, each once, then their sets are
    joined to them and compared within the join: pairs that aren't links are
    never written, however large a group.
    """
    shaped = cut(members.join(nodes.select(F.col("fp").alias("node"), *SHAPE), "node"))
    outer = shaped.where("root <> main")
    might = apart() & may_be_similar()
    some = cut(outer.alias("a").join(shaped.alias("b"), might, "left_semi"))
    others = cut(shaped.alias("b").join(some.alias("a"), might, "left_semi"))
    sets = sets_of(some.select("node").unionByName(others.select("node")).withColumnRenamed("node", "fp"), nodes, docs).withColumnRenamed("fp", "node")
    found = some.join(sets, "node").alias("a").join(others.join(sets, "node").alias("b"), might & are_similar())
    return found.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))


def keep_least(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, of those the one whose ``text_key`` is smallest; of rows equal in both, one.

    Texts without words (null ones too) have the same, empty, set and are one
    another's copies.  A row without a doc_id can't be the smallest and is no
    copy that an id could name, so it stays.  An id that repeats with texts of
    several groups stands for a row in each of them.  Texts are read whole;
    columns other than doc_id and text are carried, whatever their names.
    """
    texts = docs.where("doc_id is not null").select("doc_id", text_key().alias("h"), "text")
    known = cut(with_prints(texts))
    nodes = cut(known.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("first"), *(F.min(c).alias(c) for c in [*(f"p{i}" for i in range(PRINTS)), *SHAPE])))
    by_key = Window.partitionBy("key")
    keyed = node_keys(spread(nodes.where("n > 0"), nodes.count(), KEYED_AT_ONCE))
    met = keyed.withColumn("members", F.count("*").over(by_key)).where("members > 1")
    met = met.withColumn("weight", F.sum("members").over(Window.partitionBy("fp")))  # texts in the middle of a group meet most others, so few hubs serve all its keys
    met = met.withColumn("hub", F.max(F.struct("weight", "fp")).over(by_key)["fp"])
    members = cut(met.select("hub", F.col("fp").alias("node")).distinct())
    classes = classes_under_hubs(members, lambda pairs: links_with_hubs(pairs, nodes, texts), lambda _, all_members: links_with_others(all_members, nodes, texts))
    rooted = nodes.join(classes.withColumnRenamed("u", "fp").withColumnRenamed("v", "root"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return keep_rows(docs, known, firsts)
