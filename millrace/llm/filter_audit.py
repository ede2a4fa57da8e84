"""How filters interact: what each order of them removes, and each filter's share.

Documents come down to mask cells: how many of a part fail exactly a given set
of filters.  Everything an order of filters does follows from its cells, so the
documents are read once, whatever the number of orders.  Orders are visited by
adjacent transpositions: each differs from the one before by one swap of
neighbours, which changes two steps; all other steps are carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

# fixed values: white space between words, characters of filter D, bounds of filters A, B and C
SPACES = r"[\x20\x09-\x0D]+"
ODD = "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions that a text decides by itself; ``words`` is the array of its words."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT_PERCENT,
        "C": capitals * 100 > F.length(text) * MOST_CAPITALS_PERCENT,
        "D": text.rlike(ODD),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, good, toxic, n)``: rows of ``docs`` by lang, failed filters (bit i for the i-th letter) and label.

    Texts don't leave their task: what is shuffled is a digest of each, with its
    mask.  A group of equal texts is never brought together: its smallest doc_id
    is found by partial sums, and rows are joined by digest and id to be spared.
    """
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("text"))
    worded = texts.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    bits = [F.shiftleft(fails.cast("int"), i) for i, fails in enumerate(text_filters(F.col("text"), F.col("words")).values())]
    light = cut(worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")))
    firsts = light.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = F.col("first").isNull() & F.col("doc_id").isNotNull()
    judged = light.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(copies, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 or toxic = 1")
    return judged.join(known, "doc_id", "left").groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))


def mask_cells(failed: DataFrame) -> DataFrame:
    """``(part, cells)``: by mask, the number of documents, of good and of toxic ones; 3 times 32 numbers for a part."""
    rows = failed.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return rows.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def transpositions(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n things, each with the place whose neighbours were swapped to get it (None for the first).

    The largest thing that can move goes one step its way; all larger ones turn.
    """
    order, way = list(range(n)), [-1] * n
    yield order, None
    while True:
        at = {x: i for i, x in enumerate(order)}
        movable = [x for x in range(n) if 0 <= at[x] + way[x] < n and order[at[x] + way[x]] < x]
        if not movable:
            return
        x = max(movable)
        i, j = at[x], at[x] + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield order, min(i, j)


def audit(cells: np.ndarray, n: int = len(FILTERS)) -> Iterator[tuple[list[int], dict[str, np.ndarray]]]:
    """Each order of the filters with its measures, for many parts at once.

    ``cells[part, what, mask]`` counts documents (what 0), good (1) and toxic
    (2) ones.  Of each measure the array is ``[part, step]``; the arrays are
    reused, so take what is needed before the next order.  ``shapley`` needs the
    whole walk: see ``shares``.
    """
    masks = np.arange(1 << n)

    def fill(k: int, before: int) -> None:
        f = 1 << order[k]
        fails, caught = masks & f != 0, masks & before != 0
        gone = cells[:, :, fails & ~caught].sum(axis=2)
        out["removed"][:, k], out["good_lost"][:, k], out["toxic_lost"][:, k] = gone[:, 0], gone[:, 1], gone[:, 2]
        out["redundant"][:, k] = cells[:, 0][:, fails & caught].sum(axis=1)
        out["unique_fails"][:, k] = cells[:, 0, f]
        out["kept"][:, k] = cells[:, 0][:, masks & (before | f) == 0].sum(axis=1)

    out = {m: np.zeros((len(cells), n), np.int64) for m in MEASURES if m != "shapley"}
    for order, swapped in transpositions(n):
        for k in range(n) if swapped is None else (swapped, swapped + 1):
            fill(k, sum(1 << f for f in order[:k]))
        yield order, out


def shares(cells: np.ndarray, n: int = len(FILTERS)) -> np.ndarray:
    """``[part, filter]``: what each filter removes, summed over all orders along the same walk; only the two swapped terms change at a step."""
    total = np.zeros((len(cells), n), np.int64)
    term = np.zeros((len(cells), n), np.int64)
    for order, out in audit(cells, n):
        term[:, order] = out["removed"]
        total += term
    return total


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, ...)``: for each part all orders of the filters, a row for each step."""
    n = len(filters)
    names = ["part", "filter_order", "step", *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = batch.slice(at, 256)
                table_ = np.zeros((parts.num_rows, 3, 1 << n), np.int64)
                for i, found in enumerate(parts.column("cells").to_pylist()):
                    for c in found:
                        table_[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                share = shares(table_, n)
                for order, out in audit(table_, n):
                    for k in range(n):
                        name = "".join(filters[f] for f in order)
                        rest = [pa.array(out[m][:, k]) for m in MEASURES[:-1]] + [pa.array(share[:, order[k]])]
                        rows = parts.num_rows
                        yield pa.RecordBatch.from_arrays([parts.column("part"), pa.array([name] * rows), pa.array([k + 1] * rows, pa.int32()), *rest], names)

    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over every document, by lang.

    Null and empty texts are the same text, without words; a null lang is the
    part ''.  Rows that repeat count each; equal rows of the smallest doc_id are
    all first ones.  A row without a doc_id is neither a copy nor an original,
    and has no label; of labels that repeat any 1 counts.  An empty table has
    no parts.  Columns besides doc_id, text and lang aren't read.
    """
    return interactions(mask_cells(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE NOT contains(o, f)),
steps AS (SELECT o AS filter_order, CAST(k AS INT) AS step, substr(o, k, 1) AS f, (1 << (ord(substr(o, k, 1)) - 65)) AS bit,
    list_sum(list_transform(range(1, k), lambda i: 1 << (ord(substr(o, i, 1)) - 65))) AS done FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
s AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & CAST(bit + coalesce(done, 0) AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(coalesce(done, 0) AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(coalesce(done, 0) AS BIGINT) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(coalesce(done, 0) AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & CAST(coalesce(done, 0) AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM s
"""
