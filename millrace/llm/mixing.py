"""Mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

The mix is a row of shards, each a row of blocks of the same number of words.
Blocks are seats: they go to sources by highest quotient target / (2 s + 1), s
being the seats a source has already.  Seats are dealt once, in that order, and
shards take them in turn, so each shard and each run of first shards holds its
sources in proportion.

A source's own words are its documents in an order drawn by seed, cut into
blocks; its quota takes them from the front, and from the front again when it
is used up.  A document's place in that order is a running sum of sizes, built
from sums over buckets of the seeded order, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table, text_of

WEIGHTS, SHARE, REPEAT = (5, 2, 1), 1.5, 2
BLOCKS, LEAST_BLOCKS = 65536, 100
SHARDS, SEED = 8, 7
BUCKET_DIGITS = 3  # hex digits of the seeded order that name a bucket


def word_count(column: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, with its ``target`` in words.

    Sources in order, null last, weigh ``weights`` over and over and share
    ``share`` of all words.  A target stops at ``repeat`` times its source; what
    is over goes to the others by weight, until none is above.  In order of
    repeat * size / weight, the sources that stop come first: the share per unit
    of weight left to the rest is fixed by how many stop.  The table has a row
    for each source, which is what the one window over all of it reads.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * repeat).cast("double"))
    lines = (
        ranked.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left", F.col("wanted") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("unit", F.col("left") / F.col("heavy"))
    )
    free = F.min(F.when(F.col("unit") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("unit")))).over(everything)
    return lines.withColumn("level", free["unit"]).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def shard_quotas(targets: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, least: int = LEAST_BLOCKS) -> DataFrame:
    """``targets`` with ``block`` (words in a block) and ``seats``: blocks dealt to the source up to the end of each shard.

    A block is a 1/``blocks`` part of the mix, or less where the smallest target
    would get fewer than ``least`` blocks.  Seats are not dealt one by one: a
    divisor gives every source a number of seats that the highest quotients
    give too, short of the house by at most the number of sources, and only
    quotients just below it are ranked for the rest.
    """
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("target").over(everything)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    sized = (
        targets.withColumn("total", total)
        .withColumn("sources", F.count("*").over(everything))
        .withColumn("block", F.greatest(F.lit(1), F.floor(F.least(F.col("total") / blocks, F.coalesce(smallest, F.lit(0.0)) / least))))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.floor(F.round(F.col("total") / F.col("block")) * F.col("shard") / shards))
    )

    def seats(house: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.try_divide(F.col("target") * house, F.col("total")) - 0.5)).cast("long")

    few, many = F.greatest(F.lit(0), F.col("house") - F.col("sources") / 2 - 1), F.col("house") + F.col("sources") / 2 + 1
    based = sized.withColumn("base", F.coalesce(seats(few), F.lit(0))).withColumn("most", F.coalesce(seats(many), F.lit(0)))
    based = based.withColumn("open", F.col("house") - F.sum("base").over(Window.partitionBy("shard")))
    by_quotient = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last())
    last = (
        based.where("most > base")
        .withColumn("seat", F.explode(F.expr("sequence(base, most - 1)")))
        .withColumn("quotient", F.col("target") / (F.col("seat") * 2 + 1))
        .withColumn("place", F.row_number().over(by_quotient))
        .where("place <= open")
        .groupBy("source", "shard")
        .agg(F.count("*").alias("more"))
    )
    joined = based.alias("b").join(last.alias("l"), F.col("b.source").eqNullSafe(F.col("l.source")) & (F.col("b.shard") == F.col("l.shard")), "left")
    dealt = joined.select("b.source", "source_size", "target", "block", "b.shard", (F.col("base") + F.coalesce("more", F.lit(0))).alias("seats"))
    return dealt.groupBy("source").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.first("block").alias("block"),
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"]).alias("seats"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, taken, slices.

    ``slices`` lists what the mix takes of the document: for each copy and shard
    the first word (from 0) and how many.  ``taken`` is their sum, at most twice
    the size.  A null text has size 0 and is never taken; null is a source like
    any other; rows with the same doc_id and size are taken in either order.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")))
    placed = sized.withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    quotas = shard_quotas(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    b, q = buckets.alias("b"), quotas.alias("q")
    starts = b.join(q, F.col("b.source").eqNullSafe(F.col("q.source"))).select("b.source", "bucket", "base", "source_size", "target", "block", "seats")
    inside = Window.partitionBy("p.source", "p.bucket").orderBy("order", "p.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    p, s = placed.alias("p"), starts.alias("s")
    found = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.bucket") == F.col("s.bucket")))
    found = found.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return found.select("p.doc_id", "p.source", "size", "source_size", "target", _slices().alias("slices")).withColumn(
        "taken", F.aggregate("slices", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    )


def _slices() -> Column:
    """Where the document's copies, laid end to end with its source's, meet the shards' words."""
    return F.expr(
        f"""
        filter(flatten(transform(sequence(0, {REPEAT - 1}), copy -> transform(sequence(1, size(seats)), i -> named_struct(
          'copy', copy, 'shard', i,
          'first', greatest(0L, if(i = 1, 0L, least({REPEAT} * source_size, seats[i - 2] * block)) - (start + copy * source_size)),
          'words', greatest(0L, least(start + size + copy * source_size, {REPEAT} * source_size, seats[i - 1] * block)
                   - greatest(start + copy * source_size, if(i = 1, 0L, least({REPEAT} * source_size, seats[i - 2] * block)))))))),
          x -> x.words > 0)
        """
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with ``mix_taken`` and ``mix_slices`` in place of any columns of those names.

    Rows are found again by doc_id, source and size; repeated rows all get what one of them is taken for.
    """
    taken = mix(docs).where("taken > 0").select("doc_id", "source", "size", "taken", "slices").dropDuplicates(["doc_id", "source", "size"])
    docs = docs.drop("mix_taken", "mix_slices")
    size = fresh("_size", docs)
    d, t = docs.withColumn(size, word_count()).alias("d"), taken.alias("t")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{size}") == F.col("t.size"))
    return d.join(t, same).select("d.*", F.col("t.taken").alias("mix_taken"), F.col("t.slices").alias("mix_slices")).drop(size)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; a row for each row of ``documents``, as ``mix`` says. Texts that are null or hold no word have size 0 and give nothing."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
water AS (
  SELECT 0 AS k, CAST(NULL AS DOUBLE) AS unit, CAST(-1 AS BIGINT) AS stopped
  UNION ALL
  SELECT k + 1, u, n FROM (
    SELECT w.k, w.stopped,
           ((SELECT sum(source_size) * CAST(1.5 AS DOUBLE) FROM s) - coalesce((SELECT sum(2.0 * source_size) FROM s WHERE w.unit IS NOT NULL AND 2 * source_size < w.unit * weight), 0))
           / (SELECT sum(weight) FROM s WHERE w.unit IS NULL OR NOT 2 * source_size < w.unit * weight) AS u,
           (SELECT count(*) FROM s WHERE w.unit IS NOT NULL AND 2 * source_size < w.unit * weight) AS n
    FROM water w) WHERE n <> stopped),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_max(unit, k) FROM water)) AS target FROM s),
g AS (SELECT sum(target) AS total, greatest(1, floor(least(sum(target) / 65536, coalesce(min(target) FILTER (target > 0), 0) / 100))) AS block FROM t),
seats AS (
  SELECT source, count(*) AS n FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST) AS place
    FROM t, g, unnest(range(0, CAST(ceil(target / block) AS BIGINT) + 2)) AS u(j) WHERE target > 0)
  WHERE place <= (SELECT round(total / block) FROM g) GROUP BY source),
p AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(greatest(0, least(p.start + p.size, coalesce(seats.n, 0) * block) - p.start)
          + greatest(0, least(p.start + p.size + t.source_size, coalesce(seats.n, 0) * block, 2 * t.source_size) - p.start - t.source_size) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN seats ON p.source IS NOT DISTINCT FROM seats.source, g
"""
