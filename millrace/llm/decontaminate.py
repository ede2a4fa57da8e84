"""Benchmark decontamination by winnowed word k-grams.

Both sides keep, of every 6 consecutive 5-grams of words, the one with the
smallest hash.  A span of 10 words holds exactly 6 such 5-grams, so any 10
words that a document and an item have in common give both the same
fingerprint.  Fingerprints are joined, and each hit is extended word by word
over the 10-word windows that hold it.  Items of fewer than 10 words lie below
that guarantee; their whole sequence is looked up as one n-gram instead.

Document fingerprints first pass a bitmap of the benchmark's hashes.  Its size
is fixed, so it can be sent to all tasks however large the benchmark is; what
passes is joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, table, text_of, with_row_key
from .textbytes import ALNUM, LOWER, Words, bytes_of, gram_hashes, slices, word_hashes, words_of

WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM  # words that a window can have on either side of a k-gram
MAP_BITS = 22
BROADCAST_BYTES = 8 << 20

HIT = pa.struct([("hash", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("at", pa.int32()), ("words", pa.list_(pa.string()))])
HIT_SQL = "array<struct<hash:long,n:int,pos:int,at:int,words:array<string>>>"


def winnowed(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the k-grams kept: the first minimum of each window that lies in one text."""
    grams = gram_hashes(h, GRAM)
    windows = len(h) - WINDOW + 1
    if windows < 1:
        return grams[:0], np.zeros(0, np.int64)
    least, where = grams[:windows].copy(), np.zeros(windows, np.int64)
    for j in range(1, REACH + 1):
        here = grams[j : j + windows]
        lower = here < least
        least[lower] = here[lower]
        where[lower] = j
    whole = doc[:windows] == doc[WINDOW - 1 : WINDOW - 1 + windows]
    kept = np.zeros(len(h), bool)
    kept[(np.arange(windows) + where)[whole]] = True
    pos = np.flatnonzero(kept)
    return grams[pos], pos


def _runs(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    grams = gram_hashes(h, n)
    pos = np.flatnonzero(doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
    return grams[pos], pos


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _hits(w: Words, doc: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> list[list[dict]]:
    """What to join, by text: the fingerprint with the words around it."""
    out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    for n, grams, pos in found:
        for h, p in zip(grams.view(np.int64).tolist(), pos.tolist(), strict=True):
            d = doc[p]
            a, b = (max(p - REACH, w.first[d]), min(p + WINDOW, w.first[d + 1])) if n == WINDOW else (p, p + n)
            out[d].append({"hash": h, "n": n, "pos": p - int(w.first[d]), "at": int(p - a) + 1, "words": [w.word(i) for i in range(a, b)]})
    return out


def _extracted(texts: DataFrame, keys: list[str], pick) -> DataFrame:
    """``keys`` and ``text`` to ``keys``, ``n_words`` and ``hits``; ``pick(h, doc, first)`` chooses the fingerprints."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema), "n_words long", f"hits {HIT_SQL}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, at = bytes_of(part.column("text"))
                w = words_of(LOWER[buf], at, ALNUM)
                doc = w.doc
                hits = _hits(w, doc, pick(word_hashes(w), doc, w.first))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(np.diff(w.first)), pa.array(hits, pa.list_(HIT))], [*keys, "n_words", "hits"])

    return texts.select(*keys, "text").mapInArrow(run, schema)


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """``(item_id, hash, n, pos, at, words)``: winnowed k-grams of long items, the one n-gram of short ones."""

    def pick(h, doc, first):
        count = np.diff(first)
        short = [(n, *_runs(h, doc, n)) for n in range(1, WINDOW)]
        return [(WINDOW, *winnowed(h, doc))] + [(n, g[count[doc[p]] == n], p[count[doc[p]] == n]) for n, g, p in short]

    found = _extracted(benchmark.select("item_id", text_of().alias("text")), ["item_id"], pick)
    return found.select("item_id", F.explode("hits").alias("h")).select("item_id", "h.*").distinct()


def _bitmap(items: DataFrame) -> np.ndarray:
    """A bit for each benchmark hash: at most 2^22 bits, whatever the benchmark's size."""
    slot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    rows = items.groupBy(F.shiftrightunsigned(slot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).collect()
    cells = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in rows:
        cells[r["cell"]] = r["bits"]
    return np.unpackbits(cells.view(np.uint8), bitorder="little").astype(bool)


def _equal_run(a: Column, b: Column) -> Column:
    """How many leading words are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of ``docs``: ``keys``, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it lies in an occurrence of 10 consecutive words
    of an item, or of a whole item of fewer words.  A null text has no words,
    and neither an item nor a document without words hits anything.  Rows that
    repeat, in either table, each get or give their own hits; items are counted
    by distinct item_id, and a null item_id hits but is not counted or listed.
    """
    items = cut(item_fingerprints(benchmark))
    bitmap = _bitmap(items)
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect() if r["n"] < WINDOW)  # nine at most
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pick(h, doc, first):
        found = [(WINDOW, *winnowed(h, doc))] + [(n, *_runs(h, doc, n)) for n in lengths]
        return [(n, g[hit], p[hit]) for n, g, p in found for hit in [shared.value[_slot(g)]]]

    rows = with_row_key(docs.select(*keys, text_of().alias("text")))
    seen = cut(_extracted(rows, ["_row", *keys], pick))
    hits = seen.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    size = items.agg(F.sum(F.length(F.concat_ws(" ", "words")) + 64)).first()[0] or 0
    by_hash = items.select("item_id", "hash", "n", F.col("at").alias("item_at"), F.col("words").alias("item_words"))
    met = hits.join(F.broadcast(by_hash) if size <= BROADCAST_BYTES else by_hash, ["hash", "n"])

    def back(words: str, at: str) -> Column:
        return F.reverse(F.slice(words, F.lit(1), F.col(at) - 1))

    def ahead(words: str, at: str) -> Column:
        return F.slice(words, F.col(at), F.lit(WINDOW))

    spans = (
        met.withColumn("left", _equal_run(back("words", "at"), back("item_words", "item_at")))
        .withColumn("right", _equal_run(ahead("words", "at"), ahead("item_words", "item_at")))
        .where(F.col("left") + F.col("right") >= F.col("n"))
        .select("_row", "item_id", F.struct((F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b")).alias("span"))
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).cast("long").alias("n"), F.greatest(acc["end"], s["b"]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    by_row = spans.groupBy("_row").agg(F.collect_set("span").alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    by_row = by_row.select("_row", covered.alias("hit"), F.size("ids").cast("long").alias("items"), F.array_join(F.array_sort("ids"), ",").alias("ids"))
    out = seen.select("_row", *keys, "n_words").join(by_row, "_row", "left")
    return out.select(
        *keys,
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item hits.  Rows are told apart by doc_id and text."""
    mark = fresh("_text", docs)
    keyed = docs.withColumn(mark, F.xxhash64(text_of()))
    found = contamination(keyed, benchmark, ("doc_id", mark)).where("contaminated").select("doc_id", mark).distinct()
    found = broadcast_if_small(cut(found), 32)
    same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed[mark] == found[mark])
    return keyed.join(found, same, "left_anti").select(*docs.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark items in every document; a row for each row of ``documents``. Null and empty texts, of either table, have no words and no hits."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
hit AS (
  SELECT d.r, bw.item_id, u.i, ns.n
  FROM d, ns, unnest(range(1, len(d.w) - ns.n + 2)) AS u(i)
  JOIN bw ON bw.n = ns.n AND bw.g = array_to_string(d.w[u.i : u.i + ns.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
