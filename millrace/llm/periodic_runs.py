"""Runs of repeated words: maximal stretches with a small period, found on a harmonic grid.

A run of period p and length l >= 4p holds l - p >= 3p words in a row that
equal the word p places on.  So for each period every 3p-th word is a grid
point, and each run covers one: that makes n/3p points for a period, n log n in
all.  From every (period, grid point) whose two words agree the equal stretch
is followed both ways by binary search over prefix hashes, all of them at once.
Stretches found from several points are one run, as are those of multiples of
its smallest period.  What hashes say is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .textbytes import NOT_SPACE, U, Words, bytes_of, mix, slices, words_of

LEAST, TIMES = 6, 4  # a run has at least 6 words, and 4 periods
PAIRS = 1 << 19  # (period, grid point) pairs looked at in one go
BASE = U(0x9E3779B97F4A7C15 | 1)
RUN_SQL = "array<struct<start:long,length:long,period:long>>"


def word_ids(w: Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each distinct word of a batch, and those words; equal numbers are equal words."""
    lengths = w.ends - w.starts
    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.starts] += 1
    inside[w.ends] -= 1
    packed = w.buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of h(word) * base^place, and the powers: two stretches d apart are equal if their sums differ by base^d."""
    powers = np.full(len(ids) + 1, BASE, U)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(ids) + 1, U)
    np.cumsum(mix(ids.astype(U) + U(1)) * powers[:-1], out=sums[1:])
    return sums, powers


def _reach(equal, most: np.ndarray) -> np.ndarray:
    """For each pair the largest l <= most with equal(pair, l), which holds up to some l and not beyond: bisection of all at once."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        half = (low[open_] + high[open_] + 1) // 2
        ok = equal(open_, half)
        low[open_[ok]] = half[ok]
        high[open_[~ok]] = half[~ok] - 1


def _grid(n: np.ndarray, first: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point) for all texts of ``n`` words, at most about ``PAIRS`` together."""
    most = n // times * (n >= least)
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least, times * period) - period
    points = -(-np.maximum(n[text] - period, 0) // step)
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        k, each = points[at:to], np.arange(at, to)
        for low in range(0, int(k.max(initial=0)), PAIRS):  # a single period with more points than that
            part = np.minimum(np.maximum(k - low, 0), PAIRS)
            which = np.repeat(each, part)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part) + low
            yield text[which], period[which], first[text[which]] + nth * step[which]
        at = to


def _stretches(ids: np.ndarray, first: np.ndarray, least: int, times: int, sums: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period), distinct: the stretches that hashes find; places count from the batch's first word."""
    found = [np.zeros((0, 4), np.int64)]
    n = np.diff(first)
    for text, p, i in _grid(n, first[:-1], least, times):
        same = np.flatnonzero(ids[i] == ids[i + p])
        text, p, i = text[same], p[same], i[same]
        shift = powers[p]

        def ahead(which, length, i=i, p=p, shift=shift):
            a, b = i[which], i[which] + length
            return (sums[b] - sums[a]) * shift[which] == sums[b + p[which]] - sums[a + p[which]]

        def back(which, length, i=i, p=p, shift=shift):
            a, b = i[which] - length, i[which]
            return (sums[b] - sums[a]) * shift[which] == sums[b + p[which]] - sums[a + p[which]]

        right = _reach(ahead, first[text + 1] - i - p)
        left = _reach(back, i - first[text])
        long = right + left >= np.maximum(least, times * p) - p
        if long.any():
            found.append(np.unique(np.stack([text[long], (i - left)[long], (i + right + p)[long], p[long]], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def _verified(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> bool:
    """Whether each stretch has its period word by word, and doesn't where it ends."""
    for text, start, end, p in rows.tolist():
        if not np.array_equal(ids[start : end - p], ids[start + p : end]):
            return False
        if (start > first[text] and ids[start - 1] == ids[start - 1 + p]) or (end < first[text + 1] and ids[end] == ids[end - p]):
            return False
    return True


def _plain(ids: np.ndarray, first: np.ndarray, least: int, times: int) -> np.ndarray:
    """The same stretches without hashes, one comparison of the whole text for each period: for texts whose hashes lied."""
    found = []
    for text in range(len(first) - 1):
        a, b = int(first[text]), int(first[text + 1])
        for p in range(1, (b - a) // times + 1 if b - a >= least else 1):
            same = np.concatenate(([0], ids[a : b - p] == ids[a + p : b], [0])).astype(np.int8)
            edge = np.flatnonzero(np.diff(same))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= max(least, times * p) - p:
                    found.append((text, a + s, a + e + p, p))
    return np.array(found, np.int64).reshape(-1, 4)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (text, start, end, period), sorted, the first of each text, start and end."""
    kept = np.ones(len(rows), bool)
    kept[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[kept]


def runs_in(ids: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, end, period) of all maximal runs, by text, start and period, with each its smallest period.

    A stretch of period p and at least 4p words whose smallest period is q < p
    has q dividing p, and is the maximal stretch of q as well.
    """
    rows = _smallest(_stretches(ids, first, least, times, *_prefix_hashes(ids)))
    if not _verified(ids, first, rows):
        rows = _smallest(np.unique(_plain(ids, first, least, times), axis=0))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _cover(rows: np.ndarray, n: int) -> np.ndarray:
    """Words that a run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, rows[:, 1] + rows[:, 3], 1)
    np.add.at(depth, rows[:, 2], -1)
    return np.cumsum(depth[:-1]) > 0


def repeated_runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``keys``, n_words, ``runs`` (start, length, period in words, by start and period) and ``collapsed`` for each row of ``docs``.

    A run is a stretch of words with smallest period q and at least
    max(``least``, ``times`` * q) words that no neighbour extends; ``times``
    below 3 is not supported.  ``collapsed`` holds the words that no run
    contains after its first q ones, with one space between them.  Null and
    empty texts have no words and no runs; rows that repeat each get theirs.
    One map: nothing is shuffled, and pairs are looked at ``PAIRS`` at a time,
    however long a text is.
    """
    if times < 3 or least < 2:
        raise ValueError("runs of fewer than three periods or two words are not looked for")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema), "n_words long", f"runs {RUN_SQL}", "collapsed string"])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                w = words_of(*bytes_of(part.column("_text")), NOT_SPACE)
                ids, known = word_ids(w)
                rows = runs_in(ids, w.first, least, times)
                at = np.searchsorted(rows[:, 0], np.arange(len(w.first))).astype(np.int32)
                listed = pa.StructArray.from_arrays([pa.array(rows[:, 1] - w.first[rows[:, 0]]), pa.array(rows[:, 2] - rows[:, 1]), pa.array(rows[:, 3])], fields=list(kind))
                left = np.flatnonzero(~_cover(rows, len(ids)))
                words = known.take(pa.array(ids[left]))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.searchsorted(left, w.first)), words), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(at), listed), joined.cast(pa.large_string()).cast(pa.string())], [*keys, "n_words", "runs", "collapsed"]
                )

    return docs.select(*keys, text_of(text).alias("_text")).mapInArrow(run, schema)


# what the query asks for

SPACES = r"[\x20\x09-\x0D]+"


def with_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a periodic tail written into every tenth text or so, by crc32 of its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    given = docs.select("doc_id", text_of().alias("text"), F.floor(h / 10).alias("g"), hit.alias("hit"))
    worded = given.withColumn("w", F.when(F.col("hit"), F.array_remove(F.split("text", SPACES), "")))
    worded = worded.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    tail = F.col("n") - F.col("a")
    worded = worded.withColumn("p", (F.floor(tail / (3 + F.col("g") % 8)) + 1).cast("int"))
    again = F.flatten(F.array_repeat(F.expr("slice(w, a + 1, p)"), F.ceil(tail / F.col("p")).cast("int")))
    tailed = F.array_join(F.concat(F.expr("slice(w, 1, a)"), F.slice(again, F.lit(1), tail)), " ")
    return worded.select("doc_id", F.when(F.col("hit") & (F.col("n") > 0), tailed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after its tail is written, the longest of them, and digests of all and of the text without repeats.

    A row for each row of ``documents``, repeated ones too.  Null and empty
    texts have no runs; a row without a doc_id gets no tail.  Columns besides
    doc_id and text aren't read.
    """
    found = repeated_runs(with_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("longest.length * 1000 div -longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# crc32 of a decimal number bit by bit; runs as islands of equal words p apart, found from pairs of equal words
OP11_SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) END AS h
  FROM documents, t),
a AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM a),
c AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: w[CAST(CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END AS BIGINT) + 1]) AS w FROM b),
x AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM c),
e AS (SELECT x.r, x.n, x.i, y.i - x.i AS p FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
f AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM e),
k AS (SELECT r, p, min(i) AS s, max(i) + 1 + p AS e FROM f GROUP BY r, p, island HAVING max(i) + 1 + p - min(i) >= greatest(6, 4 * p)),
runs AS (SELECT r, s, e, min(p) AS p FROM k GROUP BY r, s, e),
u AS (SELECT r, count(*) AS n_runs, max({'l': e - s, 's': -s, 'p': -p}) AS top, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + p, e)) AS i FROM runs),
kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN gone ON x.r = gone.r AND x.i = gone.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -top.s AS start, top.l AS length, -top.p AS period, 1000 * top.l // -top.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM c LEFT JOIN u ON c.r = u.r LEFT JOIN kept ON c.r = kept.r
"""
