"""Document fingerprints from closed syncmers of words.

A text is padded with marks on both sides and read as words; an unbroken run of
more than ``LONG`` characters (texts without spaces, encoded data) is read as
all its windows of ``WINDOW`` characters.  Of every run of K words, those are
kept whose smallest run of S words (by hash) lies at either edge.  Whether a run
is kept depends on its own words alone, so an edit moves or removes only anchors
that overlap it.  The anchors of a text are the hashes of all kept runs with
their places, however many there are; the fingerprint is a digest of that list.

Two texts are matched by position: distinct anchors that both hold, each at its
first place, are put in the order of either text, and a step from one to the
next counts if the other text makes it too.  Likeness is the number of anchors
in such steps over that of all distinct anchors of both.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, text_of

K, S = 4, 2
LONG, WINDOW = 32, 8
RANGE_ROWS, MANY_RANGES, MANY_ROWS = 1000, 4096, 10_000  # rows of a sorting range; above so many ranges they grow to MANY_ROWS
STEP = 64
_SPACE = r"\x20\x09-\x0D"


def _word_hashes(text: str) -> str:
    """Hashes of the padded words.  A mark's hash is never the smaller one of a pair: marks sort last."""
    words = f"regexp_extract_all({text}, r'[^{_SPACE}]+', 0)"
    windows = f"transform(regexp_extract_all(w, r'(?s)(?=(.{{{WINDOW}}})).', 1), x -> xxhash64(x))"
    return f"""
      concat(array_repeat(0L, {K - 1}),
             IF({text} RLIKE r'(?:^|[{_SPACE}])[^{_SPACE}]{{{LONG + 1}}}',
                flatten(transform({words}, w -> IF(char_length(w) > {LONG}, {windows}, array(xxhash64(w))))),
                transform({words}, w -> xxhash64(w))),
             array_repeat(0L, {K - 1}))
    """


def anchor_lists(text: str = "text") -> Column:
    """All closed syncmers of a text as two lists, by place: ``at`` (number of the first word, from 1 - K) and ``hash``."""
    pairs = """
      zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1),
               (a, b) -> (hash(a, b) & 4294967295L) + IF(a = 0 OR b = 0, 4294967296L, 0L))
    """
    first, last = f"p[i + {K - 1}]", f"p[i + {K - 1 + K - S}]"
    kept = " AND ".join(f"least({first}, {last}) <= p[i + {K - 1 + j}]" for j in range(1, K - S))
    return F.expr(
        f"""
        transform(transform(array({_word_hashes(text)}), h -> {pairs}), p ->
          transform(array(filter(sequence({1 - K}, size(p) - {K - S + K}), i -> {kept})), at ->
            named_struct('at', at, 'hash', transform(at, i -> hash({first}, {last}) & 4294967295L)))[0])[0]
        """
    )


def anchors(text: str = "text", with_position: bool = False) -> Column:
    """Hashes of the closed syncmers of a text, or with their places as ``(at, hash)``."""
    lists = anchor_lists(text)
    return F.arrays_zip(lists["at"].alias("at"), lists["hash"].alias("hash")) if with_position else lists["hash"]


def digest(at: Column, hashes: Column) -> Column:
    """SHA-256 of a whole list of anchors with their places."""
    return F.sha2(F.concat(at.cast("string"), hashes.cast("string")), 256)


def similarity(a: str, b: str) -> Column:
    """Jaccard similarity of all distinct hashes of two lists of anchors with places, wherever they stand."""
    both = F.size(F.array_intersect(f"{a}.hash", f"{b}.hash"))
    return (both / F.size(F.array_union(f"{a}.hash", f"{b}.hash"))).cast("double")


def _steps(column: str) -> Column:
    """A hash of each two neighbours of a list."""
    n = f"greatest(size({column}) - 1, 0)"
    return F.expr(f"zip_with(slice({column}, 1, {n}), slice({column}, 2, {n}), (x, y) -> xxhash64(x, y))")


def with_likeness(found: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``found`` with the likeness by position, ``name``, of two columns of anchor hashes in order of place; 1 for equal lists, 0 if they share none."""
    ours, theirs = fresh("_ours", found), fresh("_theirs", found)
    found = found.withColumns({ours: F.array_intersect(a, b), theirs: F.array_intersect(b, a)})
    steps = F.size(F.array_intersect(_steps(ours), _steps(theirs))) + 1
    share = F.when(F.size(ours) > 0, steps / F.size(F.array_union(a, b))).otherwise(0.0)
    return found.withColumn(name, share.cast("double")).drop(ours, theirs)


def matches(a: str, b: str) -> Column:
    """Places ``(at, other)`` of anchors that ``a`` and ``b`` share, by place in ``a``: of equal hashes the first goes with the first, the second with the second, and so on."""

    def ranked(column: str, side: int) -> str:
        coded = f"sort_array(transform({column}, e -> shiftleft(e.hash, 31) + e.at + {K}))"
        firsts = "filter(sequence(0, size(s) - 1), i -> i = 0 OR shiftright(s[i], 31) <> shiftright(s[i - 1], 31))"
        ranks = "flatten(transform(f, (at, j) -> sequence(0, coalesce(get(f, j + 1), size(s)) - at - 1)))"
        one = f"named_struct('hash', shiftright(v, 31), 'rank', r, 'side', {side}, 'at', cast((v & 2147483647L) - {K} as int))"
        return f"transform(array({coded}), s -> transform(array({firsts}), f -> zip_with(s, {ranks}, (v, r) -> {one}))[0])[0]"

    pair = "IF(u[i].hash = u[i + 1].hash AND u[i].rank = u[i + 1].rank, named_struct('at', u[i].at, 'other', u[i + 1].at), NULL)"
    return F.expr(
        f"""
        transform(array(sort_array(concat({ranked(a, 0)}, {ranked(b, 1)}))), u ->
          sort_array(filter(transform(sequence(0, size(u) - 2), i -> {pair}), x -> x IS NOT NULL)))[0]
        """
    )


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``anchors`` (all, with places) and their digest ``fingerprint``; columns of those names are replaced, all others stay.

    A null text is empty; an empty one has the anchors of its marks.
    """
    given, lists = fresh("_given", docs), fresh("_lists", docs)
    found = docs.withColumn(given, text_of(text))
    found = found.withColumn(lists, anchor_lists(f"`{given}`"))
    at, hashes = F.col(f"{lists}.at"), F.col(f"{lists}.hash")
    return found.withColumns({"anchors": F.arrays_zip(at.alias("at"), hashes.alias("hash")), "fingerprint": digest(at, hashes)}).drop(given, lists)


def id_range(heads: list[int]) -> Column:
    """How many of the descending ``heads`` are at or above doc_id; after all of them for a null one.  Looked up in steps of ``STEP``."""
    if not heads:
        return F.lit(0)
    levels = [heads]
    while len(levels[-1]) > STEP:
        levels.append(levels[-1][STEP - 1 :: STEP])

    def counted(level: list[int], above: Column) -> Column:
        edges = F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>")  # folded into one literal
        return F.transform(F.array(above), lambda a: a * STEP + F.size(F.filter(F.slice(edges, a * STEP + 1, STEP), lambda h: h >= F.col("doc_id"))))[0]

    found = F.lit(0)
    for level in reversed(levels):
        found = counted(level, found)
    return F.when(F.col("doc_id").isNull(), F.lit(len(heads))).otherwise(found)


def with_next(docs: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``next_`` twins of all columns but doc_id: of the next row by descending doc_id, after the last the first.

    ``docs`` has doc_id and text.  Null ids come last; rows of the same id follow
    by text.  Ids are cut into ranges, one sort for each range, so that texts
    are shuffled once and no task orders them all.  The rows of each range's
    first id also go to the end of the range before it; those ids, one for each
    ``RANGE_ROWS`` to ``MANY_ROWS`` rows, are all that the driver reads.
    Columns of ``made`` are made after the shuffle, which doesn't carry them.
    """
    made = made or {}
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, min(n // RANGE_ROWS, max(MANY_RANGES, n // MANY_ROWS)))
    dealt = ids.repartitionByRange(ranges, F.col("doc_id").desc_nulls_last()) if ranges > 1 else ids.coalesce(1)
    first = [r["head"] for r in sorted(dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("head")).collect())]
    place = id_range([h for h in first[1:] if h is not None]).cast("int")
    if first and first[-1] is None and len(first) > 1:  # a range of null ids alone
        place = F.when(F.col("doc_id").isNull(), F.lit(len(first) - 1)).otherwise(place)
    heads = [(head, (i - 1) % len(first)) for i, head in enumerate(first)]
    sent = docs.sparkSession.createDataFrame(heads, "head long, range int")
    both = docs.join(F.broadcast(sent), docs["doc_id"].eqNullSafe(sent["head"]), "left")
    own = F.struct(place.alias("range"), F.lit(False).alias("copy"))
    copy = F.when(F.col("range").isNotNull(), F.struct(F.col("range"), F.lit(True).alias("copy")))
    given = [c for c in docs.columns if c != "doc_id"]
    spread = both.select("doc_id", *given, F.explode(F.filter(F.array(own, copy), lambda x: x.isNotNull())).alias("_to"))
    spread = spread.repartition(F.col("_to.range")).withColumns(made)
    carried = [*given, *made]
    order = Window.partitionBy("_to.range").orderBy("_to.copy", F.col("doc_id").desc_nulls_last(), "text")
    found = spread.withColumn("_next", F.lead(F.struct(*carried)).over(order)).where(~F.col("_to.copy"))
    return found.select("doc_id", *carried, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in carried))


def compared(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``: all anchors with their places, digests, and how they compare with those of the edited text and of the next one.

    Null and empty texts have the anchors of their marks.  Rows of the same id
    follow by text, null ids come last, a single row is its own next one.
    Other columns are not read.
    """
    found = with_next(docs.select("doc_id", text_of().alias("text")), {"own": anchor_lists("text")})
    n = F.char_length("text")
    moved = F.floor(n / 2).cast("int")
    found = found.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved)))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), "own", anchor_lists("edited_text").alias("edited"), F.col("next_own").alias("next"))
    found = with_likeness(with_likeness(found, "own.hash", "edited.hash", "near_edited"), "own.hash", "next.hash", "near_next")
    found = found.withColumns({f"_{c}": F.arrays_zip(F.col(f"{c}.at").alias("at"), F.col(f"{c}.hash").alias("hash")) for c in ("own", "edited", "next")})
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        *(digest(F.col(f"{c}.at"), F.col(f"{c}.hash")).alias(name) for c, name in (("own", "fingerprint"), ("edited", "edited_fingerprint"))),
        "near_edited",
        "near_next",
        F.col("_own").alias("anchors"),
        matches("_own", "_edited").alias("matches_edited"),
        matches("_own", "_next").alias("matches_next"),
    )


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likeness by position; a row for each row of ``documents``, as ``compared`` says."""
    found = compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
