"""Secret scans with corpus-wide ownership of what they find.

Regular expressions give candidates in each text: the base kinds (assigned
values, access keys, long hex runs) and, beside them, web tokens, base64 keys
and tokens of mixed letters and digits.  The hash of each candidate's value is counted over the whole
corpus by distinct repository and owner.  A value that several owners hold, or
many repositories of one owner, is a copied example; one that a few
repositories of a single owner hold looks live.  Base spans are kept either way;
of the added kinds only live-looking ones are.

Where no column names repositories, each distinct whole text is one, and belongs
to the least of its owners: so copies of a document raise neither count.

DataFrame expressions only.  A kind's positions come from the lengths of what a
split on its pattern leaves between its matches, as running sums, so a text of
very many matches takes hardly longer than their number says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, table, text_of, with_row_key

# fixed values: the base patterns, the least length of what each must match, the group that is the value
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"[0-9a-f]+", 32, 0),
}
# a run that holds fewer characters than its kind asks for can't match any other way, so the length may go into the pattern
PATTERNS = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
# what the method adds: a pattern of maximal runs, and what a match has to hold besides
_ALL_THREE = ("[0-9]", "[a-z]", "[A-Z]")
ADDED = {
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ()),
    "base64": (r"[A-Za-z0-9+/]{24,}={0,2}", (*_ALL_THREE, "[+/=]", "[A-Za-z0-9]{16}")),
    "mixed": (r"[A-Za-z0-9_-]{24,}", _ALL_THREE),
}
NAMES = [*KINDS, *ADDED]
LIVE_OWNERS, LIVE_REPOS = 1, 4  # a value that more of either hold is a copied example
MASK = "[SECRET]"

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array of positive integers, in as many steps as its size has bits."""

    def step(x: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        return F.zip_with(x, F.concat(F.array_repeat(F.lit(0), by), F.slice(x, F.lit(1), F.size(x) - by)), merge)

    def scanned(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1)
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(steps, v, step))

    return once(values, scanned)


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _spans(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0, holds: tuple[str, ...] = ()) -> Column:
    """All leftmost non-overlapping matches of one pattern, in code points; those with a short value, or without what they should hold, are dropped."""

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda gap, hit: F.char_length(gap) + F.char_length(hit)), lambda a, b: a + b)
        value = (lambda hit: F.regexp_extract(hit, pattern, group)) if group else (lambda hit: hit)
        return F.zip_with(ends, hits, lambda end, hit: F.struct((end - F.char_length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value(hit).alias("value")))

    def good(span: Column) -> Column:
        return reduce(lambda a, b: a & b, (span["value"].rlike(h) for h in holds), F.char_length(span["value"]) >= least)

    return F.when(text.rlike(pattern), F.filter(once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), good)).otherwise(_no_spans())


def _not_within(spans: Column) -> Column:
    """Of ``spans`` of all kinds, by start and then kind, those of the added kinds that don't lie within an earlier one."""
    return once(running(F.transform(spans, lambda s: s["end"]), _larger), lambda reached: F.filter(spans, lambda s, i: (s["kind"] >= len(KINDS)) & ((i == 0) | (F.get(reached, i - 1) < s["end"]))))


def candidates(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with spans in place of the text: those of each base kind, ``base`` (all of them) and ``added``; an added one within any other span is left out."""
    kinds = [_spans(F.col("_t"), i, PATTERNS[k], KINDS[k][2], KINDS[k][1]) for i, k in enumerate(KINDS)]
    kinds += [_spans(F.col("_t"), i, pattern, holds=holds) for i, (pattern, holds) in enumerate(ADDED.values(), len(KINDS))]
    found = docs.select(*keys, F.col(text).alias("_t")).select(*keys, *(c.alias(k) for c, k in zip(kinds, NAMES, strict=True)))
    some = F.size(F.concat(*ADDED)) > 0
    added = F.when(some, once(F.sort_array(F.concat(*NAMES)), _not_within)).otherwise(_no_spans())
    return found.select(*keys, *KINDS, F.sort_array(F.concat(*KINDS)).alias("base"), added.alias("added"))


def ownership(found: DataFrame) -> DataFrame:
    """``found(hash, repo, owner)`` to ``(hash, repos, owners)``: distinct counts, summed by (hash, owner) first.

    A null owner or repository counts as one.
    """
    once = found.select("hash", "owner", "repo").distinct()
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def text_owners(found: DataFrame) -> DataFrame:
    """``found(hash, repo, owner)``, a row for each hash and repository, of the least of its owners; null, as ``chr(1)``, comes first."""
    return found.groupBy("hash", "repo").agg(F.min(F.coalesce("owner", F.lit("\x01"))).alias("owner"))


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, keys: list[str], owner: str = "source", repo: str | None = None, text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``keys``, n_assign, n_access, n_hex, base, spans, held, n_live, n_copied.

    ``base`` and ``spans`` are arrays of (start, kind, end, value), by start and
    then kind.  ``held`` says of each of ``spans`` how many (repos, owners) hold
    its value.  ``n_live`` counts the document's base spans that look live,
    ``n_copied`` the others.  A null text is empty and has none, texts are
    scanned whole, rows that repeat give their result each and count once.
    ``repo`` names a column of repositories; None takes distinct texts for them.
    Values are joined to their counts by broadcast if there are few, else as
    plain columns, so that Spark may split the rows of a value that many share.
    """
    held_by = F.col(repo) if repo else F.sha1(text_of(text))
    rows = with_row_key(docs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(owner).alias("_owner"), held_by.alias("_repo"), text_of(text).alias("_text")))
    kept = [f"_k{i}" for i in range(len(keys))]
    found = cut(candidates(rows, ["_row", *kept, "_owner", "_repo"], "_text"))
    each = found.select("_row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.explode(F.concat("base", "added")).alias("span"))
    each = each.withColumn("hash", F.sha2(F.col("span.value"), 256))
    counts = cut(ownership(each if repo else text_owners(each)))
    judged = each.select("_row", "hash", "span").join(broadcast_if_small(counts, 128), "hash")
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repos") <= LIVE_REPOS)
    is_base = F.col("span.kind") < len(KINDS)
    by_row = judged.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(live | is_base, F.struct("span", F.struct("repos", "owners").alias("held"))))).alias("told"),
        F.count(F.when(live & is_base, 1)).alias("live"),
        F.count(F.when(~live & is_base, 1)).alias("copied"),
    )
    out = found.join(by_row, "_row", "left")
    return out.select(
        *(F.col(k).alias(name) for k, name in zip(kept, keys, strict=True)),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        "base",
        F.coalesce("told.span", _no_spans()).alias("spans"),
        F.coalesce("told.held", F.expr("cast(array() as array<struct<repos:bigint,owners:bigint>>)")).alias("held"),
        F.coalesce("live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def held_list(held: Column) -> Column:
    return F.array_join(F.transform(held, lambda h: F.concat_ws(":", h["repos"].cast("string"), h["owners"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every one of ``spans``, which are in order, replaced; spans that overlap are replaced as one.

    Pieces are cut from the text with four bytes a character, where a place is found without counting from the front.
    """
    mark = F.unhex(F.lit("0000FEFF"))  # decoding takes it away, and no such character of the text

    def piece(wide: Column, at: Column, end: Column) -> Column:
        return F.decode(F.concat(mark, F.substring(wide, at * 4 + 1, (end - at) * 4)), "UTF-32")

    def between(wide: Column, reached: Column) -> Column:
        def before(span: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(reached, i - 1))
            return F.when(span["start"] >= at, F.concat(piece(wide, at, span["start"]), F.lit(MASK))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, before), ""), piece(wide, F.element_at(reached, -1), F.length(wide)))

    reached = running(F.transform(spans, lambda s: s["end"]), _larger)
    return F.when(F.size(spans) > 0, once(F.encode(text, "UTF-32"), lambda wide: once(reached, lambda r: between(wide, r)))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` counted anew; no row is dropped, texts without spans are untouched."""
    mark, spans = fresh("_h", docs), fresh("_spans", docs)
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    found = scan(keyed, ["doc_id", mark]).where(F.size("spans") > 0).select("doc_id", mark, F.col("spans").alias(spans)).dropDuplicates(["doc_id", mark])
    d, f = keyed.alias("d"), broadcast_if_small(cut(found), 256).alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col(f"d.{mark}") == F.col(f"f.{mark}"))
    out = d.join(f, same, "left").select("d.*", f"f.{spans}").drop(mark)
    clean = F.col(spans).isNull()
    out = out.withColumn("text", F.when(clean, F.col("text")).otherwise(masked(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; sources own them, and each distinct text is a repository. A row for each row of ``documents``, as ``scan`` says."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), held_list(F.col("held")).alias("held"), "n_live", "n_copied"
    )


def _duck_spans(kind: int, pattern: str, group: int, least: int) -> str:
    """The same spans in DuckDB SQL: the pieces between matches give the places."""
    value = f"regexp_extract(m[i], {pattern}, {group})"
    return f"""
      SELECT r, doc_id, source, text, {kind} AS kind, m[i] AS hit, {value} AS value,
             list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT r, doc_id, source, text, regexp_extract_all(text, {pattern}, 0) AS m, regexp_split_to_array(text, {pattern}) AS p FROM d WHERE regexp_matches(text, {pattern})),
           unnest(range(1, len(m) + 1)) AS u(i) WHERE length({value}) >= {least}"""


_ASSIGN = r"""'((?i:password|passwd|secret|token|api_?key))["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)'"""


def _duck_added() -> str:
    parts = []
    for kind, (pattern, holds) in enumerate(ADDED.values(), len(KINDS)):
        every = " AND ".join(["true", *(f"regexp_matches(value, '{h}')" for h in holds)])
        parts.append(f"SELECT * FROM ({_duck_spans(kind, f"'{pattern}'", 0, 0)}) WHERE {every}")
    return " UNION ALL ".join(parts)


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({_duck_spans(0, _ASSIGN, 2, 8)} UNION ALL {_duck_spans(1, "'AKIA[A-Z0-9]+'", 0, 16)} UNION ALL {_duck_spans(2, "'[0-9a-f]+'", 0, 32)}),
found AS (SELECT * FROM base UNION ALL {_duck_added()}),
reach AS (SELECT *, max(start + length(hit)) OVER (PARTITION BY r ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM found),
every AS (SELECT * EXCLUDE (reached) FROM reach WHERE kind < 3 OR reached IS NULL OR reached < start + length(hit)),
texts AS (SELECT value, text, min(coalesce(source, chr(1))) AS owner FROM every GROUP BY value, text),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(*) AS repos FROM texts GROUP BY value),
judged AS (
  SELECT e.*, h.owners, h.repos, h.owners <= {LIVE_OWNERS} AND h.repos <= {LIVE_REPOS} AS live, h.repos || ':' || h.owners AS counts, {NAMES}[e.kind + 1] || ':' || CAST(e.start AS BIGINT) || ':' || CAST(e.start + length(e.hit) AS BIGINT) AS item
  FROM every e JOIN held h USING (value)),
by_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS x,
         string_agg(item, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(item, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
         string_agg(counts, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS held,
         count(*) FILTER (kind < 3 AND live) AS live, count(*) FILTER (kind < 3 AND NOT live) AS copied
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(held, '') AS held, coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied
FROM d LEFT JOIN by_row USING (r)
"""
