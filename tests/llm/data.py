"""Small tables with the cases that every operator has to bear."""

import random

import duckdb
import pyarrow as pa

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string, fp long, score double, spans string"
TABLES = ("documents", "benchmark", "conversations", "pages")


def words(rng, n, alphabet=("the", "of", "Étude", "rain", "is", "wide", "x1", "naïve", "日本", "Tea", "sea,", "end.")):
    return " ".join(rng.choice(alphabet) + str(rng.randint(0, 40)) for _ in range(n))


def document_rows(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, rng.randint(1, 90)).replace(" ", "\n", rng.randint(0, 4))
        rows.append((i, text, "en", f"s{i % 5}" if i % 7 else "s0", len(text)))
    base = words(rng, 400)
    rows += [(100 + i, base + f" tail{i}", "en", "s1", 0) for i in range(6)]
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, "   \t\n", "en", "s2", 5), (203, "one", "en", "s9", 3)]
    rows += [(204, words(rng, 9000), "en", "s3", 0), (205, rows[0][1], "fr", "s4", 0), rows[3], rows[3], (None, "a row without an id but with words", "en", "s0", 1)]
    return [(*r, 1, "h", 2, 0.5, "z") for r in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(document_rows() if rows is None else rows, DOC_SCHEMA)


def duck(sql, **frames):
    """Rows of a DuckDB query over Spark frames, as a sorted list of dicts by column."""
    con = duckdb.connect()
    for name, frame in frames.items():
        columns = frame.columns
        rows = frame.collect()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        con.register(name, pa.table({c: pa.array([r[c] for r in rows], kinds[t]) for c, t in frame.select(columns).dtypes}))
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return ordered([dict(zip(names, r, strict=True)) for r in got.fetchall()])


def ordered(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


def spark_rows(frame):
    return ordered([r.asDict() for r in frame.collect()])
