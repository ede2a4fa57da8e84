"""Every registered query against its SQL twin on the smallest tables, and operators that SQL can't express against plain Python."""

import random

import duckdb
import pytest
from millrace import plans
from millrace.functions.keys import hash16, part_of
from millrace.operators import blocks, erasure, gold, keyring, overlay, study, traffic
from millrace.sources.files import chunks, texts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_twin(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((repr(tuple(r[c] for c in columns)) for r in frame.collect()))
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(names) == columns and got == want


def test_hash16_follows_utf16_units(spark):
    def slow(text):
        units, h = text.encode("utf-16-be"), 0
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFF
        return h

    rows = ["hello", "", "é", "😀 smile", "x" * 300]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", hash16("t").alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: slow(t) for t in rows} and slow("hello") == 0x18D2


def _edges(seed, n, m):
    rng = random.Random(seed)
    return list({(min(a, b), max(a, b)): rng.randint(1, 4) for a, b in ((rng.randint(1, n), rng.randint(1, n)) for _ in range(m)) if a != b}.items())


def test_spanning_forest_is_kruskals(spark):
    edges = [(a, b, w) for (a, b), w in _edges(1, 40, 90)]
    frame = spark.createDataFrame([*edges, (3, 3, 1)], "a long, b long, w int")
    group, want = {v: v for e in edges for v in e[:2]}, set()
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if group[a] != group[b]:
            want.add((a, b, w))
            old = group[b]
            group = {v: group[a] if g == old else g for v, g in group.items()}
    assert {tuple(r) for r in overlay.spanning_forest(frame).collect()} == want
    assert overlay.spanning_forest(frame.limit(0)).count() == 0


def test_relays_along_a_path(spark):
    tree = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (2, 5, 1)], "a long, b long, w int")
    messages = spark.createDataFrame([(1, 4), (4, 5), (5, 1), (5, 1), (2, 3), (3, 3)], "source long, sink long")
    got = {r["node"]: r["relayed_count"] for r in overlay.relays(messages, tree, 1).collect()}
    assert got == {2: 4, 3: 2}


@pytest.mark.parametrize(("n", "k"), [(10, 4), (10, 3), (9, 3), (5, 4), (1, 1), (4, 4)])
def test_regular_graph(spark, n, k):
    nodes = spark.range(1, n + 1).withColumnRenamed("id", "node")
    edges = {tuple(r) for r in overlay.regular_edges(nodes, k).collect()}
    assert len(edges) == (n * k // 2 if 0 <= k < n and n > 1 else 0)
    degree = [sum(v in e for e in edges) for v in range(1, n + 1)]
    assert not edges or max(degree) - min(degree) <= n * k % 2


def test_owner_and_leaves_by_brute_force(spark):
    rng = random.Random(3)
    for ids in ([7], [0, 0x8000], rng.sample(range(65536), 30)):
        nodes = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "node long, id16 long")
        owner = {r["key16"]: r["owner"] for r in keyring.owner_table(nodes).where("key16 % 97 = 0").collect()}
        gap = lambda a, b: min(abs(a - b), 65536 - abs(a - b))
        assert owner == {k: min(ids, key=lambda v: (gap(k, v), -v)) for k in range(0, 65536, 97)}
    leaves = {r["id16"]: (r["left_id"], r["right_id"]) for r in keyring.leaf_sets(spark.createDataFrame([(0, 0), (1, 0x8000)], "node long, id16 long")).collect()}
    assert leaves == {0: (None, 0x8000), 0x8000: (None, 0)}


def test_routes_end_at_the_owner(spark):
    ids = random.Random(4).sample(range(65536), 40)
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "node long, id16 long").cache()
    asked = spark.createDataFrame([(ids[i % 40], k) for i, k in enumerate(range(5, 65536, 2003))], "at16 long, key16 long")
    for _ in range(6):
        found = keyring.next_hops(asked, nodes).collect()
        asked = spark.createDataFrame([(r["hop16"], r["key16"]) for r in found], "at16 long, key16 long")
    assert sum(r["hop16"] == r["owner"] for r in found) == len(found)


@pytest.mark.parametrize("size", [0, 1, 5, 6, 7, 1000, 65535, 65536, 65537, 131072])
def test_any_six_shards_restore(size):
    rng = random.Random(size)
    data = rng.randbytes(size)
    shards = erasure.encode(data)
    for _ in range(6):
        left = rng.sample(range(9), 6)
        assert erasure.decode({i: shards[i] for i in left}, size) == data
    with pytest.raises(ValueError):
        erasure.decode({i: shards[i] for i in range(5)}, size)


def test_chunks_and_shards_of_files(spark):
    sizes = [0, 1, 65535, 65536, 65537, 131072]
    files = spark.createDataFrame([(str(n), random.Random(n).randbytes(n)) for n in sizes], "file string, content binary")
    got = chunks(files)
    assert sorted((r["file"], r["chunk"], len(r["data"])) for r in got.collect()) == sorted((str(n), i + 1, min(65536, n - i * 65536)) for n in sizes for i in range(-(-n // 65536)))
    shards = erasure.shards_of(got, ["file", "chunk"])
    back = {(r["file"], r["chunk"]): r["data"] for r in erasure.restored(shards.where("shard not in (0, 4, 8)"), ["file", "chunk"]).collect()}
    assert back == {(r["file"], r["chunk"]): r["data"] for r in got.collect()}
    assert all(r["data"] is None for r in erasure.restored(shards.where("shard < 5"), ["file", "chunk"]).collect())


def test_corruption_cases(spark):
    rows = [(["a", "b"], ["a", "b"]), (["a", "b"], ["a", "x"]), (["a"], ["a", "b"]), (None, ["a"])]
    got = spark.createDataFrame(rows, "s array<string>, f array<string>").select(blocks.first_bad_slice(F.col("s"), F.col("f")).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 2, -1, None]


def test_placement_needs_enough_servers(spark):
    space = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "server long, free long")
    assert [(r["server"], r["place"]) for r in blocks.placement(space).orderBy("place").collect()] == [(2, 1), (1, 2), (3, 3)]
    assert blocks.placement(space, 4).isEmpty()


def test_proof_of_work(spark):
    import hashlib

    got = erasure.with_proof(spark.createDataFrame([("a",), ("b",)], "t string"), "t", 6).collect()
    for t, nonce in got:
        bits = [erasure.leading_zero_bits(hashlib.sha3_256(f"{t}:{i}".encode()).digest()) for i in range(nonce + 1)]
        assert bits[-1] >= 6 and max(bits[:-1], default=0) < 6


def test_conservation_and_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "node int, generated long, pulled long, pushed long, completed long")
    assert traffic.unbalanced(empty).isEmpty()
    one = spark.createDataFrame([(1, 2, 3, 4, 0)], empty.schema)
    assert {r["percent"] for r in traffic.load_share(one).collect()} == {0.0}


QUIZ = """1
1 / 1 point
A thread shares memory.
    int x = 1;
True
False
Results for question 2.
2
0 / 1 point
How many?
Correct answer:
, Not Selected
42
Results for question 3.
Pick a level
Correct answer:
High
Results for question 4.
3
1 / 1 point
True
Results for question 5.
A trap
Incorrect answer:
False
Correct answer:
True
"""


def test_quiz_files(spark, tmp_path):
    (tmp_path / "quiz1_lock_free.txt").write_text(QUIZ)
    found = study.parse(texts(spark, str(tmp_path))).orderBy("block").collect()
    got = [(r["block"], r["question"], r["correct_answer"], r["question_type"]) for r in found]
    assert got == [
        (0, "A thread shares memory.\nint x = 1;", "True", "boolean"), (1, "How many?", "42", "numeric"), (2, "Pick a level", "High", "choice"), (4, "A trap\nIncorrect answer:", "True", "boolean"),
    ]
    assert [r["block"] for r in study.parse(texts(spark, str(tmp_path)), strict=True).orderBy("block").collect()] == [0, 1, 2]
    named = spark.createDataFrame([("quiz1_lock_free.txt", ["a"]), ("p2p_basics.txt", ["b", "c", "d", "synchronised"]), ("x.txt", ["THREADS"])], "f string, qs array<string>")
    got = named.select(study.title(F.col("f")).alias("t"), study.topic(F.col("f"), F.col("qs")).alias("w"), study.topic(F.col("f"), F.col("qs"), wide=False).alias("n")).collect()
    assert [tuple(r) for r in got] == [("Quiz1 Lock Free", "Synchronization", "General"), ("P2p Basics", "Distributed Systems", "General"), ("X", "Threads & Concurrency", "Threads & Concurrency")]


def test_code_is_set_off(spark):
    rows = ["a < b\nc", "What prints?\nclass A {\n    int x;\n}", None]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(study.as_html(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == ["a &lt; b<br>c", '<p>What prints?</p><pre><code>class A {\n    int x;\n}</code></pre>', ""]


def test_part_names(spark):
    got = spark.createDataFrame([("a_chunk3_shard7",), ("a_chunk3",)], "n string").select(part_of(F.col("n")).alias("p")).collect()
    assert [tuple(r["p"]) for r in got] == [("a", 3, 7), ("a", 3, None)]


def test_sketches_merge_to_longer_periods(spark):
    measured = spark.range(40_000).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 2).alias("timestamp"), (F.col("id") * 7919 % 40_009 * 1000).alias("lag"))
    windows = gold.latency_sketches(measured)
    assert windows.agg(F.max("events"), F.max(F.length("sketch")) < 2000).first()[:] == (60, True)
    day = gold.merged_sketches(windows, "day").where("events = 40000")
    assert day.count() == 1
    found = day.select(F.lit("x").alias("name"), "period", F.lit(0.95).alias("p"), F.expr("kll_sketch_get_quantile_bigint(sketch, 0.95D)").alias("estimate"))
    assert gold.rank_errors(measured, found, "day").first()["error"] <= gold.SKETCH_ERROR
    off = found.withColumn("estimate", F.col("estimate") + 4_000_000)
    assert gold.rank_errors(measured, off, "day").first()["error"] > 0.04
    same = measured.withColumn("lag", F.lit(5))
    assert gold.rank_errors(same, found.withColumn("estimate", F.lit(5)), "day").first()["error"] == 0.0
