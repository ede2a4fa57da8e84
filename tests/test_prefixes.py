"""Beginnings of texts against keys, pair by pair; files of quizzes parsed once."""

import random

from millrace.operators import study
from pyspark.sql import functions as F


def test_first_entry_by_place(spark):
    rng = random.Random(6)
    words = ["Lock", "Lock", "thread", "é", "日本", "a"]
    texts = [(i % 70, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(140)] + [(900, None), (901, "  ")]
    keys = [(i % 25, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))[: rng.randint(0, 40)], f"e{i}") for i in range(50)]
    want = set()
    for i, t in texts:
        tidy = " ".join((t or "").split())
        met = [(p, e) for p, k, e in keys if tidy and k.strip() and (tidy.startswith(k.strip()) or k.strip().startswith(tidy))]
        if met:
            want.add((i, t, min(met)[1]))
    got = study.match_prefix(spark.createDataFrame(texts, "id long, question_text string"), spark.createDataFrame(keys, "place long, key string, explanation string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60


def test_copies_of_a_key_are_joined_once(spark):
    n = 30_000
    texts = spark.range(n).select("id", F.lit("Supplier of all").alias("question_text"))
    entries = spark.range(n).select((F.col("id") + 5).alias("place"), F.lit("Supplier").alias("key"), F.concat(F.lit("e"), "id").alias("explanation"))
    assert study.match_prefix(texts, entries).groupBy("explanation").count().collect() == [("e0", n)]


def test_lines_are_split_once(spark):
    texts = spark.createDataFrame([(1, "Results for question 1.\n1\n1 / 1 point\nIs it?\nTrue\nFalse")], "file long, text string")
    found = study.parse(texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(body") <= 2 and plan.count("RLIKE") < 15
    assert [tuple(r)[2:] for r in found.collect()] == [("Is it?", "True", "boolean")]
