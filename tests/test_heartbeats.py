"""Catalogue and liveness kept by a stream, against the batch operators over the same heartbeats."""

import random

from millrace.operators import blocks
from millrace.streaming import heartbeats as hb
from pyspark.sql import functions as F


def beats(rng, start, n, servers=6):
    """(server, ms, kind, parts) in steps of 15 s; some servers fall silent."""
    out = []
    for i in range(n):
        for s in range(servers):
            if s == 2 and i + start > 4 or s == 4 and 3 < i + start < 22:
                continue
            at = (start + i) * 15000 + s * 10
            parts = [(rng.randint(0, 9), rng.randint(0, 8)) for _ in range(rng.randint(0, 5))]
            out.append((s, at, hb.FULL if rng.random() < 0.3 else hb.SHORT, parts or None))
    return out


def batch(rows):
    held, last = {}, {}
    for s, at, kind, parts in sorted(rows, key=lambda r: r[1]):
        held[s] = (set() if kind == hb.FULL else held.get(s, set())) | set(parts or [])
        last[s] = at
    return {(s, *p) for s, ps in held.items() for p in ps}, last


def test_the_stream_ends_where_batches_do(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    first, second = beats(rng, 0, 18), beats(rng, 18, 12)
    end = [(9, 30 * 15000 + 40000, hb.SHORT, None)]  # a server that moves the watermark on

    def arrive(rows):
        frame = spark.createDataFrame([(s, at / 1000, k, p) for s, at, k, p in rows], "server long, t double, kind string, parts array<struct<file_no: long, fragment: long>>")
        frame.select("server", F.col("t").cast("timestamp").alias("beat_at"), "kind", "parts").coalesce(1).write.mode("append").parquet(f"{root}/beats")

    def run():
        query = hb.start(spark, spark.readStream.schema(hb.BEATS).parquet(f"{root}/beats"), f"{root}/changes", f"{root}/checkpoint", availableNow=True)
        query.awaitTermination()
        return spark.read.parquet(f"{root}/changes")

    arrive(first)
    got = run()
    assert {tuple(r) for r in hb.catalogue(got).collect()} == batch(first)[0]
    arrive(second)
    arrive(end)
    got = run()
    held, last = batch(first + second + end)
    assert {tuple(r) for r in hb.catalogue(got).collect()} == held
    # as the batch operators have it: each server's heartbeats merged in order, and silence up to the watermark
    known = spark.createDataFrame([], "file_no long, fragment long, server long")
    now = max(at for at in last.values()) - 10000
    silent = blocks.dead_servers(spark.createDataFrame(list(last.items()), "server long, beat_ms long"), F.lit(now))
    assert {r["server"] for r in hb.dead(got).collect()} == {r["server"] for r in silent.collect()} == {2}
    log = [(r["change"], r["server"]) for r in got.where("change in ('alive', 'dead')").orderBy("at_ms").collect()]
    assert log.count(("dead", 4)) == 1 and log.count(("alive", 4)) == 2 and log.index(("dead", 4)) > log.index(("alive", 4))
    # one server's heartbeats, merged by the batch operator one after another
    for s, _, kind, parts in sorted((r for r in first + second if r[0] == 1 and r[3]), key=lambda r: r[1])[-6:]:
        known = blocks.merged_catalogue(known, spark.createDataFrame([(*p, s) for p in parts], known.schema), kind == hb.FULL)
    mine = [r for r in first + second if r[0] == 1 and r[3]]
    assert {(r["server"], r["file_no"], r["fragment"]) for r in known.collect()} == batch(sorted(mine, key=lambda r: r[1])[-6:])[0]
