"""Files read by stretches of bytes."""

import hashlib
import random
import resource

import pytest
from millrace.operators import blocks
from millrace.sources.files import chunks, ranged_chunks, stretches
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for n in (0, 1, 65535, 65536, 65537, 131072, 1_000_001):
        (root / f"{n} bytes").write_bytes(random.Random(n).randbytes(n))
    return root


@pytest.mark.parametrize(("size", "stretch"), [(65536, 64 << 20), (65536, 65536), (1000, 3500), (7, 100_000)])
def test_chunks_by_range_are_chunks_of_contents(spark, folder, size, stretch):
    if size == 7:
        folder = folder / "65537 bytes"
    got = ranged_chunks(spark, str(folder), size, stretch)
    want = chunks(spark.read.format("binaryFile").load(str(folder)).select(F.col("path").alias("file"), "content"), size)
    digest = lambda df: sorted((r["file"], r["chunk"], r["d"]) for r in df.select("file", "chunk", F.sha1("data").alias("d")).collect())
    assert digest(got) == digest(want) and got.count() > 0
    assert all(r["length"] <= max(size, stretch) and r["first"] % size == 0 for r in stretches(spark, str(folder), size, stretch).collect())


def test_slice_digests_of_a_long_file(spark, tmp_path):
    data = random.Random(1).randbytes(1 << 20) * 48
    (tmp_path / "long").write_bytes(data)
    got = ranged_chunks(spark, str(tmp_path), stretch=8 << 20).select("chunk", blocks.slice_digests(F.col("data"), 8192).alias("d")).collect()
    assert len(got) == 768
    for r in random.Random(2).sample(got, 20):
        part = data[(r["chunk"] - 1) * 65536 : r["chunk"] * 65536]
        assert r["d"] == [hashlib.sha1(part[i * 8192 : (i + 1) * 8192]).hexdigest() for i in range(8)]


def test_a_task_holds_a_few_megabytes(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        for i in range(200):
            f.write(bytes([i]) * (1 << 20))

    def peak(batches):
        for b in batches:
            yield b
        grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        assert grown < 400, grown  # MB of the worker, python and arrow included

    frame = ranged_chunks(spark, str(tmp_path), stretch=1 << 30)
    assert frame.rdd.getNumPartitions() == 1
    assert frame.mapInArrow(peak, frame.schema).select(F.sum(F.length("data"))).first()[0] == 200 << 20
