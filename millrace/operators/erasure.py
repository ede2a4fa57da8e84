"""Reed-Solomon shards over GF(256), and proofs of work: what has no built-in function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import DATA_SHARDS, PARITY_SHARDS, SHARDS

FIELD = 0x11D  # fixed value: x^8 + x^4 + x^3 + x^2 + 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp = np.zeros(510, np.int64)
    x = 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        x = x << 1 ^ (FIELD if x & 0x80 else 0)
    log = np.zeros(256, np.int64)
    log[exp[:255]] = np.arange(255)
    return exp, log


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    exp, log = _tables()
    return np.where((a == 0) | (b == 0), 0, exp[log[a] + log[b]])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(times(a[:, :, None], b[None, :, :]), axis=1)


def inverse(m: np.ndarray) -> np.ndarray:
    exp, log = _tables()
    n = len(m)
    work = np.concatenate((m, np.eye(n, dtype=np.int64)), axis=1)
    for i in range(n):
        pivot = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, pivot]] = work[[pivot, i]]
        work[i] = times(work[i], exp[(255 - log[work[i, i]]) % 255])
        for r in range(n):
            if r != i and work[r, i]:
                work[r] ^= times(work[i], work[r, i])
    return work[:, n:]


@lru_cache(maxsize=1)
def matrix() -> np.ndarray:
    """Rows for all shards: data shards are the data itself; any six rows can be inverted (powers of the shard number, times the inverse of the first six)."""
    exp, _ = _tables()
    powers = np.array([[1 if c == 0 else 0 if r == 0 else int(exp[(_tables()[1][r] * c) % 255]) for c in range(DATA_SHARDS)] for r in range(SHARDS)])
    return product(powers, inverse(powers[:DATA_SHARDS]))


def encode(data: bytes) -> list[bytes]:
    """Nine shards of equal length: six of the data, zero-padded, and three of parity."""
    size = -(-len(data) // DATA_SHARDS)
    rows = np.frombuffer(data.ljust(size * DATA_SHARDS, b"\0"), np.uint8).reshape(DATA_SHARDS, size).astype(np.int64)
    parity = product(matrix()[DATA_SHARDS:], rows) if size else np.zeros((PARITY_SHARDS, 0))
    return [r.astype(np.uint8).tobytes() for r in (*rows, *parity)]


def decode(shards: dict[int, bytes], size: int) -> bytes:
    """The data from any six shards, cut to its size."""
    if len(shards) < DATA_SHARDS:
        raise ValueError(f"{len(shards)} shards can't restore the data; it takes {DATA_SHARDS}")
    chosen = sorted(shards)[:DATA_SHARDS]
    rows = np.stack([np.frombuffer(shards[i], np.uint8).astype(np.int64) for i in chosen])
    data = rows if chosen == list(range(DATA_SHARDS)) else product(inverse(matrix()[chosen]), rows)
    return data.astype(np.uint8).tobytes()[:size]


def shards_of(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``chunks(*keys, data)`` to ``(*keys, shard, data, size)``."""
    schema = chunks.select(*keys, F.lit(0).alias("shard"), F.lit(b"").alias("data"), F.lit(0).cast("long").alias("size")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [encode(d) for d in frame["data"]]
            out = frame[keys].loc[frame.index.repeat(SHARDS)].reset_index(drop=True)
            yield out.assign(shard=np.tile(np.arange(SHARDS, dtype=np.int32), len(frame)), data=[s for m in made for s in m], size=np.repeat([len(d) for d in frame["data"]], SHARDS))

    return chunks.select(*keys, "data").mapInPandas(run, schema)


def restored(shards: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, shard, data, size)`` to ``(*keys, data)``; null data where fewer than six shards are left."""
    grouped = shards.groupBy(*keys, "size").agg(F.collect_list(F.struct("shard", "data")).alias("parts"))
    schema = grouped.select(*keys, F.lit(b"").alias("data")).schema
    schema["data"].nullable = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = []
            for size, parts in zip(frame["size"], frame["parts"], strict=True):
                have = {p["shard"]: bytes(p["data"]) for p in parts}
                data.append(decode(have, size) if len(have) >= DATA_SHARDS else None)
            yield frame[keys].assign(data=data)

    return grouped.mapInPandas(run, schema)


def leading_zero_bits(digest: bytes) -> int:
    return len(digest) * 8 - int.from_bytes(digest, "big").bit_length()


def with_proof(tasks: DataFrame, text: str, bits: int) -> DataFrame:
    """``tasks`` with the least ``nonce`` for which SHA3-256 of text and nonce begins with ``bits`` zero bits."""
    schema = tasks.withColumn("nonce", F.lit(0).cast("long")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for t in frame[text]:
                base, nonce = hashlib.sha3_256(f"{t}:".encode()), 0
                while True:
                    tried = base.copy()
                    tried.update(str(nonce).encode())
                    if leading_zero_bits(tried.digest()) >= bits:
                        break
                    nonce += 1
                found.append(nonce)
            yield frame.assign(nonce=found)

    return tasks.mapInPandas(run, schema)
