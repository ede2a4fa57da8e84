"""Long texts are fingerprinted and hashed in pieces: the same results at any size of them, in bounded memory."""

import random
import threading
import time

import numpy as np
import psutil
import pyarrow as pa
import pytest
from millrace.llm import near_copies, simhash, textbytes

from .test_brute_force import slow_simhash

RNG = random.Random(11)
TEXTS = [None, "", " \n", "One", "a b c", "a b c d", "a" * 400, " x" * 9] + [
    " ".join(RNG.choice(["Ab", "x", "日本", "é" * 40]) + str(RNG.randrange(99)) for _ in range(RNG.randrange(60))) + RNG.choice(["", "\n "]) for _ in range(80)
]


@pytest.mark.parametrize("piece", [1, 7, 50, 300])
def test_pieces_do_not_change_a_fingerprint(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    assert [int(simhash.simhash(pa.array([t], pa.string()))[0]) for t in TEXTS] == [slow_simhash(t or "") for t in TEXTS]


def test_runs_do_not_change_sums_or_hashes(monkeypatch):
    def found():
        w, h = near_copies._words(pa.array(TEXTS))
        g, count = near_copies.shingle_sets(w, h)
        return [h, near_copies.prints(g, count, 3, 2), simhash.simhash(pa.array(TEXTS))]

    want = found()
    monkeypatch.setattr(textbytes, "BITS_RUN", 16)
    monkeypatch.setattr(textbytes, "RUN", 32)
    monkeypatch.setattr(textbytes, "_powers", {})
    assert all((a == b).all() for a, b in zip(found(), want, strict=True))


def test_memory_of_a_long_text_is_bounded():
    text = pa.array([" ".join(f"word{i * 7919 % 100003}" for i in range(2_500_000))])  # 25 MB; 64 bytes a shingle would take 160 MB
    me, most, done = psutil.Process(), [0], threading.Event()
    start = me.memory_info().rss

    def watch():
        while not done.is_set():
            most[0] = max(most[0], me.memory_info().rss)
            time.sleep(0.005)

    watcher = threading.Thread(target=watch)
    watcher.start()
    value = simhash.simhash(text)
    done.set()
    watcher.join()
    assert value.dtype == np.uint64 and most[0] - start < 120 << 20
