"""Phrases of many texts at once: whether few, all or none of them go to the tasks."""

import random

import numpy as np
import pytest
from millrace.operators import phrases, study


@pytest.mark.parametrize("head", [0, 25, phrases.HEAD])
def test_first_of_many_phrases(spark, head):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abÉ日 ") for _ in range(rng.randint(0, 90)))) for i in range(150)]
    sought = [(rng.randrange(60), (t := rng.choice(texts)[1])[(a := rng.randint(0, 20)) : a + rng.randint(1, 14)], f"e{i}") for i in range(80)] + [(70, "a" * 95, "never")]
    want = {}
    for i, t in texts:
        met = [(p, e) for p, phrase, e in sought if phrase and phrase.lower() in t.lower()]
        if met:
            want[i] = min(met)[1]
    got = study.match_phrases(spark.createDataFrame(texts, "id long, question_text string"), spark.createDataFrame(sought, "place long, phrase string, explanation string"), head=head).collect()
    assert {r["id"]: r["explanation"] for r in got} == want and len(got) == len(want) > 80


def test_hashes_that_agree_are_told_apart():
    """All windows lie about their hash, and all are in the bitmap."""
    same = np.zeros(3, np.uint64)
    s = phrases.Sought(["zz", "bc", "ab"], same, np.arange(3), np.full(1 << (phrases.BITS - 3), 255, np.uint8), [2], True)
    real, phrases.window_hashes = phrases.window_hashes, lambda points, sizes: [(2, np.zeros(len(points) - 1, np.uint64))]
    try:
        assert phrases.found_in(["abc", "xab", "q", "yyy"], s) == ({0: 1, 1: 2}, {(3, "yy")})
    finally:
        phrases.window_hashes = real
