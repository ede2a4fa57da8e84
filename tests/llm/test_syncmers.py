"""Whole lists of anchors: long texts, unbroken runs, places."""

import random
from collections import Counter, defaultdict

import pytest
from millrace.llm.syncmers import anchors, compared, similarity


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_long_texts_differ_outside_the_smallest_hashes(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(4000)]
    other = [w if i % 40 else f"v{i}" for i, w in enumerate(base)]
    passage = base[1000:1060]
    third = [f"u{rng.randint(0, 9999)}" for _ in range(300)] + passage
    rows = {r["doc_id"]: r for r in compared(texts(spark, " ".join(third), " ".join(base), " ".join(other))).collect()}  # next of 2 is 1, of 1 is 0
    assert len({r["fingerprint"] for r in rows.values()}) == 3
    for a, b in ((2, 1), (1, 0)):
        x, y = ([(p["at"], p["hash"]) for p in rows[i]["anchors"]] for i in (a, b))
        assert len(x) > 1280
        hx, hy = {h for _, h in x}, {h for _, h in y}
        assert rows[a]["near_next"] == pytest.approx(len(hx & hy) / len(hx | hy))
        places = [defaultdict(list), defaultdict(list)]
        for at, side in ((x, places[0]), (y, places[1])):
            for p, h in at:
                side[h].append(p)
        want = sorted(pair for h in hx & hy for pair in zip(places[0][h], places[1][h], strict=False))
        assert [(m["at"], m["other"]) for m in rows[a]["matches_next"]] == want
    moved = Counter(m["other"] - m["at"] for m in rows[1]["matches_next"]).most_common(1)[0]
    assert moved[0] == 300 - 1000 and moved[1] > 25


@pytest.mark.parametrize("front", ["x", "長い"])
def test_unbroken_runs_stay_alike_after_a_character_in_front(spark, front):
    rng = random.Random(2)
    run = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1500)) + "😀" + "".join(rng.choice("abcdef0123") for _ in range(500))
    pair = spark.createDataFrame([(run, front + run)], "a string, b string").select(anchors("a", True).alias("a"), anchors("b", True).alias("b"))
    assert pair.select(similarity("a", "b")).first()[0] > 0.98
