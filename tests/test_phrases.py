"""Phrases from a table against each text, one after another."""

import random

from millrace.operators import study


def test_first_phrase_by_place(spark):
    rng = random.Random(3)
    words = ["Lock", "thread", "é", "日本語", "queue", "ab", "a", "the the", "x\ny"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, ""), (502, "z" * 50_000 + "QUEUE the"), (503, "nothing here")]
    phrases = [(i, rng.choice(words) + " " + rng.choice(words), f"e{i}") for i in range(40)]
    phrases += [(50, "É", "one"), (51, "AB", "two"), (52, "", "empty"), (53, None, "null"), (54, "zzzz", "long"), (55, "no such phrase", "never"), (56, "本語 ", "three"), (3, "the", "a tie")]
    want = {}
    for i, t in texts:
        met = [(p, e) for p, phrase, e in phrases if phrase and phrase.lower() in (t or "").lower()]
        if met:
            want[i] = min(met)[1]
    frame = spark.createDataFrame(texts, "id long, question_text string")
    table = spark.createDataFrame(phrases, "place long, phrase string, explanation string")
    got = study.match_phrases(frame, table).collect()
    assert {r["id"]: r["explanation"] for r in got} == want and len(got) == len(want) > 80
    assert study.match_phrases(frame, table.limit(0)).isEmpty() and study.match_phrases(frame.limit(0), table).isEmpty()
