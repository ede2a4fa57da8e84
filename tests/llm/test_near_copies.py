"""The near-copies stage against all pairs of shingle sets."""

import itertools
import random

import corpus_pipeline
import pytest
from millrace.llm.simhash import near_duplicates

from .data import document_rows, documents


def slow_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(rows):
    sets = [slow_set(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {g: min(r[0] for r, x in zip(rows, group, strict=True) if x == g) for g in group}
    return sorted({r[0] for r, g in zip(rows, group, strict=True) if least[g] == r[0]})


def edited_rows():
    """Bases of 150 to 600 words, each with copies in which 1 to 8 words are replaced, and halves that share a passage only."""
    rng = random.Random(5)
    rows, used = [], itertools.count()
    for _ in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(150, 600))]
        for edits in (0, 1, 2, 3, 4, 6, 8):
            copy = list(base)
            for i in rng.sample(range(len(base)), edits):
                copy[i] = f"new{rng.randint(0, 5000)}"
            rows.append((next(used), " ".join(copy), "en", "s", 0))
        half = base[: len(base) // 2] + [f"w{rng.randint(0, 5000)}" for _ in range(len(base) // 2)]
        rows.append((next(used), " ".join(half), "en", "s", 0))
    rng.shuffle(rows)
    return [(*r, 1, "h", 2, 0.5, "z") for r in rows]


@pytest.mark.parametrize("rows", ["edited", "awkward"])
def test_stage_keeps_one_of_similar_texts(spark, rows):
    given = edited_rows() if rows == "edited" else [r for r in document_rows() if r[0] is not None]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, given), "")
    want = slow_kept(given)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    if rows == "edited":  # 4 bits of SimHash leave most of these copies
        assert near_duplicates(documents(spark, given)).where("doc_id = component_id").count() > len(want)
