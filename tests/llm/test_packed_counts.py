"""Counts and lookups of the suffix tree dealt out as packed columns, with lists too short for all words and contexts."""

import re
from pathlib import Path

import numpy as np
import pytest
from millrace.llm import suffix_tree as st
from millrace.sources.shared import shared_dir

from .test_suffix_tree import SMALL, Plain, corpus, tokens


@pytest.mark.parametrize("values", [[], [0, 0], [1, 300, 0], [2**64 - 1, 0, 7], list(range(1000))])
def test_packed_numbers_come_back(values):
    assert st.unpacked(st.packed(np.array(values, np.uint64))).tolist() == values


def test_codes_are_one_to_one():
    key = np.arange(1, 41, dtype=np.uint64) << np.uint64(50)
    codes = st.Codes(st.Listed(st._places(key[:30]), True), st.Listed(st._places(key), True), 6)
    c, w = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(40)))
    got = codes.grid.of(c, w)
    assert len(np.unique(got)) == 1200 and int(got.max()).bit_length() <= codes.grid.bits
    assert [x.tolist() for x in codes.keys(got)] == [key[c].tolist(), key[w].tolist()]
    assert len(np.unique(got >> np.uint64(codes.grid.bits - 6))) == 64  # all ranges have some


@pytest.mark.parametrize(("listed", "held"), [(1 << 20, 50), (8, 1 << 22), (0, 50)])
def test_scores_with_short_lists_and_many_batches(spark, listed, held):
    rows = [*corpus(5, 120), (900, None), (901, "sea Sea " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = Plain([t for _, t in rows], SMALL)
    got = {r["doc_id"]: r for r in st.scored(docs, st.grown(docs, st.Settings(**SMALL.__dict__ | {"head": 20, "listed": listed, "held": held}))).collect()}
    for i, t in rows:
        assert got[i]["n_tokens"] == got[i]["n_known"] == len(tokens(t))
        assert (got[i]["base_score"], got[i]["score"]) == pytest.approx((plain.base(t), plain.score(t)), rel=1e-8)


def test_a_task_gives_out_a_row_for_each_range():
    """Not one for each pair, which took 2.4 GB of disk for 0.5 GB of texts."""
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(1, 2**63, 5000).astype(np.uint64))
    for room in (5000, 100):  # others go by their hashes
        some = st.Listed(st._places(key[:room]), room == 5000)
        held = st._Held(st.Codes(some, some, 6))
        a, b = key[rng.integers(0, 5000, (2, 200_000))]
        held.add(a, b)
        out = held.given_out()
        assert out.num_rows <= 64 and held.n == 0
        n = sum(int(st.unpacked(r[c]).sum()) for r in out.to_pylist() for c in ("code_n", "pair_n") if r[c])
        assert n == 200_000
        assert out.nbytes < (5 if room == 5000 else 20) * 200_000


def test_what_the_tree_was_made_from_is_deleted(spark):
    """Only the tree's own table stays in the shared folder."""
    docs = spark.createDataFrame(list(corpus(7, 60)), "doc_id long, text string")
    top = Path(re.sub("^file:/*", "/", shared_dir(spark)))
    before = set(top.iterdir())
    tree = st.grown(docs, SMALL)
    assert len([p for p in set(top.iterdir()) - before if any(p.rglob("*.parquet"))]) == 1
    assert tree.rows.count() > 0
