"""Runs against every stretch and period tried one by one, and the query against its SQL."""

import random
import re
import time

import numpy as np
import pytest
from millrace.llm import periodic_runs as pr

from .data import document_rows, documents, duck, spark_rows


def slow(words, least=6, times=4):
    n, out = len(words), set()
    for s in range(n):
        for e in range(s + least, n + 1):
            q = next((p for p in range(1, (e - s) // times + 1) if all(words[i] == words[i + p] for i in range(s, e - p))), None)
            if q and not (s and words[s - 1] == words[s - 1 + q]) and not (e < n and words[e] == words[e - q]):
                out.add((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng, n):
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 60):
            piece = [rng.choice("ab" if rng.random() < 0.7 else "abcdefg") for _ in range(rng.randint(1, 6))]
            words += piece * rng.choice((1, 1, 2, 4, 5))
        yield words


def found(lists):
    ids = np.array([ord(w) for words in lists for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    out = [[] for _ in lists]
    for t, s, e, p in pr.runs_in(ids, first).tolist():
        out[t].append((s - int(first[t]), e - s, p))
    return out


@pytest.mark.parametrize("pairs", [1 << 19, 7])
def test_runs_are_all_maximal_ones(monkeypatch, pairs):
    monkeypatch.setattr(pr, "PAIRS", pairs)
    lists = list(texts(random.Random(4), 150))
    assert found(lists) == [slow(x) for x in lists] and sum(map(bool, found(lists))) > 30


def test_hashes_that_lie_are_caught(monkeypatch):
    lists = list(texts(random.Random(6), 60))
    monkeypatch.setattr(pr, "mix", lambda h: h % np.uint64(3))
    assert found(lists) == [slow(x) for x in lists]


def test_long_texts_take_linear_pairs():
    began = time.perf_counter()
    assert found([["a"] * 200_000, list("ab") * 100_000]) == [[(0, 200_000, 1)], [(0, 200_000, 2)]]
    assert time.perf_counter() - began < 30


def test_rows_of_all_kinds(spark):
    rng = random.Random(9)
    rows = document_rows() + [(300 + i, "\t".join(words), "en", "s", 0, 1, "h", 2, 0.5, "z") for i, words in enumerate(texts(rng, 40))]
    rows += [(400, "x\x0by " * 50 + "x\x00  é", "en", "s", 0, 1, "h", 2, 0.5, "z"), (401, " la" * 120_000, "en", "s", 0, 1, "h", 2, 0.5, "z")]
    docs = documents(spark, rows).withColumnsRenamed({"size": "runs", "hash": "collapsed", "fp": "n_words"})
    got = pr.repeated_runs(docs).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        runs = slow(words) if len(words) < 500 else [(0, len(words), 1)] if r[0] == 401 else []
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        want.append((r[0], len(words), [tuple(x) for x in runs], " ".join(w for i, w in enumerate(words) if i not in dropped)))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in got)
    with pytest.raises(ValueError):
        pr.repeated_runs(docs, times=2)


@pytest.mark.parametrize("empty", [False, True])
def test_query_and_sql(spark, tmp_path, empty):
    docs = documents(spark, [] if empty else document_rows(n=120))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    query = pr.op11_periodic_runs(spark, str(tmp_path))
    assert spark_rows(query) == duck(pr.OP11_SQL, documents=docs.select("doc_id", "text"))
    assert empty or query.where("n_runs > 0").count() > 3
