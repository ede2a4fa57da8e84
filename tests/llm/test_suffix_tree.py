"""The suffix tree against one kept in dictionaries and walked word by word."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import suffix_tree as st
from pyspark.sql import functions as F

from .data import document_rows, documents

SMALL = st.Settings(depth=3, context=6, pair=2, prior=2.0, test=3.0)
BEGIN, END = object(), object()


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [END]


class Plain:
    def __init__(self, texts, s):
        self.s, self.unigrams, self.next = s, Counter(), defaultdict(Counter)
        for text in texts:
            past = [BEGIN]
            for w in tokens(text):
                self.unigrams[w] += 1
                for k in range(1, s.depth + 1):
                    if len(past) >= k:
                        self.next[tuple(past[-k:])][w] += 1
                past.append(w)
        self.n, self.v = sum(self.unigrams.values()), len(self.unigrams)
        self.total = {c: sum(f.values()) for c, f in self.next.items()}
        self.candidates = {c for c in self.next if self.total[c] >= s.context}
        self.kept = set()
        for c in self.candidates:
            if any(n >= s.pair for n in self.next[c].values()) and self.divergence(c) * self.total[c] >= s.test:
                self.kept.add(c)
        for k in range(s.depth, 1, -1):
            self.kept |= {x for c in self.kept if len(c) == k for x in (c[1:], c[:-1])}

    def stored(self, c):
        return [w for w, n in self.next[c].items() if n >= self.s.pair]

    def p(self, w, c):
        if not c:
            return (self.unigrams[w] + 1) / (self.n + self.v + 1)
        if w in self.next[c] and self.next[c][w] >= self.s.pair:
            return (self.next[c][w] + self.s.prior * self.p(w, c[1:])) / (self.total[c] + self.s.prior)
        return self.share(c) * self.p(w, c[1:])

    def share(self, c):
        stored = self.stored(c)
        return (1 - sum(self.p(w, c) for w in stored)) / (1 - sum(self.p(w, c[1:]) for w in stored))

    def divergence(self, c):
        stored = self.stored(c)
        return sum(self.p(w, c) * math.log(self.p(w, c) / self.p(w, c[1:])) for w in stored) + (1 - sum(self.p(w, c) for w in stored)) * math.log(self.share(c))

    def score(self, text):
        past, out = [BEGIN], 0.0
        for w in tokens(text):
            state = next((tuple(past[-k:]) for k in range(self.s.depth, 0, -1) if len(past) >= k and tuple(past[-k:]) in self.kept), ())
            out += math.log10(self.p(w, state))
            past.append(w)
        return out

    def base(self, text):
        return sum(math.log10((self.unigrams[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def corpus(seed, n):
    """Texts whose words depend on the two before them."""
    rng = random.Random(seed)
    rule = {}
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            after = rule.setdefault(tuple(words[-2:]) if rng.random() < 0.8 else tuple(words[-1:]), [rng.choice(["Sea", "rain", "É", "tea", "of", f"w{rng.randint(0, 30)}"]) for _ in range(3)])
            words.append(rng.choice(after))
        yield (i, rng.choice((" ", "\n", "\t ")).join(words))


@pytest.fixture(scope="module")
def rows():
    return [*corpus(2, 160), (900, None), (901, ""), (902, "NEW words Only"), (903, "sea Sea " * 3000), (3, "rain of tea"), (3, "rain of tea")]


@pytest.mark.parametrize("head", [1 << 20, 60])
def test_scores_are_those_of_the_longest_state(spark, rows, head):
    plain = Plain([t for i, t in rows[:120]], SMALL)
    assert {len(c) for c in plain.kept} == {1, 2, 3} and len(plain.kept) < len(plain.candidates)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tree = st.grown(spark.createDataFrame(rows[:120], "doc_id long, text string"), st.Settings(**{**SMALL.__dict__, "head": head}))
    assert (tree.tokens, tree.words) == (plain.n, plain.v)
    got = st.scored(docs.withColumn("score", F.lit("clashing")).withColumn("_score", F.lit(1)), tree).collect()
    want = [(i, len(tokens(t)), sum(plain.unigrams[w] > 0 for w in tokens(t)), plain.base(t), plain.score(t)) for i, t in rows]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert tuple(g[:3]) == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-8)
    assert tree.rows.count() > 60  # of 60 in the head the rest are joined


def test_every_state_adds_up_to_one(rows):
    plain = Plain([t for i, t in rows[:120]], SMALL)
    others = plain.v + 1 - len(plain.unigrams)
    for c in sorted(plain.kept, key=repr)[:40]:
        assert sum(plain.p(w, c) for w in plain.unigrams) + others * plain.p("nowhere", c) == pytest.approx(1)


def test_keys_are_sparks_own(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 50))
    got = [r[0] for r in spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert st.joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == got


def test_empty_corpora(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    tree = st.grown(docs.limit(0))
    got = {r["doc_id"]: tuple(r)[1:] for r in st.scored(docs, tree).collect()}
    assert got == {1: (3, 0, 0.0, 0.0), 2: (1, 0, 0.0, 0.0)}
    assert st.scored(docs.limit(0), st.grown(docs)).isEmpty()


def test_the_query(spark, tmp_path):
    docs = documents(spark, document_rows(n=90))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = st.op12_suffix_tree_scores(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    plain = Plain([t for i, t in rows if not held[i]], st.Settings())
    want = [(i, held[i], len(tokens(t)), sum(plain.unigrams[w] > 0 for w in tokens(t)), plain.n, plain.base(t), plain.score(t)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0], r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-8)
    assert any(held.values())
