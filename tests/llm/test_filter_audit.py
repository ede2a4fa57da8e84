"""The walk over orders, and the audit against the five conditions applied one after another."""

import itertools
import random
import re

import numpy as np
from millrace.llm.filter_audit import FILTERS, MEASURES, OP13_SQL, audit, failures, interactions, mask_cells, op13_filter_interactions, shares, transpositions

from .data import DOC_SCHEMA, documents, duck, spark_rows, words

LABELS = "doc_id long, quality int, toxic int"


def test_each_order_once_by_single_swaps():
    for n in (1, 2, 3, 5):
        seen, before = [], None
        for order, at in transpositions(n):
            if before is not None:
                assert [i for i in range(n) if order[i] != before[i]] == [at, at + 1]
            before = list(order)
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_only_two_steps_change_and_shares_add_up():
    cells = np.random.default_rng(5).integers(0, 50, (3, 3, 32))
    last = None
    for order, out in audit(cells):
        now = {m: out[m].copy() for m in out}
        assert (now["removed"].sum(axis=1) == cells[:, 0, 1:].sum(axis=1)).all() and (now["kept"][:, -1] == cells[:, 0, 0]).all()
        if last is not None:
            at = [k for k in range(5) if order[k] != last[0][k]]
            for k in set(range(5)) - set(at):
                assert all((now[m][:, k] == last[1][m][:, k]).all() for m in now)
        last = (list(order), now)
    assert (shares(cells).sum(axis=1) == 120 * cells[:, 0, 1:].sum(axis=1)).all()


def slow(docs, labels):
    """Order by order, document by document."""
    rows = [(i, p or "", t or "") for i, t, p in docs]
    marks = {}
    for i, q, t in labels:
        g, x = marks.get(i, (0, 0))
        marks[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    failing = []
    for i, p, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failing.append((p, {f for f in bad if bad[f]}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for p in {r[0] for r in failing}:
        share = dict.fromkeys(FILTERS, 0)
        for order in itertools.permutations(FILTERS):
            left = [r for r in failing if r[0] == p]
            everyone = list(left)
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(gone)
                out[p, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in everyone) - len(gone), sum(r[1] == {f} for r in everyone), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (q, order, k), m in out.items():
            if q == p:
                m.append(share[order[k - 1]])
    return out


def sample():
    rng = random.Random(8)
    rows = []
    for i in range(40):
        text = words(rng, rng.choice((3, 150, 260)), ("a", "b") if i % 3 else ("the", "Wide", "SEA", "étude", "日本"))
        rows.append((i, text + ("\t#" if i % 5 == 0 else ""), ("en", "fr", None)[i % 3]))
    rows += [(100 + i, rows[2][1], "en") for i in range(5)] + [(2, rows[2][1], "fr"), (None, rows[2][1], "en"), (50, None, "en"), (51, "", None), (49, "", "fr"), (60, "A" * 9 + "\x0b\x0c b\x00c", "en"), (61, "x " * 300000 + "|", "de")]
    return rows, [(i, i % 2, (i + 1) % 3 == 0) for i in range(0, 60, 2)] + [(100, 1, 1), (100, 0, 0), (None, 1, 1), (2, None, 1)]


def test_audit_is_what_filters_do_in_order(spark):
    rows, labels = sample()
    docs = spark.createDataFrame([(i, t, p) for i, t, p in rows], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], LABELS)
    got = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in MEASURES] for r in interactions(mask_cells(failures(docs, marks))).collect()}
    assert got == slow(rows, labels)
    assert interactions(mask_cells(failures(docs.limit(0), marks))).isEmpty()


def test_query_and_sql(spark, tmp_path):
    rows, labels = sample()
    docs = spark.createDataFrame([(i, t, p, "s", 1, 2, "h", 3, 0.5, "z") for i, t, p in rows if i is not None], DOC_SCHEMA).withColumnRenamed("size", "words").withColumnRenamed("hash", "digest")
    marks = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], LABELS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    assert spark_rows(op13_filter_interactions(spark, str(tmp_path))) == duck(OP13_SQL, documents=docs, labels=marks)
    documents(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert op13_filter_interactions(spark, str(tmp_path / "none")).isEmpty()
