"""Document scores of the line classifier against all labellings of their lines, and texts that are empty or very long."""

import itertools

import numpy as np
import pyarrow as pa
from millrace.llm.line_crf import Crf, document_scores, line_features, op6_line_crf_quality
from millrace.llm.textbytes import bytes_of

from .data import document_rows, documents

TEXTS = ["One line.", "A first line\nBUY | NOW | $$$\n\nand the last one", "", None, "\n\n", "x\n" * 6 + "ends here.", "Été\r\nand\ttabs  \n日本語"]


def plain(text, model):
    """Each labelling has the sum of its good lines' scores and of its ties; a line's marginal is its share of their exponentials."""
    x, chars, first = line_features(*bytes_of(pa.array([text], pa.string())))
    around = np.zeros((len(x) + 2, x.shape[1]))
    around[1:-1] = (x - model.middle) / model.scale
    score = [float(np.concatenate((around[i + 1], around[i], around[i + 2], [1])) @ model.weights) for i in range(len(x))]
    total, good = 0.0, np.zeros(len(x))
    for labels in itertools.product((0, 1), repeat=len(x)):
        e = np.exp(sum(s for s, y in zip(score, labels, strict=True) if y) + sum(model.ties[a, b] for a, b in zip(labels, labels[1:])))
        total += e
        good += e * np.array(labels)
    weight = np.maximum(chars, 1e-3)
    return float((good / total * weight).sum() / weight.sum())


def test_scores_are_length_weighted_marginals():
    n = line_features(*bytes_of(pa.array(["a"])))[0].shape[1]
    for seed in range(5):
        rng = np.random.default_rng(seed)
        model = Crf(rng.normal(0, 0.4, 3 * n + 1), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, n), rng.uniform(0.5, 2, n))
        got = document_scores(pa.array(TEXTS, pa.string()), model)
        assert np.allclose(got, [plain(t, model) for t in TEXTS], rtol=1e-5)


def test_query_over_empty_and_long_texts(spark, tmp_path):
    rows = document_rows(n=40)
    rows += [(900, "a line of some words\n" * 60_000, *rows[0][2:]), (901, "w" * 1_500_000, *rows[0][2:])]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op6_line_crf_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({round(r["score"], 12) for r in got if r["doc_id"] in (200, 201)}) == 1
    none = tmp_path / "none"
    documents(spark, []).write.parquet(str(none / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(none / "labels.parquet"))
    assert op6_line_crf_quality(spark, str(none)).isEmpty()
