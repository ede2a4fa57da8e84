"""The bound on lines that the classifier learns from."""

import numpy as np
from millrace.llm.line_crf import line_share, pieces, train

from .data import documents


def test_share_and_pieces_hold_the_bound():
    counts = np.array([1, 5, 10**6, 40, 300])
    share = line_share(counts, 200)
    assert np.minimum(counts, share).sum() <= 200 < np.minimum(counts, share + 1).sum()
    assert line_share(counts, 10**7) == 10**6
    for n, share in ((10, 20), (1000, 1), (1000, 57), (58, 57)):
        runs = pieces(n, share)
        assert sum(b - a for a, b in runs) == min(n, share) and all(b <= c for (_, b), (c, _) in zip(runs, runs[1:], strict=False))
        assert runs[0][0] == 0 and (len(runs) == 1 or runs[-1][1] == n)


def test_one_long_text_pushes_no_other_out(spark):
    rows = [(i, "\n" * 3000 if i % 20 == 1 else ("Good words of prose here.\n" if i % 2 else "|$$|##|\n") * 5, "en", "s", 0, 1, "h", 2, 0.5, "z") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert np.abs(train(documents(spark, rows), labels, most_lines=600).weights).max() > 0.1
