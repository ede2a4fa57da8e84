"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  A line's features are shape statistics of itself and
of the lines before and after it; neighbouring labels are tied by a transition
score.  Training takes every line's label from its document.  A document's
score is the mean of its lines' forward-backward marginals, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table, text_of
from .textbytes import LOWER, NOT_SPACE, bytes_of, mix, slices, word_hashes, words_of

TRAIN_DOCS, TRAIN_LINES = 4000, 200_000  # bounds of the labelled sample that the fit reads
PIECES = 8  # runs that a text with more lines than its share gives
KEEP_AT = 0.3
STEPS, RATE, RIDGE = 120, 0.08, 1e-3

_UPPER, _LOWER, _DIGIT, _SPACE, _PIPE, _SYMBOL, _STOP, _OTHER, _HIGH, _TAIL = range(10)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = _UPPER, _LOWER, _DIGIT
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[[ord(c) for c in "!#$%&*+<=>@^_~\\"]] = _SYMBOL
_CLASS[[ord(c) for c in ".?:;"]] = _STOP
_CLASS[ord("|")] = _PIPE
_CLASS[0x80:0xC0], _CLASS[0xC0:] = _TAIL, _HIGH
N_FEATURES = 18


def lines_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin and end in the bytes, as one list of places, and the number of each text's first line. An empty text is one empty line."""
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.sort(np.concatenate((at[:-1], breaks + 1)), kind="stable")
    # a text that ends in a break has an empty last line that begins where the next text does; sorting keeps one entry for each
    count = np.bincount(np.searchsorted(at[1:], breaks, side="right"), minlength=len(at) - 1) + 1
    return np.append(starts, at[-1]), np.concatenate(([0], np.cumsum(count)))


def line_features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of each line, its length in characters, and the number of each text's first line."""
    edges, first = lines_of(buf, at)
    n = len(edges) - 1
    size = np.diff(edges)
    line = np.repeat(np.arange(n), size)
    kinds = np.bincount(line * 10 + _CLASS[buf], minlength=n * 10).reshape(n, 10).astype(np.float64)
    chars = size - kinds[:, _TAIL]
    letters = kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _HIGH]
    shown = np.maximum(chars - kinds[:, _SPACE], 1)
    w = words_of(LOWER[buf], edges, NOT_SPACE)
    count = np.diff(w.first).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(w.first))
    h = word_hashes(w)
    keys, place = np.unique(h ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct = np.bincount(of[place], minlength=n) if len(keys) else np.zeros(n)
    same = np.zeros(n)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        same = np.bincount(of[1:][again], minlength=n)
    tail = np.bincount(of[np.isin(_CLASS[buf[w.ends - 1]], (_SYMBOL, _PIPE))], minlength=n) if len(h) else np.zeros(n)
    text = np.maximum(count, 1)
    filled = size > 0
    last, lead = np.zeros(n), np.zeros(n)
    last[filled] = np.isin(_CLASS[buf[np.maximum(edges[1:][filled] - 1 - (buf[edges[1:][filled] - 1] == 0x0A), 0)]], (_STOP,))
    lead[filled] = np.isin(_CLASS[buf[edges[:-1][filled]]], (_UPPER, _HIGH))
    upper, symbol, pipe = kinds[:, _UPPER] / np.maximum(letters, 1), kinds[:, _SYMBOL] / shown, kinds[:, _PIPE] / shown
    x = np.stack(
        [
            np.log1p(chars), upper, upper > 0.5, symbol, symbol > 0.04, pipe, pipe > 0.02, kinds[:, _DIGIT] / shown,
            kinds[:, _OTHER] / shown, distinct / text, distinct < 0.5 * text, same / text, same > 0.2 * text, tail / text,
            shown / text / 10, last, lead, ~filled,
        ],
        axis=1,
    )
    return x.astype(np.float32), chars, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it in its text (zeros outside), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate((x, before, after, np.ones((len(x), 1), x.dtype)), axis=1)


@dataclass
class Crf:
    weights: np.ndarray  # of the features, for good against bad
    ties: np.ndarray  # 2 x 2, from a line's label to the next one's
    middle: np.ndarray
    scale: np.ndarray

    def line_scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.middle) / self.scale, first) @ self.weights


def chain(score: np.ndarray, first: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of 'good' for each line, and expected counts of each pair of labels, of all chains together.

    All chains advance a line at a time, longest first, so those still going are a prefix.
    """
    length = np.diff(first)
    by_length = np.argsort(-length, kind="stable")
    begin, length = first[:-1][by_length], length[by_length]
    move = np.exp(ties - ties.max())
    steps = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    bounded = np.clip(score, -30, 30)
    local = np.stack((1 / (1 + np.exp(bounded)), 1 / (1 + np.exp(-bounded))), axis=1)
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t in range(steps):
        i = begin[: live[t]] + t
        a = local[i] if t == 0 else local[i] * (ahead[i - 1] @ move)
        ahead[i] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        i = begin[: live[t + 1]] + t
        right = local[i + 1] * back[i + 1]
        b = right @ move.T
        joint = ahead[i][:, :, None] * move[None] * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[i] = b / b.sum(axis=1, keepdims=True)
    good = ahead * back
    return good[:, 1] / good.sum(axis=1), pairs


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray) -> Crf:
    """Maximum conditional likelihood with a ridge, by Adam; without lines or with one label only every score is the same."""
    model = Crf(np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32))
    if not len(x):
        return model
    model.middle, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    full = with_neighbours((x - model.middle) / model.scale, first).astype(np.float64)
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    stays = np.array([((y == 0) & inner).sum(), ((y == 1) & inner).sum()])
    theta = np.zeros(full.shape[1] + 4)
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pairs = chain(full @ theta[:-4], first, theta[-4:].reshape(2, 2))
        slope = np.concatenate((full.T @ (y - good), (np.diag(stays) - pairs).ravel())) / len(y) - RIDGE * theta
        first_moment = 0.9 * first_moment + 0.1 * slope
        second_moment = 0.99 * second_moment + 0.01 * slope**2
        theta += RATE * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    model.weights, model.ties = theta[:-4], theta[-4:].reshape(2, 2)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5; those rows are never learnt from. True for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def line_share(counts: np.ndarray, most: int) -> int:
    """The largest number of lines for each document, one at least, at which all of them together have at most ``most``."""
    low, high = 1, max(1, int(counts.max(initial=1)))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(counts, middle).sum() <= most else (low, middle - 1)
    return low


def pieces(n: int, share: int) -> list[tuple[int, int]]:
    """Runs of lines of a text of ``n`` lines: all of them, or up to ``PIECES`` runs of ``share`` lines in all, spread over the whole text."""
    if n <= share:
        return [(0, n)]
    runs = min(PIECES, share)
    sizes = [share // runs + (i < share % runs) for i in range(runs)]
    starts = [sum(sizes[:i]) + i * (n - share) // max(1, runs - 1) for i in range(runs)]
    return [(a, a + size) for a, size in zip(starts, sizes, strict=True)]


def train(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Crf:
    """Fit on labelled documents that aren't held out: the first ``most_docs`` by hash of their id.

    If they have more than ``most_lines`` lines, each gives at most the same
    number of them, spread over its whole text, so a long text pushes no other
    out.  Of labels that repeat for an id the lowest counts; null labels and
    ids are left out.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = cut(known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most_docs))
    place = F.md5(F.col("doc_id").cast("string")).alias("place")
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select(place, "quality", "text")  # at most most_docs ids
    breaks = F.char_length("text") - F.char_length(F.regexp_replace("text", "\n", ""))
    share = line_share(np.array([r[0] for r in texts.select(breaks + 1).collect()], np.int64), most_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, _, first = line_features(*bytes_of(part.column("text")))
                at = [(i, a + begin, a + end) for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) for begin, end in pieces(int(b - a), share)]
                of = pa.array([i for i, _, _ in at], pa.int64())
                blobs = pa.array([x[a:b].tobytes() for _, a, b in at], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("place").take(of), part.column("quality").take(of), pa.array([int(b - a) for _, a, b in at], pa.int64()), blobs], ["place", "quality", "n_lines", "x"])

    found = texts.mapInArrow(run, f"place string, quality {dict(labels.dtypes)['quality']}, n_lines long, x binary")
    rows = sorted(found.collect(), key=lambda r: (r["place"], r["x"]))
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows)])
    first = np.concatenate(([0], np.cumsum([r["n_lines"] for r in rows]))).astype(np.int64)
    return fit(x, first, np.array([r["quality"] for r in rows]))


def document_scores(texts: pa.Array, model: Crf) -> np.ndarray:
    x, chars, first = line_features(*bytes_of(texts))
    good, _ = chain(model.line_scores(x, first), first, model.ties)
    weight = np.maximum(chars, 1e-3)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)


def scored(docs: DataFrame, model: Crf, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the score (0 to 1) in ``out``; a column of that name is replaced.

    A null text is empty.  An empty text is one empty line and gets that line's
    score.  Every line of a text counts, however long the text is.
    """
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                score = pa.array(document_scores(part.column(part.schema.get_field_index(text)), model))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were."""
    score = fresh("_quality_score", docs)
    return scored(docs, train(docs, labels), out=score).where(F.col(score) >= KEEP_AT).select(*docs.columns)


def op6_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a row for each row of ``documents``, repeated ones too. Null and empty texts are scored as one empty line; without labels to learn from every score is 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), out="score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
