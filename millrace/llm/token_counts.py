"""Token counts by batch encoding, lengths only.

Arrow batches are cut into groups of about the same number of bytes.  Long
texts are cut where white space begins, or where a letter meets a stop or comma:
a byte-level tokenizer ends a piece there whatever stands around, so the counts
of the parts add up to the count of the whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .textbytes import bytes_of, slices

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
PART_CHARS = 4096
GROUP_BYTES = 1 << 19
# letters of Latin, kana and Han, and the stops and commas written after them: texts without spaces are cut there
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])(?=[,.;:!?\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def parts_of(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut at the first safe boundary after each ``size`` characters; where there is none the part is longer."""
    out, at = [], 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    parts = [parts_of(t) for t in texts]
    encoded = _tokenizer(path).encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False)
    ends = np.cumsum([len(ps) for ps in parts])
    sums = np.concatenate(([0], np.cumsum([len(e) for e in encoded])))[np.concatenate(([0], ends))]
    return np.diff(sums)


def token_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``keys``, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Counts are the library's own, without begin, end or added tokens; strings of
    special tokens inside a text count as it takes them by default.  A null text
    is empty, with no tokens.  ``path`` names the vocabulary file on each executor.
    """
    path = path or vocabulary_path()
    schema = docs.select(*keys, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", GROUP_BYTES):
                texts = part.column("_text")
                n_bytes = np.diff(bytes_of(texts)[1])
                counts = count_tokens(texts.to_pylist(), path)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(n_bytes), pa.array(counts.astype(np.int64))], [*keys, "n_bytes", "n_tokens"])

    found = docs.select(*keys, text_of(text).alias("_text")).mapInArrow(run, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; a row for each row of ``documents``, repeated ones too. Null and empty texts have none; columns besides doc_id aren't read."""
    return token_counts(table(spark, sf_dir, "documents"))
