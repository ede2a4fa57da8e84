"""A conversation of thousands of turns: an example for each reply, all that came before in each."""

import hashlib
import time

from millrace.llm.chat import END, START, examples, read_back
from pyspark.sql import functions as F

TURNS = 3000


def test_thousands_of_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} {END if i % 10 == 0 else ''}") for i in range(TURNS)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    began = time.perf_counter()
    made = examples(frame)
    size = made.agg(F.count("*"), F.max(F.char_length("formatted")), F.sum(F.char_length("formatted"))).first()
    got = read_back(made).first()
    took = time.perf_counter() - began
    print(f"{TURNS} turns: {size[0]} examples, the longest of {size[1]} characters, {size[2]} in all, {took:.1f} s")
    assert size[0] == TURNS // 2 and got["n_turns"] == TURNS and got["formatted_chars"] == size[2] and took < 120
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    said = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (got["loss_chars"], got["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert made.where(F.col("example") == 0).first()["formatted"].count(START) == 2
