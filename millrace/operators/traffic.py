"""Counts of messages and tasks by node, with totals, shares and conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import neighbours

TOTAL = "TOTAL"
# fixed values: queue sizes at which tasks are pushed and pulled, and the smallest move
PUSH_ABOVE, PULL_BELOW, SMALLEST_MOVE = 2000, 100, 20


def traffic(messages: DataFrame) -> DataFrame:
    """``messages(source, sink, payload)`` to counts and sums sent and received by node; each message is read once."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.lit(True).alias("sent")),
        F.struct(F.col("sink").alias("node"), F.lit(False).alias("sent")),
    )
    each = messages.select(F.col("payload").cast("long").alias("payload"), F.explode(ends).alias("e")).select("payload", "e.*")
    return each.groupBy("node").agg(
        F.count_if("sent").alias("sent_count"),
        F.coalesce(F.sum(F.when(F.col("sent"), F.col("payload"))), F.lit(0)).alias("sent_sum"),
        F.count_if(~F.col("sent")).alias("received_count"),
        F.coalesce(F.sum(F.when(~F.col("sent"), F.col("payload"))), F.lit(0)).alias("received_sum"),
    )


def with_total(by_node: DataFrame, measures: list[str], node: str = "node") -> DataFrame:
    """A row for each node and one for all of them."""
    label = F.when(F.grouping(node) == 1, TOTAL).otherwise(F.col(node).cast("string"))
    return by_node.rollup(node).agg(label.alias("label"), *(F.sum(m).alias(m) for m in measures)).select(F.col("label").alias(node), *measures)


def load_share(stats: DataFrame) -> DataFrame:
    """Node statistics with a total row and each row's share of completed tasks, in percent to 4 places; zero where none completed."""
    measures = ["generated", "pulled", "pushed", "completed"]
    out = with_total(stats, measures)
    total = F.max(F.when(F.col("node") == TOTAL, F.col("completed"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("percent", F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col("completed") * 100 / total, 4)))


def unbalanced(stats: DataFrame) -> DataFrame:
    """Nodes that didn't complete what they generated and pulled less what they pushed."""
    expected = F.col("generated") + F.col("pulled") - F.col("pushed")
    return stats.withColumn("expected", expected).where(F.col("expected") != F.col("completed"))


def compared(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """``(node, n)`` recorded and observed: match, mismatch, or not found on one side."""
    a, b = recorded.select("node", F.col("n").alias("recorded")), observed.select("node", F.col("n").alias("observed"))
    verdict = F.when(F.col("recorded").isNull() | F.col("observed").isNull(), "not found").when(F.col("recorded") == F.col("observed"), "match").otherwise("mismatch")
    return a.join(b, "node", "full_outer").withColumn("verdict", verdict)


def balance_plan(queues: DataFrame) -> DataFrame:
    """``queues(node, queued)`` to what each node pushes, shares on request, and asks for."""
    q, least = F.col("queued"), F.lit(SMALLEST_MOVE)

    def half(above: int) -> Column:
        return F.greatest(least, F.floor((q - above) / 2))

    return queues.withColumns(
        {
            "push": F.when(q > PUSH_ABOVE, half(PUSH_ABOVE)).otherwise(0).cast("long"),
            "can_share": F.when(q > PULL_BELOW, half(PULL_BELOW)).otherwise(0).cast("long"),
            "asks_for": F.when(q < PULL_BELOW, F.greatest(least, F.lit(PUSH_ABOVE) - q)).otherwise(0).cast("long"),
        }
    )


def ring(nodes: DataFrame, node: str = "node") -> DataFrame:
    """Each node's successor and predecessor in order of id, around the end."""
    return neighbours(nodes, node)
