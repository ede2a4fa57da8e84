"""Spark-first analytics: a streaming lakehouse and the relational, graph and block-store computations around it."""
